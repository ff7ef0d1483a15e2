"""Document fingerprints as threshold-scaled sketches (operator 10), DataFrame
functions only.

A document's shingles are its distinct runs of five lower-cased words (with
fewer words, the whole sequence).  The sketch keeps every shingle hash below a
fixed fraction of the 64-bit range, and the smallest hash in any case, so that
short texts have a sketch too.  The same rule keeps or drops a shingle in every
document, so the sketch of a union is the union of the sketches (plus smallest
hashes that ``merge_sketches`` drops again), and containment can be estimated
between documents of very unequal size.

Defined results
* a null text counts as empty; a text without words has the empty sketch and
  the empty fingerprint; two empty sketches have likeness 1, one has 0;
* equal texts have equal fingerprints (so have texts that differ in A-Z case,
  in white space or in repeated shingles only);
* ``with_next`` orders by descending ``doc_id``, ties by text, null ids last;
  a table of one row is its own next; an empty table gives an empty result;
* extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.llm.common import lower_ascii, staged, text_or_empty, words_of

SHINGLE_WORDS = 5
FRACTION = 1 / 8


def add_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """``df`` with ``out``: sorted array<long> of the kept hashes of ``text``.

    Each step is a column of its own, so an array that later steps index is
    computed once.
    """
    limit = F.lit(int(-(2 ** 63) + fraction * 2 ** 64))
    words, hashes, all_, kept = (f"_{out}_{x}" for x in ("w", "h", "s", "k"))
    df = df.withColumn(words, words_of(lower_ascii(F.col(text))))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    run = lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(SHINGLE_WORDS)])
    several = F.transform(F.sequence(F.lit(0), F.size(hashes) - SHINGLE_WORDS), run)
    short = F.array(F.xxhash64(F.col(hashes)))
    df = df.withColumn(all_, F.when(F.size(hashes) >= SHINGLE_WORDS, several)
                       .when(F.size(hashes) > 0, short)
                       .otherwise(F.array().cast("array<bigint>"))).drop(hashes)
    low = F.concat(F.filter(all_, lambda h: h < limit), F.array_compact(F.array(F.array_min(all_))))
    df = df.withColumn(kept, low).drop(all_)
    return df.withColumn(out, F.array_sort(F.array_distinct(kept))).drop(kept)


def merge_sketches(left: Column, right: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two documents together: kept hashes of both, and the smallest."""
    limit = F.lit(int(-(2 ** 63) + fraction * 2 ** 64))
    both = F.array_union(left, right)
    low = F.array_union(F.filter(both, lambda h: h < limit),
                        F.array_compact(F.array(F.array_min(both))))
    return F.array_sort(low)


def likeness(left: Column, right: Column) -> Column:
    """Estimated resemblance (intersection over union) of two sketches, 0 to 1."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of ``part``'s shingles that ``whole`` has too, 0 to 1."""
    return (F.when(F.size(part) == 0, 1.0)
            .otherwise(F.size(F.array_intersect(part, whole)) / F.size(part)))


def fingerprint_text(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """One row per document: doc_id, sketch, fingerprint."""
    base = docs.select("doc_id", text_or_empty().alias("_text"))
    return (add_sketch(base, "_text", "sketch", fraction)
            .select("doc_id", "sketch", fingerprint_text(F.col("sketch")).alias("fingerprint")))


def with_next(docs: DataFrame, buckets: int | None = None,
              fraction: float = FRACTION) -> DataFrame:
    """Every document with the next one in descending ``doc_id`` (after the
    last: the first): doc_id, text, sketch, next_text, next_sketch.

    Rows are dealt into ranges of ``doc_id`` cut at its quantiles (that many
    numbers come to the driver), sorted inside their range only; the last row
    of a range meets the first one of the next range with rows.  Texts are
    shuffled once, and no task holds more than a range.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)], F.lit(1.0))
    found = docs.agg(F.percentile_approx("doc_id", steps, 10_000).alias("q")).first()["q"]
    bounds = sorted(set(found or []), reverse=True)
    jumps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]

    def bucket() -> Column:
        """How many bounds are above doc_id, by binary search; null ids last."""
        cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
        place = F.aggregate(
            F.array(*map(F.lit, jumps)), F.lit(0),
            lambda at, jump: F.when(F.get(cuts, at + jump - 1) > F.col("doc_id"), at + jump).otherwise(at))
        return F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(place)

    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_bucket", bucket())
    heads = staged(base.groupBy("_bucket").agg(F.max("doc_id").alias("_head")), "sketch-ranges")
    order = Window.partitionBy(F.lit(1)).orderBy("_bucket")  # one row per range
    every = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    after = (heads.withColumn("_next_bucket", F.coalesce(F.lead("_bucket").over(order),
                                                         F.first("_bucket").over(every)))
             .select(F.col("_bucket").alias("_before"), F.col("_next_bucket").alias("_bucket")))
    first = (base.join(F.broadcast(heads.withColumnRenamed("_bucket", "_b")),  # a row per range
                       (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_head")))
             .groupBy("_bucket").agg(F.min("text").alias("_first")))
    first = staged(add_sketch(first.join(after, "_bucket"), "_first", "_first_sketch", fraction)
                   .select(F.col("_before").alias("_bucket"), "_first", "_first_sketch"),
                   "sketch-heads")
    dealt = add_sketch(base.repartition(buckets, "_bucket"), "text", "sketch", fraction)
    line = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = (dealt.withColumn("_nt", F.lead("text").over(line))
            .withColumn("_ns", F.lead("sketch").over(line)))
    return (rows.join(first.repartition(buckets, "_bucket"), "_bucket")
            .select("doc_id", "text", "sketch",
                    F.coalesce("_nt", "_first").alias("next_text"),
                    F.coalesce("_ns", "_first_sketch").alias("next_sketch")))
