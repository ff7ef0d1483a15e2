"""Mixing sources to target weights by hash-threshold histograms (operator 4).

Every source gets a word budget (``targets``).  Each document is taken
``floor(budget / source size)`` times, and once more if its hash is below the
source's threshold, so the documents that fit a smaller budget are a subset of
those that fit a larger one.  Thresholds come from histograms, not from a sort:
word sums by source and 10-bit hash bucket, aggregated map-side; the bucket in
which the remaining budget ends is the only one that the next level splits, by
the next 10 bits, until all 40 bits of the hash are used.

Defined results
* a null text has size 0; rows of size 0 follow their hash like any other;
* sources are ordered by code point, a null source last and a source of its own;
* rows with the same hash (repeated rows of one ``doc_id``, null ids) go
  together; a budget ends on whichever side of that last group is nearer;
* no words at all, or no rows: all targets 0, an empty table gives no rows;
* extra columns are ignored by ``mix_sources`` and carried by ``mixed_rows``.

The per-source window runs over one row per source; the other one over at most
1,024 histogram rows per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.llm.common import staged, text_or_empty, whole_row, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
LEVELS, LEVEL_BITS = 4, 10
HASH_BITS = LEVELS * LEVEL_BITS


def hash40(col: str):
    """40 bits of the MD5 of an id's decimal text, as a long."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), h (hash)."""
    return docs.select("doc_id", "source", F.size(words_of(text_or_empty())).cast("long").alias("size"),
                       hash40("doc_id").alias("h"))


def targets(thin: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT,
            share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, target.

    Handing the excess over a cap to the others by weight, until none is above,
    ends at ``min(cap, weight * level)`` for one level.  With sources in order
    of cap / weight, the level if all earlier ones are capped is
    (total - their caps) / (weights from here on); it rises while the next
    source is capped and falls after, so the level wanted is its maximum.
    """
    per = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    rest = Window.orderBy("_ratio", "_place").rowsBetween(0, Window.unboundedFollowing)
    done = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    return (per.withColumn("_w", weight).withColumn("_place", place)
            .withColumn("_cap", F.col("source_size") * float(max_repeat))
            .withColumn("_ratio", F.col("_cap") / F.col("_w"))
            .withColumn("_total", F.sum("source_size").over(every) * share)
            .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(done), F.lit(0.0)))
                        / F.sum("_w").over(rest))
            .withColumn("_level", F.max("_level").over(every))
            .select("source", "source_size",
                    F.least(F.col("_cap"), F.col("_w") * F.col("_level")).alias("target")))


def thresholds(thin: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole copies (``_copies``) and the hash up to which one more
    copy is taken (``_up_to``, inclusive; -1 for none).

    State per source: the bucket path so far and the budget left in it; a path
    of null means that the budget covers all that was left.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.select("source", whole.cast("long").alias("_copies"),
                         (F.col("target") - whole * F.col("source_size")).alias("_left"),
                         F.lit(0).cast("long").alias("_path"), F.lit(True).alias("_open"))
    for level in range(LEVELS):
        shift = HASH_BITS - (level + 1) * LEVEL_BITS
        same = F.expr(f"shiftright(h, {shift + LEVEL_BITS}) = _path")
        rows = (thin.join(state.filter("_open").withColumnRenamed("source", "_s"),
                          F.col("source").eqNullSafe(F.col("_s")) & same)
                .groupBy("source", "_left", F.expr(f"shiftright(h, {shift})").alias("_bucket"))
                .agg(F.sum("size").alias("_words")))
        upto = Window.partitionBy("source").orderBy("_bucket")
        sums = rows.withColumn("_sum", F.sum("_words").over(upto))
        cut = (sums.filter(F.col("_sum") > F.col("_left")).groupBy("source")
               .agg(F.min(F.struct("_bucket", "_sum", "_words")).alias("_c"))
               .withColumnRenamed("source", "_s"))
        state = (state.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
                 .select("source", "_copies",
                         F.when(F.col("_c").isNotNull(),
                                F.col("_left") - (F.col("_c._sum") - F.col("_c._words")))
                         .otherwise(F.col("_left")).alias("_left"),
                         F.when(F.col("_c").isNotNull(), F.col("_c._bucket"))
                         .otherwise(F.col("_path")).alias("_path"),
                         (F.col("_open") & F.col("_c").isNotNull()).alias("_open"),
                         F.col("_c._words").alias("_words")))
    last = F.col("_words") - F.col("_left") < F.col("_left")
    return state.select(
        "source", "_copies",
        F.when(~F.col("_open"), F.lit(1 << HASH_BITS)).when(last, F.col("_path"))
        .otherwise(F.col("_path") - 1).alias("_up_to"))


def _plan(thin: DataFrame, weights, max_repeat, share) -> DataFrame:
    """One row per source: target, copies and threshold.

    A table of its own: its measured size lets Spark broadcast it, so documents
    are not shuffled by source; were there too many sources for that, both sides
    of the join are shuffles whose hot sources the adaptive skew join can split.
    """
    goals = staged(targets(thin, weights, max_repeat, share), "mix-goals")
    cuts = thresholds(thin, goals).withColumnRenamed("source", "_s2")
    return staged(goals.join(cuts, F.col("source").eqNullSafe(F.col("_s2"))).drop("_s2")
                  .withColumnRenamed("source", "_s"), "mix-plan")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT,
                share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    thin = staged(sized(docs), "mix-sizes")
    plan = _plan(thin, weights, max_repeat, share)
    copies = F.col("_copies") + (F.col("h") <= F.col("_up_to")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.least(copies, F.lit(max_repeat))).otherwise(0)
    return (thin.join(plan, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("copies", copies.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT,
               share: float = 1.0) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it.

    The threshold test needs only the hash, so texts stay where they were read.
    """
    thin = staged(sized(docs), "mix-sizes")
    plan = _plan(thin, weights, max_repeat, share)
    copies = F.col("_copies") + (F.col("_h") <= F.col("_up_to")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.least(copies, F.lit(max_repeat))).otherwise(0)
    rows = docs.select(whole_row(docs).alias("_row"), F.col("source").alias("_source"),
                       hash40("doc_id").alias("_h"))
    return (rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
            .withColumn("_n", copies.cast("int")).filter("_n > 0")
            .withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select("_row.*"))
