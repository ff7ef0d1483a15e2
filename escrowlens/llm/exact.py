"""Exact dedup by progressive refinement (operator 5), DataFrame functions only.

Rows are grouped by text length, then by a hash of the first characters, then
by a hash of the full text.  A row goes on only while its group holds more than
one row.  Which lengths and which prefixes go on is a fixed-size bit table
(``common.bit_table``), broadcast to the scan, so texts are never shuffled:
the scan that hashes full texts skips every row whose group has ended, and
what is shuffled is ids, lengths and hashes, aggregated map-side first.

Defined results
* texts are compared after lower-casing A-Z; a null text counts as empty, and
  empty texts are equal to each other;
* of equal texts the row with the largest ``doc_id`` stays; a null ``doc_id``
  is smaller than any other and stays only if all of its group are null;
* repeated rows of one ``doc_id`` count one by one in ``group_size`` and share
  ``kept``; ``drop_copies`` lets only one of them through;
* an empty table gives an empty result; extra columns are ignored here and
  carried through by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import bit_table, lower_ascii, maybe_in, staged, text_or_empty, whole_row

PREFIX_CHARS = 64
TABLE_BITS = 22  # 4 million slots, at most 65,536 broadcast rows


def _keyed(docs: DataFrame, prefix_chars: int, bits: int) -> DataFrame:
    """``docs`` with ``_len``, ``_prefix`` and ``_full``; a null hash means that
    the row's group ended before it was needed."""
    base = docs.withColumn("_norm", F.coalesce(F.col("text"), F.lit("")))
    base = base.withColumn("_len", F.octet_length("_norm"))
    lengths = base.groupBy("_len").count().filter("count > 1")
    base = maybe_in(base, bit_table(lengths, ["_len"], bits), ["_len"], bits, "_more")
    head = F.xxhash64(lower_ascii(F.substring("_norm", 1, prefix_chars)))
    base = base.withColumn("_prefix", F.when(F.col("_more"), head)).drop("_more")
    prefixes = (base.filter("_prefix is not null").groupBy("_len", "_prefix").count()
                .filter("count > 1"))
    base = maybe_in(base, bit_table(prefixes, ["_len", "_prefix"], bits),
                    ["_len", "_prefix"], bits, "_more")
    full = F.sha2(lower_ascii(F.col("_norm")), 256)
    return (base.withColumn("_full", F.when(F.col("_more") & F.col("_prefix").isNotNull(), full))
            .drop("_more", "_norm"))


KEY = ["_len", "_prefix", "_full"]


def _groups(keyed: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: the id that stays and the size.

    A table of its own, so that the join back shuffles both sides and the rows
    of a hot group can be split by the adaptive skew join.
    """
    return staged(keyed.filter("_full is not null").groupBy(*KEY)
                  .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
                  .filter("_n > 1"), "exact-groups")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS,
                bits: int = TABLE_BITS, digest: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept; and, if
    ``digest`` names it, a column with the SHA-256 of the row's lower-cased text."""
    keyed = _keyed(docs.select("doc_id", "text"), prefix_chars, bits)
    more = [] if digest is None else [digest]
    for name in more:  # from the row itself: its doc_id may be null or another row's too
        keyed = keyed.withColumn(name, F.sha2(lower_ascii(text_or_empty()), 256))
    thin = staged(keyed.drop("text"), "exact-keys")
    return (thin.join(_groups(thin), KEY, "left")
            .select("doc_id",
                    F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
                    .alias("keep_id"),
                    F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), *more)
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def drop_copies(docs: DataFrame, prefix_chars: int = PREFIX_CHARS,
                bits: int = TABLE_BITS) -> DataFrame:
    """``docs`` without exact copies: all columns, one row of each group.

    Rows that no other row can equal pass straight from the scan; only rows
    with a full hash meet their group's row.
    """
    inner = docs.select("doc_id", "text", whole_row(docs).alias("_row"))
    keyed = _keyed(inner, prefix_chars, bits)
    thin = staged(keyed.filter("_full is not null").select("doc_id", *KEY), "exact-drop")
    alone = keyed.filter("_full is null")
    met = (keyed.filter("_full is not null").join(_groups(thin), KEY, "left")
           .filter("_n is null or doc_id <=> _keep").dropDuplicates([*KEY, "doc_id"]))
    return alone.select("_row.*").unionByName(met.select("_row.*"))
