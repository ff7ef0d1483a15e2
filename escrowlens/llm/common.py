"""Helpers shared by the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escrowlens.session import scratch_path

# The word rule of the contracts (a run of anything but these
# six ASCII white-space bytes) and the two alphabets of A-Z lower-casing.
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text as an array (no empty strings)."""
    return F.array_remove(F.split(text, WHITE), "")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage with replicated-by-the-store files, so a lost executor
    costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let rows with whole texts go to Python 500 at a time, unless the session
    has its own number: Spark's 10,000 rows are tens of megabytes of text, held
    several times over in every worker of an executor."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "500")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def slot_of(cols: list[str], bits: int) -> Column:
    """Slot of a key in a bit table of ``2**bits`` slots."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits))


def bit_table(keys: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """A set of keys as a bit table: rows (``_word``, ``_mask``), 64 slots each.

    It has at most ``2**bits / 64`` rows however many keys there are, so it may
    be broadcast.  Membership has false positives (another key in the same
    slot) and no false negatives: use it to skip work, never to decide.
    """
    slot = slot_of(cols, bits)
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    return (keys.select(slot.alias("_slot"))
            .select(F.expr("_slot div 64").alias("_word"), bit.alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_mask")))


def maybe_in(df: DataFrame, table: DataFrame, cols: list[str], bits: int, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false only if the key is surely not in ``table``."""
    slotted = df.withColumn("_slot", slot_of(cols, bits)).withColumn("_word", F.expr("_slot div 64"))
    hit = F.expr("coalesce(shiftright(_mask, cast(_slot % 64 as int)) & 1L, 0L) = 1L")
    return (slotted.join(F.broadcast(table), "_word", "left").withColumn(flag, hit)
            .drop("_word", "_slot", "_mask"))


def without(df: DataFrame, gone: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """Rows of ``df`` whose key is not in ``gone`` (exact; keys never null there).

    Most rows pass straight from the scan; only those that the bit table can't
    clear are shuffled and joined.
    """
    flagged = maybe_in(df, bit_table(gone, cols, bits), cols, bits, "_maybe")
    clear = flagged.filter("not _maybe").drop("_maybe")
    met = flagged.filter("_maybe").drop("_maybe").join(gone, cols, "left_anti")
    return clear.unionByName(met.select(*clear.columns))


def looked_up(df: DataFrame, table: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """``df`` left-joined with ``table`` on ``cols``, its other columns null where
    there is no match.

    Rows that the bit table clears get their nulls in the scan; the others meet
    the table in a join whose hot keys the adaptive skew join can split.
    """
    flagged = maybe_in(df, bit_table(table, cols, bits), cols, bits, "_maybe")
    clear = flagged.filter("not _maybe").drop("_maybe")
    for f in table.schema.fields:
        if f.name not in cols:
            clear = clear.withColumn(f.name, F.lit(None).cast(f.dataType))
    met = flagged.filter("_maybe").drop("_maybe").join(table, cols, "left")
    return clear.unionByName(met.select(*clear.columns))
