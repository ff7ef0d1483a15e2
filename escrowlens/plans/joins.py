"""Join helpers with explicit size reasoning.

Broadcasts are only written out for frames whose size is bounded by
construction (a global aggregate has one row; a settings lookup has one row
per key of a fixed list).  Every other join is left to Catalyst: with AQE on,
a side whose *measured* shuffle output is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is turned into a broadcast
at run time, and otherwise the join stays a sort-merge join - the checked
broadcast with a fallback.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine single-row aggregate frames side by side.

    Each input is a global aggregate (exactly one row), so the product has
    one row; each is broadcast, which keeps the combination a map-side step.
    """
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames[1:], frames[0])


def explode_parties(df: DataFrame, key: str, parties: list[str], out: str = "party_id"
                    ) -> DataFrame:
    """One row per (row, distinct party): turns ``a = x OR b = x`` into an equi-join.

    ``array_distinct`` drops the repeat when both parties are the same user, so
    no shuffle is needed to de-duplicate.
    """
    arr = F.array_distinct(F.array(*[F.col(p) for p in parties]))
    return df.select(F.col(key), F.explode(arr).alias(out), *[c for c in df.columns
                                                           if c != key])


def growing(df: DataFrame) -> DataFrame:
    """``df``, a table that grows with the business, never to be broadcast by a join.

    Catalyst takes the size of a scan from its compressed files: 7.2 million products of
    6 MB by that estimate, below the limit for a broadcast, are several hundred MB of rows
    on the driver.  The hint makes the join a sort-merge join at any size.
    """
    return df.hint("merge")


TABLE_BITS = 24  # at most 262,144 broadcast rows


def _maybe_in(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``_maybe``: false only where the key is surely not in ``keys``.

    The keys travel as a bit table, at most ``2**TABLE_BITS / 64`` rows however many
    they are; it only decides which rows need the exact join.
    """
    slot = F.pmod(F.xxhash64(*cols), F.lit(1 << TABLE_BITS))
    table = (keys.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_mask")))
    hit = F.expr("coalesce(shiftright(_mask, cast(_slot % 64 as int)) & 1L, 0L) = 1L")
    placed = df.withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 64"))
    return placed.join(F.broadcast(table), "_word", "left").withColumn("_maybe", hit).drop("_word", "_slot", "_mask")


def perhaps(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` without most of those whose key is not in ``keys``: what is left
    goes to an exact join with them, the others need no shuffle."""
    return _maybe_in(df, keys, cols).filter("_maybe").drop("_maybe")


def without_keys(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (exact); only rows that may be are shuffled."""
    flagged = _maybe_in(df, keys, cols)
    met = flagged.filter("_maybe").join(keys, cols, "left_anti")
    return flagged.filter("not _maybe").unionByName(met.select(*flagged.columns)).drop("_maybe")


# A task of a grid sorts the rows of one cell; below so many cells there is no grid.
ROWS_PER_CELL = 1_000_000
LEAST_CELLS = 16


def grid_shape(rows: DataFrame, a: DataFrame, b: DataFrame) -> tuple[int, int] | None:
    """Lines and columns of a grid on which stored ``rows`` meet ``a`` (by lines) and ``b``
    (by columns), chosen for the fewest repeated rows of the two.  None where the rows are
    few, or the repeated ones would be more than they are."""
    n = rows.count()
    cells = -(-n // ROWS_PER_CELL)
    if cells < LEAST_CELLS:
        return None
    n_a, n_b = max(1, a.count()), max(1, b.count())
    lines = min(cells, max(1, round((cells * n_a / n_b) ** 0.5)))
    columns = -(-cells // lines)
    return (lines, columns) if n_a * columns + n_b * lines <= n else None


def grid_left_join(rows: DataFrame, by_line: tuple[DataFrame, str, str], by_column: tuple[DataFrame, str, str],
                   shape: tuple[int, int], spread: str) -> DataFrame:
    """``rows`` left-joined with two tables, each ``(table, its key, key in rows)``, by one
    shuffle of the rows.

    A row goes to the line of its first key and the column of its second, each table's row
    to every cell of its line or column.  So the rows travel once, and the tables as often
    as there are columns or lines, which is less where they are that much smaller.  A key
    that is very frequent fills a line, not one task; rows without a key meet nothing and
    go by ``spread``.
    """
    (a, a_key, a_of), (b, b_key, b_of) = by_line, by_column
    lines, columns = shape

    def nth(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def of_row(key, n):
        return F.when(F.col(key).isNull(), nth(spread, n)).otherwise(nth(key, n))

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(df, cell, name):
        return df.withColumn(name, cell).repartitionById(lines * columns, F.col(name))

    rows = dealt(rows, of_row(a_of, lines) * columns + of_row(b_of, columns), "_cell")
    a = dealt(a.withColumn("_nth", each(columns)), nth(a_key, lines) * columns + F.col("_nth"), "_cell_a").drop("_nth")
    b = dealt(b.withColumn("_nth", each(lines)), F.col("_nth") * columns + nth(b_key, columns), "_cell_b").drop("_nth")
    j = rows.join(growing(a), (F.col("_cell") == F.col("_cell_a")) & (F.col(a_of) == F.col(a_key)), "left")
    j = j.join(growing(b), (F.col("_cell") == F.col("_cell_b")) & (F.col(b_of) == F.col(b_key)), "left")
    return j.drop("_cell", "_cell_a", "_cell_b")
