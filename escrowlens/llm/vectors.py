"""Helpers of the vector operators: usable rows, and queries meeting blocks.

Queries meet rows in work items: a *block* of at most ``BLOCK_VALUES`` components
and a *chunk* of about ``CHUNK_VALUES`` components of queries that need it.  Each
item is one group of a cogroup, so memory is bounded by the two numbers whatever
the tables' sizes, and no key can be hot: blocks are cut by row counts, chunks by a
hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_VALUES = 1 << 17  # 2,048 rows of 64 components
CHUNK_VALUES = 1 << 18


def rows_of(values: int, dims: int) -> int:
    """Rows of ``dims`` components that make up about ``values`` components."""
    return max(16, values // max(1, dims))


def finite(col: str) -> Column:
    """True for a non-null array without null, NaN or infinite components."""
    x = F.col(col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & good, F.lit(False))


def common_length(df: DataFrame, col: str) -> tuple[int, int]:
    """The most frequent array length (the larger of equally frequent ones; 0 if
    there is no row) and the number of rows that have it."""
    top = (df.groupBy(F.size(col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).first())  # one row
    return (top["d"], top["n"]) if top else (0, 0)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    """A list column whose lists all have ``dims`` items as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(-1, dims)


def chunk_of(id_col: str, n_queries: int, dims: int) -> Column:
    """Chunk of a query; there are as many as keep one near ``CHUNK_VALUES``."""
    chunks = max(1, -(-n_queries // rows_of(CHUNK_VALUES, dims)))
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(chunks)).cast("int")


def sliced(batches, dims: int):
    """Arrow batches cut so that a slice holds at most ``BLOCK_VALUES`` components."""
    step = rows_of(BLOCK_VALUES, dims)
    for batch in batches:
        for s in range(0, batch.num_rows, step):
            yield batch.slice(s, step)


def meet(entries: DataFrame, routed: DataFrame, work, schema: str) -> DataFrame:
    """``work(entries, queries)`` for each (block, chunk) that ``routed`` names.

    ``entries`` carry ``block``; ``routed`` has one row per query and block that
    it needs, with ``block`` and ``chunk``.  A block travels once per chunk.
    """
    pairs = routed.select(F.col("block").alias("_block"), F.col("chunk").alias("_chunk")).distinct()
    sent = entries.join(pairs, entries["block"] == pairs["_block"]).drop("block")
    return (sent.groupBy("_block", "_chunk").cogroup(routed.groupBy("block", "chunk"))
            .applyInArrow(work, schema))
