"""Approximate nearest neighbours by an inverted multi-index (operator 11).

Vectors are cut into two halves, each quantised by its own k-means codebook; a
row's cell is the pair of its nearest centroids, so ``k`` centroids a half give
``k * k`` cells.  The codebooks are fitted on a bounded sample (at most
``FIT_VALUES`` components, the rows with the smallest hashes of the id); every row is
indexed: it is stored in its cell's posting block.  Cells are laid out in order
and cut into blocks by their counts; a cell larger than a block is dealt over
several, so a vector that a third of all rows repeat fills many blocks, not one.

A query walks the cells by rising sum of its two half distances, from a heap of
centroid pairs (both half lists sorted; a pair goes in when its two
predecessors are out), until the cells walked hold ``visit`` rows.  Then the walked
cells' entries are reranked by their exact distances.

How far to walk is measured, not guessed: for at most ``PROBES`` queries the exact
neighbours are found among all rows, and ``visit`` is the number of rows that a walk
needs to reach a share ``recall`` of them.  The rule is the same at every size.

What goes to the driver: a sample, the codebooks, at most ``MOST_CENTROIDS ** 2`` cell
counts and the probes' neighbours, all bounded.

Defined results
* vectors that are null, empty, all zero or hold null, NaN or infinite components
  take no part, nor do rows with a null id, nor vectors of another length than
  the most frequent one (of equally frequent lengths, the larger);
* rows that share the query's id are its own row; several query rows of one id
  are one query, with the smallest of their vectors; candidates that repeat an id
  are candidates each;
* ties go to the smaller id; fewer than ``k`` candidates: all that were found;
* an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.llm.common import staged
from escrowlens.llm.vectors import (BLOCK_VALUES, chunk_of, common_length, finite, matrix, meet,
                                    rows_of, sliced)

FIT_VALUES = 1 << 21
CELL_ROWS = 4            # centroids are chosen so that a cell holds about so many rows,
MOST_CENTROIDS = 512     # up to so many centroids a half
ROUNDS = 10              # of k-means
PROBES = 100
RECALL = 0.96
SLICE = 256              # queries measured side by side
WALKS = 128              # queries that one task walks for
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """The model: codebooks, rows per cell, and where each cell's block starts."""

    dims: int
    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray   # rows per cell
    first: np.ndarray    # first block of a cell
    blocks: np.ndarray   # number of blocks of a cell


# ---------------------------------------------------------------- in a task


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced distinct rows; at most ``k`` centroids."""
    start = np.unique(x, axis=0)
    start = start[np.random.default_rng(0).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = nearest(x, start)
        n = np.bincount(near, minlength=len(start))
        full = np.flatnonzero(n)  # a centroid without rows stays where it is
        sums = np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(n) - n)[full])
        start[full] = sums / n[full, None]
    return start


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row."""
    half = (book ** 2).sum(axis=1) / 2
    return np.concatenate([(half - x[s:s + 4096] @ book.T).argmin(axis=1)
                           for s in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def cells_of(v: np.ndarray, index: Index) -> np.ndarray:
    cut = index.books[0].shape[1]
    return nearest(v[:, :cut], index.books[0]) * len(index.books[1]) + nearest(v[:, cut:], index.books[1])


def half_distances(q: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of one query's halves to the centroids; the same bits
    wherever they are computed."""
    a, b = index.books
    cut = a.shape[1]
    return ((a - q[:cut]) ** 2).sum(axis=1), ((b - q[cut:]) ** 2).sum(axis=1)


def walk(q: np.ndarray, index: Index, visit: int) -> tuple[np.ndarray, float]:
    """Cells in the order of summed half distances until they hold ``visit`` rows,
    and the last sum."""
    da, db = half_distances(q, index)
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    sa, sb = da[oa].tolist(), db[ob].tolist()
    na, nb = len(sa), len(sb)
    rows = index.counts.reshape(na, nb)[np.ix_(oa, ob)].tolist()
    heap, held, last = [(sa[0] + sb[0], 0, 0)], 0, 0.0
    taken = [0] * na  # pairs of each first centroid that are out; they leave in order
    cells = []
    while heap and held < visit:
        last, i, j = heapq.heappop(heap)
        held += rows[i][j]
        cells.append((i, j))
        taken[i] = j + 1
        if i + 1 < na and taken[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j + 1 < nb and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
    at = np.array(cells, np.int64)
    return oa[at[:, 0]] * nb + ob[at[:, 1]], last


def top_exact(ids: np.ndarray, v: np.ndarray, own: int, q: np.ndarray, rough: np.ndarray, k: int
              ) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the ``k`` rows nearest to ``q``, ties to the
    smaller id.

    ``rough`` are squared distances up to rounding (infinite: not a candidate);
    whatever may be among the nearest by them is measured exactly.
    """
    rough = np.where(ids == own, np.inf, rough)
    may = np.flatnonzero(np.isfinite(rough))
    if len(may) > k:
        scale = float((q ** 2).sum() + (v[may] ** 2).sum(axis=1).max())
        may = may[rough[may] <= np.partition(rough[may], k - 1)[k - 1] + 1e-9 * scale]
    dist = np.sqrt(((v[may] - q) ** 2).sum(axis=1))
    first = np.lexsort((ids[may], dist))[:k]
    return may[first], dist[first]


def rerank(k: int, shared):
    """Work of one (block, chunk): each query against the entries of its walked cells
    (``shared``: the broadcast index)."""
    def work(entries: pa.Table, queries: pa.Table) -> pa.Table:
        index, out = shared.value, []
        if entries.num_rows and queries.num_rows:
            ids, cell = entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
            v = matrix(entries["vec"], index.dims)
            qs, own, reach = (matrix(queries["vec"], index.dims), queries["query_id"].to_numpy(),
                              queries["reach"].to_numpy())
            ca, cb = np.divmod(cell, len(index.books[1]))
            squares = (v ** 2).sum(axis=1)
            for s in range(0, len(qs), SLICE):
                part = qs[s:s + SLICE]
                rough = squares + (part ** 2).sum(axis=1)[:, None] - 2 * part @ v.T
                for r, q in enumerate(part):
                    da, db = half_distances(q, index)
                    rough[r, da[ca] + db[cb] > reach[s + r] * (1 + 1e-12)] = np.inf
                    at, dist = top_exact(ids, v, own[s + r], q, rough[r], k)
                    out.append((np.full(len(at), own[s + r]), ids[at], dist))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    return work


# ---------------------------------------------------------------- on Spark


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec of the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"))
    return rows.filter(F.col("vec_id").isNotNull() & finite("vec") & F.exists("vec", lambda x: x != 0))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query; ranks are limited before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit(rows: DataFrame, dims: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two codebooks, from at most ``FIT_VALUES`` components."""
    most = max(1, FIT_VALUES // dims)
    share = min(1.0, 1.2 * most / n)
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    sample = (rows.withColumn("_h", hashed).filter(F.col("_h") < int(share * (1 << 40)))
              .orderBy("_h", "vec_id", "vec").limit(most).select("vec").toArrow())
    v = matrix(sample["vec"], dims)
    k = int(np.clip(np.sqrt(n / CELL_ROWS), 1, MOST_CENTROIDS))
    cut = (dims + 1) // 2
    return kmeans(v[:, :cut], k), kmeans(v[:, cut:], k)


def build(rows: DataFrame, dims: int, n: int) -> tuple[Index, DataFrame]:
    """The index over all ``rows`` and its stored entries (block, cell, vec_id, vec)."""
    a, b = fit(rows, dims, n)
    bare = Index(dims, (a, b), *[np.zeros(len(a) * len(b), np.int64)] * 3)
    shared = rows.sparkSession.sparkContext.broadcast(bare)  # at most FIT_VALUES numbers

    def place(batches):
        for batch in sliced(batches, dims):
            cell = cells_of(matrix(batch.column(1), dims), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)],
                                             names=["vec_id", "vec", "cell"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = staged(rows.mapInArrow(place, f"vec_id long, vec {kind}, cell long"), "cells")
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # k * k at most
    counts = np.zeros(len(a) * len(b), np.int64)
    counts[held["cell"].to_numpy()] = held["n"].to_numpy()
    first, blocks = laid_out(counts, rows_of(BLOCK_VALUES, dims))
    index = Index(dims, (a, b), counts, first, blocks)
    where = rows.sparkSession.createDataFrame(
        [(int(c), int(first[c]), int(blocks[c])) for c in np.flatnonzero(counts)],
        "cell long, first long, blocks long")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "vec"), F.col("blocks"))
    return index, placed.join(F.broadcast(where), "cell").select(block.alias("block"), "cell", "vec_id", "vec")


def laid_out(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbours share a block
    while they fit; a larger cell has blocks of its own."""
    first, blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, held = 0, 0
    for c, n in enumerate(counts.tolist()):
        if held + n > most and held:
            at, held = at + 1, 0
        first[c] = at
        if n > most:
            blocks[c] = -(-n // most)
            at, held = at + int(blocks[c]), 0
        else:
            held += n
    return first, blocks


def needed(index: Index, rows: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """How many rows a walk must hold to reach ``recall`` of the true neighbours of
    at most ``PROBES`` queries, found among all rows."""
    probes = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return 1
    own, qs = probes["query_id"].to_numpy(), matrix(probes["vec"], index.dims)
    shared = rows.sparkSession.sparkContext.broadcast((own, qs))

    def scan(batches):
        own, qs = shared.value
        for batch in sliced(batches, index.dims):
            ids, v = batch.column(0).to_numpy(), matrix(batch.column(1), index.dims)
            rough = (v ** 2).sum(axis=1) + (qs ** 2).sum(axis=1)[:, None] - 2 * qs @ v.T
            tops = [top_exact(ids, v, o, q, r, k) for o, q, r in zip(own, qs, rough, strict=True)]
            at = np.concatenate([t for t, _ in tops])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, [len(t) for t, _ in tops])), pa.array(ids[at]),
                 pa.array(np.concatenate([d for _, d in tops])), batch.column(1).take(pa.array(at))],
                names=["query_id", "vec_id", "score", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    truth = best(rows.select("vec_id", "vec").mapInArrow(scan, f"{FOUND}, vec {kind}"), k).toArrow()
    if not truth.num_rows:
        return 1
    cell = cells_of(matrix(truth["vec"], index.dims), index)
    asked = truth["query_id"].to_numpy()
    deep = []
    for o, q in zip(own, qs, strict=True):
        da, db = half_distances(q, index)
        sums = (da[:, None] + db[None]).ravel()
        order = np.argsort(sums, kind="stable")
        upto = np.cumsum(index.counts[order])
        place = np.searchsorted(sums[order], sums[cell[asked == o]], side="right") - 1
        deep.append(upto[place])
    deep = np.sort(np.concatenate(deep))
    return int(deep[min(len(deep) - 1, int(np.ceil(recall * (len(deep) + 1))) - 1)])


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to each row where ``is_query`` (a condition on the id,
    named ``vec_id``) holds: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = df.sparkSession
    all_rows = usable(df, id_col, vec_col)
    dims, n = common_length(all_rows, "vec")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = all_rows.filter(F.size("vec") == dims)
    index, entries = build(rows, dims, n)
    queries = (entries.filter(is_query).groupBy(F.col("vec_id").alias("query_id"))
               .agg(F.min("vec").alias("vec")))
    visit = max(k + 1, needed(index, entries, queries, k, recall))
    shared = spark.sparkContext.broadcast(index)

    def route(batches):
        index = shared.value
        for batch in batches:
            at, reach, blocks = [], [], []
            for r, q in enumerate(matrix(batch.column(1), dims)):
                cells, last = walk(q, index, visit)
                cells = cells[index.counts[cells] > 0]
                mine = np.unique(np.concatenate([np.arange(index.first[c], index.first[c] + index.blocks[c])
                                                 if index.blocks[c] > 1 else index.first[c:c + 1]
                                                 for c in cells]))
                at.append(np.full(len(mine), r))
                reach.append(np.full(len(mine), last))
                blocks.append(mine)
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in range(3)), pa.array(np.concatenate(reach)),
                     pa.array(np.concatenate(blocks))], names=["query_id", "vec", "chunk", "reach", "block"])

    kind = rows.schema["vec"].dataType.simpleString()
    n_queries = queries.count()
    asked = (queries.withColumn("chunk", chunk_of("query_id", n_queries, dims))
             .repartition(-(-n_queries // WALKS) or 1, "query_id"))
    routed = staged(asked.mapInArrow(
        route, f"query_id long, vec {kind}, chunk int, reach double, block long"), "walks")
    found = meet(entries, routed, rerank(k, shared), FOUND)
    return best(found, k).select("query_id", "rank", "vec_id", "score")
