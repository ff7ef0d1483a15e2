"""Hard-negative mining over Hilbert-ordered blocks with zone maps (operator 12).

Rows are sorted by (label, Hilbert index, id) and written as Parquet in blocks of at
most ``BLOCK_VALUES`` components; rows close on the curve are close in space, so a
block is narrow in every dimension.  The Hilbert index takes the ``CURVE_DIMS``
dimensions of largest variance with ``CURVE_BITS`` bits each.  Each block has a zone
map: smallest and largest component per dimension, and smallest and largest label.

An anchor asks for windows of scores: rows of the same (or another) label whose
integer inner product with it lies in [lo, hi], the ``k`` highest.  Interval
arithmetic over a zone map gives the least and the largest inner product that a
block can hold: per dimension the smaller and the larger of the anchor's
component times the two ends.  A block is read for a window only if that interval
meets [lo, hi] and its labels admit it.  Each anchor first reads one block, its
likeliest (where the upper bound is highest); the k-th score found there raises lo,
and the second round reads only blocks that may still hold a better row.
So nothing is lost: the result is exact whatever the bounds let through.

Positives are one window, [-inf, inf] over the same label; each positive makes one
window over the other labels.

Anchors, zone maps and blocks meet in work items of bounded size
(``vectors.meet``); zone maps are a table, not a broadcast.

Scores are exact: products are computed in float64 where every sum is below
2^53, else in 64-bit integers, else in Python integers, and a score beyond a bigint
becomes the nearest bigint.  Components beyond a bigint likewise.

Defined results
* vectors that are null, empty or hold null, NaN or infinite components take no
  part, nor do rows with a null id or a null label, nor vectors of another length
  than the most frequent one (of equally frequent lengths, the larger); zero
  vectors do take part, with score 0;
* rows that share the anchor's id are its own row and no positive or negative of
  it; several anchor rows of one id are one anchor, with the smallest (label,
  vector) of them; other rows that repeat an id are rows each, so a positive that
  occurs twice has two windows;
* ties go to the smaller id; an anchor without positives gives no rows, nor does a
  positive whose window is empty (its score is negative);
* an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from escrowlens.llm.common import staged
from escrowlens.llm.vectors import (BLOCK_VALUES, chunk_of, common_length, finite, matrix, meet,
                                    rows_of, sliced)

CURVE_DIMS, CURVE_BITS = 12, 5  # 60 bits
ZONES_PER_PACK = 512
LEAST, MOST = -2 ** 63, 2 ** 63 - 1
SLICE = 256  # anchors scored side by side
WINDOWS = "array<struct<window: long, lo: long, hi: long>>"
FOUND = "anchor_id long, window long, vec_id long, score long"


# ---------------------------------------------------------------- in a task


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (one per row, ``bits`` bits a
    dimension; dimensions times bits at most 62).

    By Gray code in axes order: from the top bit down, a set bit of a dimension
    inverts the lower bits of the first one, a clear bit exchanges them with it;
    the transposed bits are then Gray-decoded and interleaved.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(n):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def largest(m: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of ``a`` and ``b``, exact; beyond a
    bigint, the nearest bigint."""
    bound = largest(a) * largest(b) * a.shape[1]
    if bound < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound <= MOST:
        return a @ b.T
    return nearest_bigint(a.astype(object) @ b.astype(object).T)


def nearest_bigint(wide: np.ndarray) -> np.ndarray:
    return np.clip(wide, LEAST, MOST).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any point of each
    box [low, high]: the sum over dimensions of the ends of ``a_d * [low_d, high_d]``."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    if largest(a) * max(largest(low), largest(high)) * a.shape[1] > MOST // 2:
        plus, minus, low, high = (x.astype(object) for x in (plus, minus, low, high))
        return (nearest_bigint(plus @ low.T + minus @ high.T), nearest_bigint(plus @ high.T + minus @ low.T))
    return (products(plus, low) + products(minus, high), products(plus, high) + products(minus, low))


def windows_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """A column of windows laid flat: the row of each, and (window, lo, hi)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(len(column)), sizes),
            [c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten()])


def choose(dims: int, same: bool, only_best: bool):
    """Work of one (zone pack, chunk): the blocks that each anchor has to read, with
    the windows that need them; or its likeliest block alone."""
    def work(zones: pa.Table, anchors: pa.Table) -> pa.Table:
        n = anchors.num_rows
        low, high = (matrix(zones[c], dims, np.int64) for c in ("low", "high"))
        least, most = bounds(matrix(anchors["vec"], dims, np.int64), low, high)
        label = anchors["label"].to_numpy()[:, None]
        first, last = zones["first_label"].to_numpy(), zones["last_label"].to_numpy()
        fits = (first <= label) & (label <= last) if same else (first < label) | (label < last)
        row, (window, lo, hi) = windows_of(anchors["windows"])
        need = fits[row] & (most[row] >= lo[:, None]) & (least[row] <= hi[:, None])
        if only_best and n:  # one block an anchor: the highest bound that any of its windows needs
            firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            of_any = np.logical_or.reduceat(need, firsts)
            top = np.where(of_any, most[row[firsts]], LEAST).argmax(axis=1)
            need &= (np.arange(zones.num_rows) == top[:, None])[np.repeat(
                np.arange(len(firsts)), np.diff(np.append(firsts, len(row))))]
        wanted, block_of = np.nonzero(need)  # flat window, zone
        order = np.lexsort((wanted, block_of, row[wanted]))
        wanted, block_of = wanted[order], block_of[order]
        owner = row[wanted]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block_of[1:] != block_of[:-1])
        starts = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(starts, len(owner)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(x[wanted]) for x in (window, lo, hi)], ["window", "lo", "hi"]))
        kept, zone = owner[starts], block_of[starts]
        take = pa.array(kept)
        return pa.table({
            "anchor_id": anchors["anchor_id"].take(take), "label": anchors["label"].take(take),
            "vec": anchors["vec"].take(take), "chunk": anchors["chunk"].take(take), "windows": lists,
            "block": zones["block"].take(pa.array(zone)), "bound": pa.array(most[kept, zone])})
    return work


def score(dims: int, same: bool, k: int):
    """Work of one (block, chunk): the ``k`` highest of each anchor's windows."""
    def work(entries: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, label = entries["vec_id"].to_numpy(), entries["label"].to_numpy()
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, label = ids[order], label[order]
        v = matrix(entries["vec"], dims, np.int64)[order]
        out = []
        for s in range(0, anchors.num_rows, SLICE):
            part = anchors.slice(s, SLICE)
            own, wanted = part["anchor_id"].to_numpy(), part["label"].to_numpy()
            got = products(matrix(part["vec"], dims, np.int64), v)
            fits = ((label == wanted[:, None]) == same) & (ids != own[:, None])
            row, spans = windows_of(part["windows"])
            for r, window, lo, hi in zip(row.tolist(), *(x.tolist() for x in spans), strict=True):
                may = np.flatnonzero(fits[r] & (got[r] >= lo) & (got[r] <= hi))
                if len(may) > k:  # all that tie with the k-th stay until the sort
                    may = may[got[r, may] >= np.partition(got[r, may], -k)[-k]]
                best = may[np.lexsort((ids[may], ~got[r, may]))][:k]  # ~x falls as x rises
                out.append((np.full(len(best), own[r]), np.full(len(best), window), ids[best], got[r, best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in
                         zip(("anchor_id", "window", "vec_id", "score"), cols, strict=True)})
    return work


# ---------------------------------------------------------------- on Spark


def quantised(df: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label",
              vec_col: str = "embedding") -> DataFrame:
    """vec_id, label, vec of the rows that take part: floor(scale * x) of each component."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vec_col}`").alias("vec")).filter(finite("vec"))
    return usable(rows.withColumn("vec", F.transform("vec", lambda x: F.floor(scale * x.cast("double")))))


def usable(rows: DataFrame) -> DataFrame:
    """The rows of (vec_id, label, vec of integers) that take part, as bigints."""
    whole = F.coalesce(F.forall("vec", lambda x: x.isNotNull()) & (F.size("vec") > 0), F.lit(False))
    return (rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
            .select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                    F.col("vec").cast("array<bigint>")))


def widest(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CURVE_DIMS dimensions of largest spread, their means and deviations."""
    def sums(batches):
        for batch in sliced(batches, dims):
            x = matrix(batch.column(0), dims)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array(np.full(dims, float(len(x)))), pa.array(x.sum(axis=0)),
                 pa.array((x ** 2).sum(axis=0))], names=["d", "n", "s", "q"])

    mean = F.sum("s") / F.sum("n")
    found = (rows.select("vec").mapInArrow(sums, "d long, n double, s double, q double").groupBy("d")
             .agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("sd"))
             .orderBy(F.desc("sd"), "d").limit(CURVE_DIMS).toArrow())  # at most CURVE_DIMS rows
    return tuple(found[c].to_numpy() for c in ("d", "mean", "sd"))


def blocks_of(rows: DataFrame, dims: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Entries (block, vec_id, label, vec) in Hilbert order, as Parquet, and the zone
    maps (block, first_label, last_label, low, high)."""
    most = rows_of(BLOCK_VALUES, dims)
    axes, mean, sd = widest(rows, dims)

    def index(batches):
        for batch in sliced(batches, dims):
            x = matrix(batch.column(2), dims)[:, axes]
            grid = np.floor(((x - mean) / np.maximum(sd, 1e-300) / 6 + 0.5) * (1 << CURVE_BITS))
            place = hilbert(np.clip(np.nan_to_num(grid), 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)],
                                             names=["vec_id", "label", "vec", "curve"])

    def number(batches):
        # Blocks of one task's range, in order; never more than ``most`` rows each.
        from pyspark import TaskContext
        seen, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            at = base + (seen + np.arange(batch.num_rows)) // most
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns],
                                             names=["block", "vec_id", "label", "vec"])

    tasks = min(-(-n // most), max(200, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    order = ["label", "curve", "vec_id"]
    kind = "vec_id long, label long, vec array<bigint>"
    entries = staged(
        rows.mapInArrow(index, kind + ", curve long").repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order).drop("curve").mapInArrow(number, "block long, " + kind), "hilbert-blocks")

    def box(block, label, low, high):
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([label.min()]), pa.array([label.max()]), pa.array([low.min(axis=0)]),
             pa.array([high.max(axis=0)])], names=["block", "first_label", "last_label", "low", "high"])

    def zone(batches):  # of what a batch holds of each block
        for batch in sliced(batches, dims):
            block, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = matrix(batch.column(2), dims, np.int64)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for s, e in zip(starts, [*starts[1:], len(block)], strict=True):
                yield box(block[s], label[s:e], v[s:e], v[s:e])

    def whole(parts):
        label = np.concatenate([parts["first_label"].to_numpy(), parts["last_label"].to_numpy()])
        low, high = (matrix(parts[c], dims, np.int64) for c in ("low", "high"))
        return pa.Table.from_batches([box(parts["block"][0].as_py(), label, low, high)])

    ends = "block long, first_label long, last_label long, low array<bigint>, high array<bigint>"
    zones = (entries.select("block", "label", "vec").mapInArrow(zone, ends).groupBy("block")
             .applyInArrow(whole, ends))
    return entries, staged(zones, "zones")


def round_of(entries: DataFrame, zones: DataFrame, anchors: DataFrame, dims: int, same: bool, k: int,
             only_best: bool) -> DataFrame:
    """The best rows of each window among the blocks that the anchors have to read."""
    packs = -(-zones.count() // ZONES_PER_PACK)
    pack = F.pmod(F.xxhash64("block"), F.lit(packs))
    shape = (f"anchor_id long, label long, vec array<bigint>, chunk int, windows {WINDOWS}, "
             "block long, bound long")
    asked = anchors.withColumn("block", F.explode(F.expr(f"sequence(0L, {packs - 1}L)")))
    boxes = zones.withColumn("zone", F.col("block")).withColumn("block", pack)
    routed = meet(boxes, asked, _renamed(choose(dims, same, only_best)), shape)
    if only_best and packs > 1:
        routed = (routed.groupBy("anchor_id").agg(F.max_by(F.struct("*"), F.struct("bound", "block")).alias("r"))
                  .select("r.*"))
    routed = staged(routed.drop("bound"), "reads")
    return best(meet(entries, routed, score(dims, same, k), FOUND), k)


def _renamed(work):
    """``meet`` joins by ``block``; for zone maps that is the pack."""
    return lambda zones, anchors: work(zones.rename_columns(
        ["block" if c == "zone" else c for c in zones.column_names]), anchors)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest of each window; ranks are limited before the shuffle."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(entries: DataFrame, zones: DataFrame, anchors: DataFrame, dims: int, same: bool, k: int
             ) -> DataFrame:
    """The ``k`` highest rows of each window (anchor_id, window, vec_id, score, rank)."""
    seed = round_of(entries, zones, anchors, dims, same, k, only_best=True)
    floors = (seed.filter(F.col("rank") == k).groupBy("anchor_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_floor")))
    raised = F.transform("windows", lambda w: F.struct(
        w["window"].alias("window"),
        F.greatest(w["lo"], F.coalesce(F.col("_floor")[w["window"]], w["lo"])).alias("lo"),
        w["hi"].alias("hi")))
    anchors = anchors.join(floors, "anchor_id", "left").withColumn("windows", raised).drop("_floor")
    return round_of(entries, zones, anchors, dims, same, k, only_best=False)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor (a row of (vec_id, label, vec) where ``is_anchor`` holds) and
    each of its first ``positives`` other rows of its label by inner product: the first
    ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
    percent of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``vec`` holds integers (array<bigint>).
    """
    spark = rows.sparkSession
    all_rows = usable(rows)
    dims, n = common_length(all_rows, "vec")
    shape = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
             "negative_score long")
    if not n:
        return spark.createDataFrame([], shape)
    entries, zones = blocks_of(all_rows.filter(F.size("vec") == dims), dims, n)
    picked = (entries.filter(is_anchor).groupBy(F.col("vec_id").alias("anchor_id"))
              .agg(F.min(F.struct("label", "vec")).alias("_r")).select("anchor_id", "_r.label", "_r.vec"))
    picked = picked.withColumn("chunk", chunk_of("anchor_id", picked.count(), dims))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(LEAST).cast("long").alias("lo"),
                             F.lit(MOST).cast("long").alias("hi")))
    near = staged(searched(entries, zones, picked.withColumn("windows", whole), dims, True, positives)
                  .select("anchor_id", F.col("rank").cast("long").alias("window"),
                          F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                  "positives")
    wide = F.col("positive_score").cast("decimal(38,0)")
    lo, hi = (wide * low / 100).cast("decimal(38,2)"), (wide * high / 100).cast("decimal(38,2)")
    spans = (near.filter("positive_score >= 0")
             .select("anchor_id", F.struct("window", F.ceil(lo).cast("long").alias("lo"),
                                           F.floor(hi).cast("long").alias("hi")).alias("w"))
             .groupBy("anchor_id").agg(F.collect_list("w").alias("windows")))
    found = searched(entries, zones, picked.join(spans, "anchor_id"), dims, False, negatives)
    return (found.join(near, ["anchor_id", "window"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
