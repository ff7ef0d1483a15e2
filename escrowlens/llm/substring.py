"""Substring dedup by difference-cover anchors (operator 8).

A window is ``WINDOW`` consecutive words.  Every word under a window whose word
sequence starts anywhere else as well, in any document, is removed.

* Positions are numbered from the start of each document.  ``COVER`` holds, for
  every difference modulo ``PERIOD``, two members with that difference, so for
  any two equal windows some shift below ``PERIOD`` brings both starts to cover
  positions.  Anchors are the runs of ``WINDOW - PERIOD + 1`` words at cover
  positions; two equal windows share at least one aligned anchor.  Only 5 of 21
  positions are hashed and shuffled.
* Anchors met once are done.  Around every repeated anchor all windows that
  contain it are hashed (the extension); windows whose hash occurs twice are
  the repeated ones, counted on the input as it is.
* Of identical texts one stands for all in this search; if such a text has a
  whole window, all of it is repeated.

Counts are aggregated map-side, so a passage that very many documents share is
one row per task; positions come back through joins that the adaptive skew join
can split.  Texts without a repeated anchor are never shuffled.  Text identity
and windows are 128-bit hashes, anchors (which only propose) 64-bit ones.

Defined results
* a null text has no words; texts shorter than a window keep all words; the
  kept words are joined by one space;
* repeated rows are copies of each other; a window that overlaps its own repeat
  counts (a text of one word said 36 times goes);
* doc_id is carried, never used as a key, so null or repeated ids do no harm;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import bit_table, bounded_batches, maybe_in, staged
from escrowlens.llm.shingles import window_hashes, word_hashes, word_list

WINDOW = 35
# A perfect difference set modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_SECOND = 0xC2B2AE3D27D4EB4F
TABLE_BITS = 24  # at most 262,144 broadcast rows
DOCS_AT_ONCE = 100


def covers(period: int, cover: tuple[int, ...]) -> bool:
    """Whether every difference modulo ``period`` occurs between two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def anchor_places(n_words: int, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Cover positions at which a whole anchor fits."""
    place = np.arange(max(0, n_words - (window - period)))
    return place[np.isin(place % period, cover)] if n_words >= window else place[:0]


def _anchors(texts: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """h (anchor hash), t1 (text), pos."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                names, hs, ps = part.column(0).to_numpy(), [], []
                for text in part.column(1):
                    words = word_list(text.as_py(), lower=False)
                    place = anchor_places(len(words), window, period, cover)
                    if len(place):
                        hs.append(window_hashes(word_hashes(words), window - period + 1)[place])
                    else:
                        hs.append(np.empty(0, np.uint64))
                    ps.append(place)
                each = [len(p) for p in ps]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(names, each)),
                     pa.array(np.concatenate(ps).astype(np.int32))], names=["h", "t1", "pos"])

    return texts.select("t1", "text").mapInArrow(run, "h long, t1 long, pos int")


def _windows(texts: DataFrame, window: int, period: int) -> DataFrame:
    """t1, t2, pos, g1, g2 (arrays): the windows around the anchors at ``hits``."""
    reach = window - (window - period + 1)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                out = [[], [], []]
                for text, hits in zip(part.column("text"), part.column("hits"), strict=True):
                    words = word_hashes(word_list(text.as_py(), lower=False))
                    q = hits.values.to_numpy()
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.maximum(q - reach, 0), 1)
                    np.add.at(change, np.minimum(q + 1, len(words)), -1)
                    near = np.cumsum(change[:max(0, len(words) - window + 1)])
                    pos = np.flatnonzero(near)
                    out[0].append(pos.astype(np.int32))
                    out[1].append(window_hashes(words, window)[pos].view(np.int64))
                    out[2].append(window_hashes(words, window, _SECOND)[pos].view(np.int64))
                ends = pa.array(np.cumsum([0] + [len(p) for p in out[0]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in out]
                yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), *lists],
                                                 names=["t1", "t2", "pos", "g1", "g2"])

    return texts.select("t1", "t2", "text", "hits").mapInArrow(
        run, "t1 long, t2 long, pos array<int>, g1 array<long>, g2 array<long>")


def _rebuilt(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept from text, starts (or null) and copies."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                size, gone, kept = [], [], []
                cols = (part.column(c) for c in ("text", "starts", "copied"))
                for text, starts, copied in zip(*cols, strict=True):
                    words = word_list(text.as_py(), lower=False)
                    n = len(words)
                    size.append(n)
                    if copied.as_py() and n >= window:
                        words = []
                    elif starts.is_valid:
                        change = np.zeros(n + 1, np.int64)
                        s = starts.values.to_numpy()
                        np.add.at(change, s, 1)
                        np.add.at(change, s + window, -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:n]) == 0)]
                    gone.append(n - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return (rows.select("doc_id", "text", "starts", "copied")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD,
                   cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text)."""
    if not covers(period, cover) or period > window:
        raise ValueError("cover must have every difference modulo a period of at most one window")
    bounded_batches(docs.sparkSession)
    key = ["t1", "t2"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    copies = staged(base.groupBy(*key).count().filter("count > 1").select(*key), "sub-copies")
    flagged = maybe_in(base, bit_table(copies, key, TABLE_BITS), key, TABLE_BITS, "_maybe")
    once = staged(flagged.filter("_maybe").select(*key, "text").dropDuplicates(key), "sub-once")
    texts = flagged.filter("not _maybe").select(*key, "text").unionByName(once)

    anchors = _anchors(texts, window, period, cover)
    again = staged(anchors.groupBy("h").count().filter("count > 1").select("h"), "sub-anchors")
    some = maybe_in(anchors, bit_table(again, ["h"], TABLE_BITS), ["h"], TABLE_BITS, "_maybe")
    hits = staged(some.filter("_maybe").drop("_maybe").join(again, "h")
                  .groupBy("t1").agg(F.collect_list("pos").alias("hits")), "sub-hits")  # by text
    near = maybe_in(texts, bit_table(hits, ["t1"], TABLE_BITS), ["t1"], TABLE_BITS, "_maybe")
    windows = staged(_windows(near.filter("_maybe").join(hits, "t1"), window, period), "sub-windows")

    each = windows.select(*key, F.explode(F.arrays_zip("pos", "g1", "g2")).alias("w")).select(*key, "w.*")
    twice = staged(each.groupBy("g1", "g2").count().filter("count > 1").select("g1", "g2"), "sub-twice")
    found = maybe_in(each, bit_table(twice, ["g1", "g2"], TABLE_BITS), ["g1", "g2"], TABLE_BITS, "_maybe")
    starts = staged(found.filter("_maybe").drop("_maybe").join(twice, ["g1", "g2"])
                    .groupBy(*key).agg(F.collect_list("pos").alias("starts")), "sub-starts")  # by text

    touched = starts.select(*key).unionByName(copies)
    marked = maybe_in(base, bit_table(touched, key, TABLE_BITS), key, TABLE_BITS, "_maybe")
    changed = (marked.filter("_maybe").join(starts, key, "left")
               .join(copies.withColumn("copied", F.lit(True)), key, "left"))
    same = marked.filter("not _maybe").withColumns(
        {"starts": F.lit(None).cast("array<int>"), "copied": F.lit(None).cast("boolean")})
    return _rebuilt(changed, window).unionByName(_rebuilt(same, window))
