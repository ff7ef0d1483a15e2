"""Line dedup by content-defined chunks (operator 3).

A text is cut at line feeds.  Two kinds of chunks are compared, and both depend on
their own lines alone and not on their place in the text:

* the finest: every ``LEAST_LINES`` consecutive lines.  A repeated run of that many
  lines or more is covered by them from end to end, wherever it begins and ends;
* coarser ones, for the inside of stretches of blank lines, which the finest leave
  out: a rolling hash over the hashes of the last ``ROLL`` lines ends a chunk where it
  is 0 modulo ``EVERY``.  Only texts with ``LEAST_LINES`` blank lines in a row are cut.

Chunks that occur more than once in the table are removed wherever they occur but
once: the occurrence in the smallest ``doc_id`` (and there the earliest) stays.  A
line goes if any chunk over it goes, so the lines of a run go where each
``LEAST_LINES`` of them occur before; the first occurrence of a line always stays.

Chunk hashes are counted first, aggregated map-side; only chunks whose hash
occurs twice go on.  They are grouped by a 128-bit hash, and the smallest and largest
bytes of a group are compared, aggregated map-side too: that is the byte comparison.
Where they are equal the hash stands for the bytes from there on, and only hashes and
places travel; the chunks of a group with different bytes are grouped by their bytes.

Defined results
* a null text has no lines, stays null and loses nothing; an empty text has one
  empty line; the other lines are joined by line feeds again, and a text that
  loses all its lines becomes empty;
* chunks of blank lines only are never removed;
* a run of one line over and over keeps its first line;
* of rows with the same ``doc_id``, null last, the order of their texts decides;
  rows equal in both come out alike: their chunks count, and where the first
  occurrence is theirs it stays in each;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import bit_table, looked_up, maybe_in, staged
from escrowlens.llm.shingles import window_hashes

ROLL, EVERY, LEAST_LINES = 2, 4, 2
TABLE_BITS = 22  # at most 65,536 broadcast rows
DOCS_AT_ONCE = 200
HELD_BYTES = 8_000_000  # of chunks that a task holds at once


def chunk_ends(lines: list[bytes], roll: int = ROLL, every: int = EVERY) -> list[int]:
    """Ends (exclusive) of the coarser chunks of a list of lines."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    rolled = window_hashes(hashes, roll)
    ends = (np.flatnonzero(rolled % np.uint64(every) == 0) + roll).tolist()
    return ends if ends and ends[-1] == len(lines) else [*ends, len(lines)]


def chunks(text: str | None, roll: int, every: int, least: int) -> list[tuple[int, int, bytes]]:
    """First line, lines and bytes of the chunks that may be removed."""
    if text is None:
        return []
    lines = text.encode().split(b"\n")
    found = [(a, least, b"\n".join(lines[a:a + least])) for a in range(len(lines) - least + 1)]
    empty = {a for a, _, raw in found if not raw.strip()}
    if not empty:
        return found
    ends = chunk_ends(lines, roll, every)
    blank = np.zeros(len(lines) + 1, np.int64)
    blank[[a + 1 for a in empty]] = 1
    blank = np.cumsum(blank)  # all-blank finest chunks before each line
    found += [(a, b - a, b"\n".join(lines[a:b])) for a, b in zip([0, *ends], ends)
              if b - a > least and blank[b - least + 1] > blank[a]]
    return [c for c in found if c[2].strip()]


def _key(raw: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)


def _chunk_keys(rows: DataFrame, roll: int, every: int, least: int) -> DataFrame:
    """h of every chunk."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                keys = [_key(raw) for text in batch.slice(at, DOCS_AT_ONCE).column(0).to_pylist()
                        for _, _, raw in chunks(text, roll, every, least)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["h"])

    return rows.select("text").mapInArrow(run, "h long")


def _chunk_rows(rows: DataFrame, roll: int, every: int, least: int, with_bytes: bool) -> DataFrame:
    """h, h2, t1, t2 (text), doc_id, line, n (lines) of every chunk, and raw (its bytes)."""
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary()]
    names = ["h", "h2", "t1", "t2", "doc_id", "line", "n", "raw"]
    width = len(names) if with_bytes else len(names) - 1

    def made(out):
        cols = zip(*out, strict=True) if out else [()] * width
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(cols, kinds[:width], strict=True)], names=names[:width])

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for at in range(0, len(batch), DOCS_AT_ONCE):
                for t1, t2, doc_id, text in zip(*(c.to_pylist() for c in
                                                  batch.slice(at, DOCS_AT_ONCE).columns), strict=True):
                    for line, n, raw in chunks(text, roll, every, least):
                        out.append((_key(raw), _key(raw, 1), t1, t2, doc_id, line, n, raw)[:width])
                        held += len(raw) if with_bytes else 100
                        if held > HELD_BYTES:
                            yield made(out)
                            out, held = [], 0
            yield made(out)

    shape = "h long, h2 long, t1 long, t2 long, doc_id long, line int, n int"
    return rows.select("t1", "t2", "doc_id", "text").mapInArrow(run, shape + (", raw binary" if with_bytes else ""))


def _without_chunks(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text from the text and the chunks to remove."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                size, gone, texts = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines = [] if text is None else text.encode().split(b"\n")
                    kept = lines
                    if found:
                        keep = np.ones(len(lines), bool)
                        for c in found:
                            keep[c["line"]:c["line"] + c["n"]] = False
                        kept = [lines[k] for k in np.flatnonzero(keep).tolist()]
                    size.append(len(lines))
                    gone.append(len(lines) - len(kept))
                    texts.append(None if text is None else b"\n".join(kept).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])

    return rows.select("doc_id", "text", "found").mapInArrow(
        run, "doc_id long, n_lines long, n_removed long, text string")


def line_dedup(docs: DataFrame, roll: int = ROLL, every: int = EVERY,
               least: int = LEAST_LINES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    twice = staged(_chunk_keys(base, roll, every, least).groupBy("h").count().filter("count > 1").select("h"), "line-twice")
    table = bit_table(twice, ["h"], TABLE_BITS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "line")

    def candidates(with_bytes):
        rows = _chunk_rows(base, roll, every, least, with_bytes)
        return maybe_in(rows, table, ["h"], TABLE_BITS, "_maybe").filter("_maybe").drop("_maybe")

    # the byte comparison: the ends of each group's bytes
    first = staged(candidates(True).groupBy("h", "h2").agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("raw").alias("_low"),
        F.max("raw").alias("_high")).filter("_n > 1")
        .select("h", "h2", "_first", (F.col("_low") == F.col("_high")).alias("_same")), "line-first")

    def repeats(found, first, keys):
        return (found.join(first, keys).filter(~place.eqNullSafe(F.col("_first")))
                .select("doc_id", "t1", "t2", "line", "n").distinct())

    gone = repeats(candidates(False), first.filter("_same"), ["h", "h2"])
    mixed = first.filter("not _same").select("h", "h2")
    if not mixed.isEmpty():  # equal hashes, different bytes
        found = candidates(True).join(mixed, ["h", "h2"], "left_semi")
        firsts = (found.groupBy("h", "h2", "raw").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
                  .filter("_n > 1").drop("_n"))
        gone = gone.unionByName(repeats(found, firsts, ["h", "h2", "raw"])).distinct()
    gone = staged(gone.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"),
                               "t1", "t2").agg(F.collect_list(F.struct("line", "n")).alias("found")), "line-gone")  # by text
    keyed = base.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    return _without_chunks(looked_up(keyed, gone, ["_id", "_none", "t1", "t2"], TABLE_BITS))
