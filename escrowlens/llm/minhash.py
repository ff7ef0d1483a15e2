"""MinHash near-dedup with sequential Bayesian verification (operator 1).

Documents are sets of distinct five-word shingles of their lower-cased words;
two are linked if 100 * intersection >= 75 * union.

1. Every document gets ``BANDS`` band keys of ``BAND_ROWS`` MinHash values.  At
   similarity 0.75 a pair shares no band with probability (1 - 0.75**5)**48,
   about 2e-6.  Documents with the same words are one class, and only the row
   with the smallest id stands for it.
2. In each band bucket every member is paired with the smallest one.  A pair's
   8-bit signatures are compared in batches of 16 values; after each batch the
   pair goes if the posterior probability (uniform prior) that its similarity
   is 0.75 or more is under ``MISS``.  What is left is compared exactly, on the
   full shingle sets.
3. Members of a bucket that are still in different components and have not been
   compared with each other are compared now, by bucket, inside a task: again
   batch by batch, then exactly, skipping pairs that an earlier link has joined.
   A bucket goes out as blocks of about ``BLOCK_BYTES`` of sets, signatures and
   what a row takes besides (``ROW_BYTES``), a task for each pair of blocks, so no task holds a whole hot bucket and the rows that
   leave a task are at most a spanning forest of its block, not its pairs.
4. Components of all links.

No partner or candidate is capped, and copies are never expanded into pairs.

Defined results
* null, empty and white texts have no shingles, are linked with nothing and stay;
* a text of fewer than five words has one shingle, its whole word sequence;
* rows that share a ``doc_id`` are one document: its links are those of all its
  rows, and ``n_shingles`` is given row by row; rows with a null ``doc_id`` are
  never linked, have a null component and stay;
* repeated rows come out as often as they go in; an empty table gives an empty
  result; extra columns are ignored by ``near_dedup``, carried by ``drop_near``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escrowlens.llm.common import bit_table, bounded_batches, maybe_in, staged, whole_row, without
from escrowlens.llm.graph import components
from escrowlens.llm.shingles import mixed, powers, shingle_set, word_list

SIM_PERCENT = 75
BANDS, BAND_ROWS = 48, 5
PERMS = BANDS * BAND_ROWS
BATCH = 16
MISS = 1e-7
BLOCK_BYTES = 4_000_000
ROW_BYTES = 256  # array objects and the other columns of a member
TABLE_BITS = 24  # at most 262,144 broadcast rows
_CHUNK = 256


@functools.cache
def _family() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash family; multipliers of a band key."""
    seeds = mixed(np.arange(1, 2 * PERMS + 1, dtype=np.uint64))
    return ((seeds[:PERMS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1),
            (seeds[PERMS:] >> np.uint64(32)).astype(np.uint32), powers(0xD1342543DE82EF95, BAND_ROWS))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """PERMS smallest hash values of a set, in blocks that stay in cache."""
    times, plus, _ = _family()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(PERMS, 2**32 - 1, np.uint32)
    room = np.empty((min(_CHUNK, len(low)), PERMS), np.uint32)
    for at in range(0, len(low), _CHUNK):
        part = low[at:at + _CHUNK]
        view = room[:len(part)]
        np.multiply(part[:, None], times, out=view)
        np.add(view, plus, out=view)
        np.minimum(best, view.min(axis=0), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    keys = (rows * _family()[2]).sum(axis=1, dtype=np.uint64)
    return mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(values: np.ndarray) -> np.ndarray:
    """One byte of each value."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


@functools.cache
def least_matches(percent: int = SIM_PERCENT, miss: float = MISS) -> np.ndarray:
    """After each batch: the fewest matches with which a pair goes on.

    With similarity s a byte matches with probability s + (1 - s) / 256.
    """
    s = np.linspace(0, 1, 2001)
    hit, gap = np.log(s + (1 - s) / 256), np.log(np.maximum((1 - s) * 255 / 256, 1e-300))
    high = s >= percent / 100
    out = []
    for n in range(BATCH, PERMS + 1, BATCH):
        for m in range(n + 1):
            like = m * hit + (n - m) * gap
            like = np.exp(like - like.max())
            if like[high].sum() >= miss * like.sum():
                break
        out.append(m)
    return np.array(out)


def plausible(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` pass all batches against ``one`` (or row by row,
    if ``one`` has as many rows): places of those left."""
    left, matches = np.arange(len(many)), np.zeros(len(many), np.int64)
    for k, least in enumerate(least_matches()):
        at = slice(k * BATCH, (k + 1) * BATCH)
        mine = one[at] if one.ndim == 1 else one[left, at]
        matches = matches + (many[left, at] == mine).sum(axis=1)
        on = matches >= least
        left, matches = left[on], matches[on]
        if not len(left):
            break
    return left


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on sorted sets of distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < SIM_PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIM_PERCENT * (len(a) + len(b) - common)


def _as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, c1, c2 (class: hashes of the word sequence), n, bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2, sizes, bands = [], [], [], []
            for text in batch.column(1):
                words = word_list(text.as_py(), lower=True)
                joined = b" ".join(words)
                a, b = divmod(xxhash.xxh3_128_intdigest(joined), 1 << 64)
                c1.append(a - (1 << 63))
                c2.append(b - (1 << 63))
                shingles = shingle_set(words)
                sizes.append(len(shingles))
                bands.append(_as_long(band_keys(minhashes(shingles))) if len(shingles) else None)
            flat = [x for x in bands if x is not None]
            ends = np.cumsum([0] + [BANDS * (x is not None) for x in bands])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                          pa.array(np.concatenate(flat) if flat else [], pa.int64()))],
                names=["doc_id", "c1", "c2", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, c1 long, c2 long, n long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """id, sig (signature bytes), set (sorted shingle hashes, packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [shingle_set(word_list(t.as_py(), lower=True)) for t in part.column(1)]
                sigs = [signature(minhashes(s)).tobytes() for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sigs, pa.binary()),
                     pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "sig", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, sig binary, set binary")


def _bytes(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _pruned(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that the signature batches don't rule out."""
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            one, two = (np.stack(_bytes(batch.column(k), np.uint8)) for k in (2, 3))
            yield batch.select(["a", "b"]).take(pa.array(plausible(one, two)))

    return (pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    def run(batches):
        for batch in batches:
            one, two = (_bytes(batch.column(k), np.uint64) for k in (2, 3))
            yes = [linked(x, y) for x, y in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _block_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between members of one pair of blocks of one bucket.

    Goes through the members in turn; each is compared with the later ones (of
    the other block, if there are two) in another component.
    """
    ids, first, roots = (rows.column(c).to_numpy() for c in ("id", "is_first", "root"))
    part = rows.column("part").to_numpy()
    sigs = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("sig")])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
    size = np.array([len(s) for s in sets])
    roots, out = roots.copy(), []
    two = key[1].as_py() != key[2].as_py()
    place = np.arange(len(ids))
    for k in place:
        if first[k]:
            continue  # was compared with every member
        near = (place > k) & (roots != roots[k]) & ~first & (ids != ids[k])
        near &= 100 * np.minimum(size, size[k]) >= SIM_PERCENT * np.maximum(size, size[k])
        if two:
            near &= part != part[k]
        near = np.flatnonzero(near)
        if not len(near):
            continue
        for j in near[plausible(sigs[k], sigs[near])]:
            if roots[j] != roots[k] and linked(sets[k], sets[j]):
                out.append((ids[k], ids[j]))
                roots[roots == roots[j]] = roots[k]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()),
                     "b": pa.array([y for _, y in out], pa.int64())})


def _bucket_links(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside buckets that hold several components not yet compared."""
    labelled = (members.filter("n > 2").join(roots, "id", "left")
                .select("key", "id", "first", F.coalesce("root", "id").alias("root")))
    rest = F.when(F.col("id") != F.col("first"), F.col("root"))
    several = (labelled.groupBy("key")
               .agg(F.min(rest).alias("_lo"), F.max(rest).alias("_hi"), F.count(F.lit(1)).alias("_n"),
                    F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_x"),
                    F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_y"))
               .filter("_lo <> _hi")
               # buckets of different bands with the same members need one look
               .groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key"))
    taken = (F.octet_length("set") + F.octet_length("sig") + ROW_BYTES).alias("_bytes")
    chosen = staged(labelled.join(several, "key").join(sets.select("id", taken), "id"), "near-open")
    blocks = (chosen.groupBy("key").agg(F.sum("_bytes").alias("_sum"))
              .select("key", F.ceil(F.col("_sum") / BLOCK_BYTES).cast("int").alias("_blocks")))
    dealt = (chosen.join(blocks, "key")
             .withColumn("part", F.expr("cast(pmod(xxhash64(id, key), _blocks) as int)"))
             .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
             .select("key", F.least("part", "_other").alias("lo"), F.greatest("part", "_other").alias("hi"),
                     "id", "part", "root", (F.col("id") == F.col("first")).alias("is_first")))
    return (dealt.join(sets, "id").groupBy("key", "lo", "hi")
            .applyInArrow(_block_links, "a long, b long"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = staged(_sketches(base), "near-sketch")
    named = sketch.filter("n > 0 and doc_id is not null")
    classes = staged(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "near-classes")
    keys = (named.join(classes.select("c1", F.col("rep").alias("doc_id")), ["doc_id", "c1"])
            .select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")))
    buckets = keys.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    buckets = staged(buckets.filter("n > 1"), "near-buckets")
    some = maybe_in(keys, bit_table(buckets, ["key"], TABLE_BITS), ["key"], TABLE_BITS, "_some")
    members = staged(some.filter("_some").select("key", "id").join(buckets, "key"), "near-members")
    wanted = bit_table(members.select(F.col("id").alias("doc_id")).distinct(), ["doc_id"], TABLE_BITS)
    sets = staged(_sets(maybe_in(base, wanted, ["doc_id"], TABLE_BITS, "_some").filter("_some")),
                  "near-sets")
    pairs = (members.filter("id <> first")
             .select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    links = staged(_confirmed(_pruned(pairs, sets), sets), "near-links")
    copies = (named.select("doc_id", "c1", "c2").join(classes, ["c1", "c2"])
              .filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = staged(components(links), "near-roots")
    more = staged(_bucket_links(members, roots, sets), "near-more")
    if more.limit(1).count():
        stars = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
        roots = staged(components(stars.unionByName(more)), "near-roots")
    shared = named.groupBy("doc_id").agg(F.countDistinct("c1", "c2").alias("_k")).filter("_k > 1")
    if shared.limit(1).count():  # a doc_id with several texts joins their classes
        roots = components(links.unionByName(more).unionByName(copies))
        plain = sketch.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    else:
        plain = (sketch.join(classes, ["c1", "c2"], "left")
                 .join(roots.withColumnRenamed("id", "rep"), "rep", "left")
                 .withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "rep"))))
    return plain.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
                        .alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, only the rows of the smallest id of each
    component."""
    gone = near_dedup(docs).filter("not kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return without(rows, staged(gone, "near-gone"), ["_id"], TABLE_BITS).select("_row.*")
