"""Byte-level BPE encoding and decoding (operator 2) on numpy matrices.

A text is cut by the tokenizer's pattern.  The distinct pieces of a slice of
texts that are not in the vocabulary as they stand go into padded matrices, one
per length class, a row for each piece and a column for each part.  In every
round each row merges its leftmost pair of minimum rank; ranks come from one
vectorised probe of an open-addressing hash table keyed by the two ids; rows
without a pair left are taken out of the matrix.  Pieces of more than
``LONG_PIECE`` bytes, for which the matrix would cost the square of the length,
are merged by the same rule with a heap over linked parts.

Spark deals out the documents; nothing is shuffled, and a task holds one slice
(``SLICE_BYTES`` of text) and a bounded piece cache.

Defined results
* a null text counts as empty: no ids, and it decodes to no bytes;
* texts are encoded whole, without special tokens (their strings are text);
* decoding the ids gives the bytes of the text again; an id outside of the
  vocabulary or a null id list decodes to null;
* repeated rows are encoded each; extra columns are ignored;
* an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from escrowlens.llm.common import bounded_batches

SLICE_BYTES = 1_000_000
CACHE_PIECES = 200_000
LONG_PIECE = 1024
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, as an open-addressing table of arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slots[todo]
            free = self.keys[s] == -1
            s_free, t_free = s[free], todo[free]
            first = np.unique(s_free, return_index=True)[1]
            self.keys[s_free[first]] = keys[t_free[first]]
            self.vals[s_free[first]] = merged[t_free[first]]
            todo = todo[self.keys[s] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the two don't merge (or one is padding, < 0)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.vals[slots], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1) & (left >= 0) & (right >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slots[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.vals[slots[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Vocabulary:
    """Ranks of a ``.tiktoken`` file (base64 token, rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for k in range(1, len(token))
                 if (a := self.ranks.get(token[:k])) is not None
                 and (b := self.ranks.get(token[k:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one length class."""
        wide = max(map(len, pieces))
        joined = b"".join(p.ljust(wide, b"\0") for p in pieces)
        ids = self.of_byte[np.frombuffer(joined, np.uint8)].reshape(len(pieces), wide)
        size = np.array([len(p) for p in pieces], np.int32)
        ids[np.arange(wide) >= size[:, None]] = -1
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(row), wide - 1)
        while len(row):
            at = rank.argmin(axis=1)  # the first of equal minima: the leftmost pair
            best = rank[np.arange(len(row)), at]
            if (over := best == NONE).any():
                for k in np.flatnonzero(over):
                    out[row[k]] = ids[k, : size[k]].copy()
                live = ~over
                row, ids, rank, size, at, best = (x[live] for x in (row, ids, rank, size, at, best))
                if not len(row):
                    break
            n, wide = len(row), ids.shape[1]
            each = np.arange(n)
            ids[each, at] = best
            shift = np.arange(wide - 1)
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), axis=1)
            size -= 1
            if wide == 2:
                rank = np.full((n, 1), NONE, np.int32)
                ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
                continue
            shift = shift[:-1]
            rank = np.take_along_axis(rank, shift + (shift >= at[:, None]), axis=1)
            right = np.minimum(at, wide - 3)
            rank[each, right] = self.pairs.find(ids[each, right], ids[each, right + 1])
            left = np.maximum(at - 1, 0)
            rank[each, left] = self.pairs.find(ids[each, left], ids[each, left + 1])
            if (keep := int(size.max())) < ids.shape[1] and keep >= 2:  # padding that no row needs
                ids, rank = ids[:, :keep], rank[:, : keep - 1]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: a heap of (rank, place) over linked parts."""
        ids = [int(i) for i in self.of_byte[np.frombuffer(piece, np.uint8)]]
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        joined = functools.cache(lambda a, b: self.ranks.get(self.tokens[a] + self.tokens[b]))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1)
                if (r := joined(ids[k], ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[k], ids[j], nxt[k] = r, -1, nxt[j]
            if nxt[j] < len(ids):
                prev[nxt[j]] = k
            for left, right in ((prev[k], k), (k, nxt[k])):
                if left >= 0 and right < len(ids) and (x := joined(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (x, left, ids[left], ids[right]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of distinct pieces, length class by length class."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for k, p in enumerate(raw):
            if (rank := self.ranks.get(p)) is not None:
                out[k] = np.array([rank], np.int32)
            elif len(p) > LONG_PIECE:
                out[k] = self.merge_long(p)
            else:
                classes.setdefault((len(p) - 1).bit_length(), []).append(k)
        for power, members in classes.items():
            step = max(1, (1 << 20) >> power)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                for k, ids in zip(part, self.merge_matrix([raw[k] for k in part]), strict=True):
                    out[k] = ids
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and rank file."""
    return Vocabulary(path)


class Encoder:
    """Texts to ids, with a bounded cache of the pieces met before."""

    def __init__(self, path: str, pattern: str):
        self.vocab, self.find = vocabulary(path), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > CACHE_PIECES:
            self.forget()
        known, place = len(self.place), self.place
        where = [np.fromiter((place.setdefault(p, len(place)) for p in self.find(t)), np.int64)
                 for t in texts]
        if len(place) > known:
            fresh = self.vocab.encode_pieces(list(place)[known:])
            self.size = np.concatenate([self.size, [len(x) for x in fresh]])
            self.flat = np.concatenate([self.flat, *fresh])
        start = np.cumsum(self.size) - self.size
        out = []
        for w in where:
            n = self.size[w]
            first = np.cumsum(n) - n
            out.append(self.flat[np.repeat(start[w] - first, n) + np.arange(n.sum())])
        return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = text.as_py() or ""
        ids.append(doc_id)
        texts.append(t)
        held += len(t)
        if held > SLICE_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _decoded(ids: np.ndarray, tokens: list) -> bytes | None:
    try:
        return b"".join([tokens[i] for i in ids.tolist()])
    except (IndexError, TypeError):
        return None


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _encode(docs: DataFrame, path: str, pattern: str, decode: bool) -> DataFrame:
    def run(batches):
        enc = Encoder(path, pattern)
        for batch in batches:
            for ids, texts in _slices(batch):
                coded = enc.encode(texts)
                cols = [pa.array(ids, pa.int64()), pa.array([len(c) for c in coded], pa.int64()),
                        pa.array([_packed(c) for c in coded], pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decode:
                    cols.append(pa.array([_decoded(c, enc.vocab.tokens) for c in coded], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, packed)."""
    return _encode(docs, path, pattern, decode=False)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass: also decoded (bytes)."""
    return _encode(docs, path, pattern, decode=True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (bytes) from packed ``ids``."""
    def run(batches):
        tokens = vocabulary(path).tokens
        for batch in batches:
            out = [None if raw is None or len(raw) % 4 else _decoded(np.frombuffer(raw, "<u4"), tokens)
                   for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
