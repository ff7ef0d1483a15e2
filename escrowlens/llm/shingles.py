"""Word and shingle hashes of texts as numpy arrays (used inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Odd multipliers of the words of a shingle, from the golden ratio.
_STEP = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a linear combination over all 64 bits (a bijection)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_list(text: str | None, lower: bool) -> list[bytes]:
    """Words of a text as bytes: bytes.split() cuts at just the six ASCII
    white-space bytes, and bytes.lower() changes A-Z only."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int, base: int = _STEP) -> np.ndarray:
    """Hash of every run of ``size`` words, by their positions.

    Horner's rule over shifted views: equal runs have equal hashes.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, factor = words[:n].copy(), np.uint64(base)
    for k in range(1, size):
        h *= factor
        h += words[k:k + n]
    return mixed(h)


def shingle_set(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words make one shingle, none none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), size))
