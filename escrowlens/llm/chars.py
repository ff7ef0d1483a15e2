"""Code-point arrays, letters, scripts and hashed character trigrams."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# Unicode script ranges (first, last) by script name.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
SCRIPT_NAMES = ["other", *SCRIPTS]


@functools.cache
def script_table() -> np.ndarray:
    """Script number of every code point (0: none of the ranges)."""
    table = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            table[first:last + 1] = k
    return table


@functools.cache
def _kinds() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for the other code points."""
    kinds = (unicodedata.category(chr(c))[0] if not 0xD800 <= c < 0xE000 else "C" for c in range(0x110000))
    return np.fromiter((" LM".find(k) if k in "LM" else 0 for k in kinds), np.uint8, 0x110000)


@functools.cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter or a mark."""
    return _kinds() > 0


@functools.cache
def mark_table() -> np.ndarray:
    """Whether each code point is a mark."""
    return _kinds() == 2


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigram_slots(codes: np.ndarray, bits: int) -> np.ndarray:
    """Slot of the trigram around each code point (zeros beyond the ends)."""
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = codes
    h = (padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h + padded[2:]) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
