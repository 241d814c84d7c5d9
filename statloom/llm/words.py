"""Words of whole texts as 64-bit hashes, found by numpy over the bytes of an Arrow batch.

A word is a maximal run of ASCII letters or digits and of non-ASCII characters, after lower-casing; everything else separates words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from statloom.llm.shared import utf8

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64 for i < n or more."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 20), base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (SplitMix64's finisher)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of raw[starts[i]:ends[i]] for each i, by polynomial prefix sums modulo 2 ** 64."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true in member; no run crosses an offset."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(member) + 1, bool)
    cut[offsets] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1] | cut[1:-1]
    stops = member.copy()
    stops[:-1] &= ~member[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_spans(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words of a text column, and where each row's words start in these."""
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")) if lower else column)
    starts, ends = runs(_IS_WORD[raw], offsets)
    return raw, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text column, row after row, and where each row's words start."""
    raw, starts, ends, at = word_spans(column)
    return span_hashes(raw, starts, ends), at


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of each n words in a row; of all the words if there are fewer; none without words."""
    if not len(words):
        return np.zeros(0, U64)
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        total *= U64(_BASE)
        total += words[k : len(words) - n + 1 + k]
    return np.unique(mix(total + U64(n)))
