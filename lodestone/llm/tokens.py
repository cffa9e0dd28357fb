"""Words of Arrow text batches as numpy arrays, for the operators that hash many windows of words.

A word is a run of bytes other than the ASCII blanks. Hashes are 64-bit: a polynomial in the word's
bytes (or in the hashes of a window's words) modulo 2^64 with an odd multiplier, then mixed. All
steps work on slices of about a megabyte of text, so memory doesn't follow the batch; a single text
is never split, so it does follow the longest text, at about 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers: of bytes, of words, and of words for a second, independent hash.
BYTES, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    row: np.ndarray  # of each word, its text's place in the slice
    start: np.ndarray  # first byte in data
    end: np.ndarray  # byte after the last
    data: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number over all its bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), for so many rows at a time as hold about `limit` bytes."""
    at, data = column_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, split(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def split(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of texts that lie one after the other in data, cut at `at`."""
    solid = ~BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= solid[cut]
    ends[cut - 1] |= solid[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(at, start, "right") - 1, start, end, data, len(at) - 1)


def runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run values[start:end], of its length too."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(FIRST))


def word_hashes(words: Words, lower: bool = False) -> np.ndarray:
    return runs_hash(LOWER[words.data] if lower else words.data, words.start, words.end, BYTES)


def window_hashes(h: np.ndarray, k: int, base: int = FIRST) -> np.ndarray:
    """A hash of every k consecutive words, len(h) - k + 1 of them, across texts too: see inside()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(base)
        out += h[j : j + n]
    return mix(out)


def inside(row: np.ndarray, k: int) -> np.ndarray:
    """Of each window of k words, whether it lies within one text."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def tagged(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """h made different for each row, to look up (row, h) pairs as one number."""
    return mix(h ^ (row.astype(np.uint64) * np.uint64(SECOND)))
