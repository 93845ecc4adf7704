"""Array helpers for whole texts in Arrow batches.

Texts are taken as one byte array with offsets; work goes over it in slices of
bounded size, so that memory follows the slice (or the longest single text) and
not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stratalog.functions.fold import by_group as grouped

__all__ = ["ALNUM", "SPACED", "grouped", "mix", "slices", "utf8", "words"]

SLICE_BYTES = 1 << 20

#: Words of letters, digits and all bytes of non-ASCII characters; A-Z become a-z; 0 ends a word.
ALNUM = np.zeros(256, np.uint8)
for _c in range(256):
    if 65 <= _c <= 90:
        ALNUM[_c] = _c + 32
    elif 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128:
        ALNUM[_c] = _c
#: Words between ASCII white space; A-Z become a-z.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[65:91] += 32
SPACED[[0x20, 9, 10, 11, 12, 13]] = 0
SPACED[0] = 0x20  # a NUL is part of a word; 0x20 is free

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
_R = np.uint64(0x94D049BB133111EB)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * _Q
    h = (h ^ (h >> np.uint64(27))) * _R
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, their byte starts, and for each text the first word's number.

    A word never crosses the end of a text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    b = table[data]
    inside = b != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    at = np.zeros(n, np.int64)
    at[starts[0] :] = np.arange(starts[0], n) - np.repeat(starts, np.diff(starts, append=n))
    powers = np.empty(int(at.max()) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _P
    powers = np.multiply.accumulate(powers)
    h = np.add.reduceat(b.astype(np.uint64) * powers[at], starts)
    return mix(h), starts, np.searchsorted(starts, offsets)
