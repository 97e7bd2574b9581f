"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one byte buffer with offsets, so words, their hashes and
the hashes of word n-grams come out of a few numpy passes over the bytes and no
Python object is made per word.  Words are the maximal runs of bytes other than
``[ \\t\\n\\v\\f\\r]``; hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1_000_000
SLICE_ROWS = 4096

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, int(P_INV if inverse else P))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``limit`` bytes; a longer text is alone in its range."""
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(n, start + rows, max(start + 1, end))
        yield start, end
        start = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string array."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each row (and one past the last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off[:-1]] = True
    first[n] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off).astype(np.int64)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, from which ``slice_hashes`` takes any slice's."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=prefix[1:])
    return prefix


def slice_hashes(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((prefix[e] - prefix[s]) * powers(len(prefix), True)[s])


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return slice_hashes(byte_prefix(data), s, e) if len(s) else np.zeros(0, np.uint64)


def gram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams that don't cross rows, and the first gram of each row.  A row of 1 to n-1 words has one gram, all its words."""
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(grams)])
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.uint64), at
    start = np.repeat(first[:-1] - at[:-1], grams) + np.arange(total)
    out = np.zeros(total, dtype=np.uint64)
    left = np.repeat(first[1:], grams)
    for k in range(n):
        at_k = start + k
        ok = at_k < left
        w = h[np.minimum(at_k, len(h) - 1)]
        out = np.where(ok, mix(out * P + w + np.uint64(k + 1)), out)
    return out, at


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, rows ignored; for all starts 0 .. len(h)-n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(len(h)), out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * powers(len(h), True)[: len(h) - n + 1])


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)
