"""Words and hashes of many texts at once, on the bytes of an Arrow column.

All white space that separates words is ASCII, so words can be cut on UTF-8
bytes. A word's hash is a polynomial of its bytes modulo 2**64, taken from
running sums, then mixed; it needs no Python code per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, U64), np.full(size, b, U64)))) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its texts; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n+1 offsets of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[cuts] = inside[cuts]
    ends[cuts[1:] - 1] = inside[cuts[1:] - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    terms = (_LOWER[data] if lower else data).astype(U64)
    terms += U64(1)
    terms *= power[:n]
    sums = np.zeros(n + 1, U64)
    np.cumsum(terms, out=sums[1:])
    hashes = (sums[last] - sums[first]) * inverse[first]
    return mix(hashes ^ (last - first).astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(first, offsets).astype(np.int64)


def sequence_hash(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbouring words."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, width, U64)
    for k in range(width):
        total = mix(total * U64(0x9E3779B97F4A7C15) + word[k : k + n])
    return total


def shingle_set(word: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted distinct shingles of one text; a shorter text is one shingle, a text without words none."""
    if not len(word):
        return np.zeros(0, U64)
    return np.unique(sequence_hash(word, min(width, len(word))))
