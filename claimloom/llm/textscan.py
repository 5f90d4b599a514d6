"""Words and their hashes for whole Arrow batches of texts, by numpy.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomial sums over
the bytes of a word (every byte through a table of random values), finished by a mixing
step; hashes of word sequences are polynomial sums over mixed word hashes. All positions of
a batch are hashed by a handful of array operations. Texts are taken whole; a batch is cut
into blocks of texts only to bound the memory of the temporary arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation: words are then letters, digits and wider characters.
SIGNS = SPACE.copy()
SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Bytes of text handled at once; one longer text is a block of its own.
BLOCK = 1 << 20

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=16)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _ODD[which]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number and of its inverse, modulo 2^64."""
    size = 1 << max(12, int(n).bit_length())
    a, b = _powers(which, size)
    return a[:n], b[:n]


@lru_cache(maxsize=4)
def _table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[0]))
    if lower:
        t[65:91] = t[97:123]
    return t


@lru_cache(maxsize=1)
def _trim():
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, several to an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows."""
    data, offs = buffers(column)
    first = 0
    while first < len(offs) - 1:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


class Words:
    """The words of a block: byte ranges, and for every row its range of words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACE):
        self.data, self.offs, self.gaps = data, offs, gaps
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.rows = np.zeros(len(offs), np.int64)
            return
        space = gaps[data]
        edge = np.empty(len(data), bool)
        edge[0] = True
        edge[1:] = space[:-1]
        edge[offs[:-1][offs[:-1] < len(data)]] = True
        self.starts = np.flatnonzero(edge & ~space)
        edge[-1] = True
        edge[:-1] = space[1:]
        edge[offs[1:][offs[1:] > 0] - 1] = True
        self.ends = np.flatnonzero(edge & ~space) + 1
        self.rows = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A mixed 64-bit hash of every word; lower: A-Z count as a-z."""
        if not len(self):
            return np.zeros(0, np.uint64)
        table, out, step = np.where(self.gaps, np.uint64(0), _table(lower)), np.empty(len(self), np.uint64), 1 << 20
        first = 0
        while first < len(self):  # long texts in steps, cut between words
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + step, "right")))
            at, to = self.starts[first], self.ends[last - 1]
            power, inverse = powers(0, to - at)
            value = table[self.data[at:to]] * power
            own = self.starts[first:last] - at
            out[first:last] = np.add.reduceat(value, own) * inverse[own]
            first = last
        return mix(out + (self.ends - self.starts).astype(np.uint64))


def windows(values: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    """Hash of values[i:i+length] for every i; windows over row ends are the caller's to drop."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(which, len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power, out=total[1:])
    return mix((total[length:] - total[:-length]) * inverse[:n])


def inside(rows: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of this length that starts at a word lies within its row."""
    n = int(rows[-1])
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)
    return left[: max(0, n - length + 1)] >= length
