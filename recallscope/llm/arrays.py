"""Texts and words of an Arrow batch as flat numpy arrays.

The operators hash words and word windows of whole texts. Doing that through
Python strings costs a few hundred nanoseconds a word; here the UTF-8 bytes of
a batch stay in one buffer and words, word hashes and window hashes come from a
few vector passes over it.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(20, 09-0D), i.e. ``[^\\x20\\x09-\\x0D]+``. Those bytes never occur inside a
multi-byte UTF-8 sequence, so working on bytes equals working on characters.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 21

BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]))
                                  for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None
_BYTE_POWERS = Powers(BYTE_BASE)
_WINDOW_POWERS = [Powers(b) for b in WINDOW_BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (all bits depend on all bits)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks remain only beyond 2 GiB
        raise ValueError("more than 2 GiB of text in one group")
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 22):
    """A batch in runs of rows of about ``limit`` bytes of text (one row at least)."""
    _, offsets = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Words:
    """Words of a run of texts: byte ranges, first word per text, text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ascii_lower: bool = False):
        self.data, self.offsets = data, offsets
        starts, ends, hashes = [], [], []
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
            s, e, h = self._chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ascii_lower)
            starts.append(s + offsets[a])
            ends.append(e + offsets[a])
            hashes.append(h)
            a = b
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, U64)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(n, dtype=np.int32), self.counts)

    @staticmethod
    def _chunk(data, offsets, ascii_lower):
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if ascii_lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        up, down = _BYTE_POWERS.to(n)
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
        return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))

    def windows(self, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window starting at each word, and whether it lies in one text."""
        return windows(self.hash, self.text, length, which)


def windows(hashes: np.ndarray, text: np.ndarray, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    m = len(hashes) - length + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    up, down = _WINDOW_POWERS[which].to(len(hashes))
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum((mix(hashes) if which else hashes) * up, out=total[1:])
    return mix((total[length:] - total[:-length]) * down[:m]), text[:m] == text[length - 1 :]


def trim() -> None:
    """Give freed memory back to the system: workers are reused by later tasks, and
    large arrays leave free pages that the allocator would keep."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values (numpy's own ``unique`` hashes, which is ten times slower)."""
    keys = np.sort(keys)
    return keys[runs(keys)]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    start = runs(ranked)
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
    return ranked[start], place


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key in a sorted array of distinct keys, and whether it is there."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys
