"""Texts of an Arrow batch as flat bytes, and vectorised words over them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; the arrays over them take about sixty times as much.
CHUNK = 1 << 20

_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_SPAN = 1 << 16


def _powers() -> np.ndarray:
    out = np.full(_SPAN, 0xD6E8FEB86659FD93, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers()


def settle() -> None:
    """Give freed memory back: a worker waits for its next task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, settled at the end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            settle()

    return wrapped


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in pieces of about ``limit`` bytes, rows kept whole."""
    if not len(column):
        return
    buf, off = flat(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, buf[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segment_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges ascend and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    at = np.cumsum(length) - length
    inside = np.arange(total, dtype=np.int64) - np.repeat(at, length)
    value = buf[np.repeat(start, length) + inside].astype(np.uint64) + np.uint64(1)
    if len(length) and int(length.max()) > _SPAN:
        value *= ((inside >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(_MULT)
    value *= _POW[inside & (_SPAN - 1)]
    out = np.zeros(len(start), np.uint64)
    full = length > 0
    if full.any():
        out[full] = np.add.reduceat(value, at[full])
    return mix(out + length.astype(np.uint64) * np.uint64(_MULT))


class Words:
    """Maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, document by document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.docs = buf, off, len(off) - 1
        ink = ~_WS[buf]
        edge = np.zeros(len(buf) + 1, bool)
        if len(buf):
            edge[0] = ink[0]
            edge[-1] = ink[-1]
            edge[1:-1] = ink[1:] != ink[:-1]
        inner = off[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(buf))])
        both = inner[ink[inner] & ink[inner - 1]] if len(inner) else inner
        start = np.flatnonzero(edge[:-1] & ink) if len(buf) else np.zeros(0, np.int64)
        end = np.flatnonzero(edge & np.concatenate([[False], ink])) if len(buf) else np.zeros(0, np.int64)
        if len(both):
            start = np.sort(np.concatenate([start, both]))
            end = np.sort(np.concatenate([end, both]))
        self.start, self.end, self.ink = start, end, ink
        self.first = np.searchsorted(start, off)  # word index at which each document begins
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return segment_hash(_LOWER[self.buf] if lower else self.buf, self.start, self.end)

    def windows(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of every window of ``n`` words inside one document."""
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = h[:m].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(_MULT)) + h[k : k + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix(out[at])


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each document's range ``off[i]:off[i+1]``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
