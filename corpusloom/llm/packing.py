"""Harmonic packing of token sequences into fixed-capacity training sequences.

A piece whose length lies in ``(C/(k+1), C/k]`` belongs to class ``k``; a bin of
class ``k`` takes exactly ``k`` pieces, so bins are filled by counting alone and
each worker fills its own without hearing of the others. Documents may be cut,
which lets almost all pieces have a length of exactly ``C/k``: a document gives
full sequences first, then pieces of C/2, C/4, ... down to the smallest exact
size, and a tail shorter than that, whose class is ``k = C // length``.

A bin is written once it is full. Those still open when a worker's rows end
(at most one a class) are laid end to end, cut at the capacity, and what remains
below one sequence is cut into lengths that are powers of two, which need no
padding. Nothing is dropped and no document waits for another worker.

Null and empty texts are a document of the end id alone. Repeated rows are packed
as often as they occur. A very long text is cut like any other. Ties do not
arise: pieces are dealt in the order of the rows. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import _arrow
from .bpe import codec

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class HarmonicPacker:
    """One worker's bins. Pieces are ``(doc, start, ids, doc_tokens)``."""

    def __init__(self, capacity: int = 1024, least: int = 32):
        if capacity < 2 or capacity & (capacity - 1) or not 1 <= least <= capacity:
            raise ValueError("capacity must be a power of two and not below the smallest exact piece")
        self.capacity = capacity
        self.exact = [s for s in (capacity >> j for j in range(1, capacity.bit_length())) if s >= least]
        self.open: dict[int, list[tuple]] = {}
        self.sequences = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Cut one document; yields (doc, start, ids, doc_tokens, sequence, offset) of the bins that this fills."""
        n, at, c = len(ids), 0, self.capacity
        while n - at >= c:
            yield doc, at, ids[at : at + c], n, self._next(), 0
            at += c
        for size in self.exact:
            if n - at >= size:
                yield from self._put(size, (doc, at, ids[at : at + size], n))
                at += size
        if at < n:
            yield from self._put(n - at, (doc, at, ids[at:], n))

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _put(self, size: int, piece: tuple) -> Iterator[tuple]:
        held = self.open.setdefault(size, [])
        held.append((piece[0], piece[1], piece[2].copy(), piece[3]))
        if len(held) == self.capacity // size:
            seq = self._next()
            for k, p in enumerate(held):
                yield (*p, seq, k * size)
            held.clear()

    def close(self) -> Iterator[tuple]:
        """The pieces of the bins that are still open."""
        rest = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        self.open = {}
        total, c = sum(len(p[2]) for p in rest), self.capacity
        rooms = [c] * (total // c) + [1 << b for b in range(c.bit_length() - 2, -1, -1) if total % c >> b & 1]
        room, used, seq = 0, 0, -1
        for doc, start, ids, n in rest:
            at = 0
            while at < len(ids):
                if used == room:
                    room, used, seq = rooms.pop(0), 0, self._next()
                take = min(room - used, len(ids) - at)
                yield doc, start + at, ids[at : at + take], n, seq, used
                at += take
                used += take


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it comes from and where in which sequence it lies.

    No shuffle: each task tokenizes and packs its own rows in one pass, holding
    at most one open bin a class. Sequence ids are the task's number times 2**33
    plus a counter, so that they are unique without a second pass.
    """

    def run(batches):
        bpe = codec(path)
        packer = HarmonicPacker(capacity)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _COLUMNS)

        def said(p):
            return p[0], p[1], len(p[2]), zlib.crc32(np.ascontiguousarray(p[2]).data), p[3], base + p[4], p[5]

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, ids, off in bpe.encode(batch.column(1)):
                ids = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4", copy=False)
                off = off + np.arange(len(off))
                for i in range(end - first):
                    rows.extend(map(said, packer.add(names[first + i], ids[off[i] : off[i + 1]])))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        rows.extend(map(said, packer.close()))
        yield batch_of(rows)
        bpe.forget()  # many tasks of other kinds may come before this worker packs again

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(_arrow.tidy(run), SCHEMA)
