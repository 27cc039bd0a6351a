"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of a range of documents in ascending order. Each block of
256 ids is stored as the differences from its minimum, packed at the width that
a percentile of them fits into; for the outliers the packed slot has the low
bits, and an exception list after the packed bits their positions and high bits.
The footer has, for each block, its byte position (the index), minimum, width
and number of exceptions, and for each document its id and number of ids, so
that any run of ids can be read by touching its blocks alone.

    "PFORIDS1" | blocks | i64 doc ids | u8 id is null | u32 ids a document
    | u64 block starts | u32 minima | u8 widths | u16 exceptions | u64 x 4, "PFORIDS1"

Null and empty texts are a document of the end id alone; repeated rows are each
written; a very long text runs over many blocks; an empty table gives no files
and no rows; ties in the order (equal ids) are broken by the text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _arrow
from ._shared import Scratch
from .bpe import codec

MAGIC = b"PFORIDS1"
BLOCK = 256
FRAME = 1024
_TAIL = struct.Struct("<QQQQ8s")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each block, minima, widths, exception counts); the last block may be filled up with its first value."""
    n = -(-len(ids) // BLOCK)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(n - 1) * BLOCK]
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    kth = int(percentile * (BLOCK - 1))
    width = np.maximum(_bits(np.partition(grid, kth, axis=1)[:, kth]), 1)
    high = grid >> np.minimum(width, 31)[:, None].astype(np.uint32)
    high[width >= 32] = 0
    out_row, out_col = np.nonzero(high)
    count = np.bincount(out_row, minlength=n)
    upto = np.concatenate([[0], np.cumsum(count)])
    where, what = out_col.astype(np.uint8).tobytes(), high[out_row, out_col].astype("<u4").tobytes()
    blocks: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(grid[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - w :]
        packed = np.packbits(bits.reshape(len(rows), BLOCK * w), axis=1)
        for r, p in zip(rows.tolist(), packed, strict=True):
            a, b = upto[r], upto[r + 1]
            blocks[r] = p.tobytes() + where[a:b] + what[4 * a : 4 * b]
    return blocks, low, width.astype(np.uint8), count.astype(np.uint16)


def decode_blocks(data: np.ndarray, start: np.ndarray, low: np.ndarray, width: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ids of whole blocks; ``start`` counts from the beginning of ``data``."""
    n = len(start)
    grid = np.zeros((n, BLOCK), np.uint32)
    size = BLOCK * width.astype(np.int64) // 8
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(data[start[rows][:, None] + np.arange(BLOCK * int(w) // 8)], axis=1).reshape(len(rows), BLOCK, int(w))
        wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
        wide[:, :, 32 - int(w) :] = bits
        grid[rows] = np.packbits(wide, axis=2).view(">u4")[:, :, 0]
    many = count.astype(np.int64)
    if many.any():
        row = np.repeat(np.arange(n), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        col = data[start[row] + size[row] + k]
        at = start[row] + size[row] + many[row] + 4 * k
        high = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
        grid[row, col] |= high << width[row].astype(np.uint32)
    return (grid + low[:, None]).reshape(-1)


class Writer:
    """Writes one file front to back, a frame of blocks at a time."""

    def __init__(self, sink, percentile: float = 0.95):
        self.sink, self.percentile, self.at = sink, percentile, len(MAGIC)
        sink.write(MAGIC)
        self.wait: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple] = []

    def add(self, docs: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.extend(docs)
        self.lengths.append(lengths.astype("<u4"))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * FRAME:
            ids = np.concatenate(self.wait)
            whole = len(ids) // (BLOCK * FRAME) * (BLOCK * FRAME)
            for k in range(0, whole, BLOCK * FRAME):
                self._frame(ids[k : k + BLOCK * FRAME])
            self.wait, self.waiting = [ids[whole:]], len(ids) - whole

    def _frame(self, ids: np.ndarray) -> None:
        blocks, low, width, count = encode_blocks(ids, self.percentile)
        size = np.fromiter(map(len, blocks), np.int64, len(blocks))
        self.parts.append((self.at + np.cumsum(size) - size, low, width, count))
        self.at += int(size.sum())
        self.sink.write(b"".join(blocks))

    def close(self) -> int:
        """Writes what waits and the footer; the number of ids."""
        if self.waiting:
            self._frame(np.concatenate(self.wait))
        start, low, width, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*self.parts, strict=True)) or [[]] * 4))
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<u4")
        null = np.array([d is None for d in self.docs], np.uint8)
        names = np.array([0 if d is None else d for d in self.docs], "<i8")
        for x in (names, null, lengths, start.astype("<u8"), low.astype("<u4"), width.astype("u1"), count.astype("<u2")):
            self.sink.write(x.tobytes())
        total = int(lengths.sum(dtype=np.int64))
        self.sink.write(_TAIL.pack(self.at, len(names), len(start), total, MAGIC))
        return total


class Reader:
    """Random and sequential access to one file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _TAIL.size)
        body, docs, blocks, self.total, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(body)
        foot = source.read(docs * 13 + blocks * 15)
        cut = np.cumsum([0, 8 * docs, docs, 4 * docs, 8 * blocks, 4 * blocks, blocks, 2 * blocks])
        part = [np.frombuffer(foot, t, count=n, offset=o) for t, n, o in zip(("<i8", "u1", "<u4", "<u8", "<u4", "u1", "<u2"), (docs, docs, docs, blocks, blocks, blocks, blocks), cut, strict=False)]
        names, null, self.lengths, start, self.low, self.width, self.count = part
        self.docs = [None if z else d for d, z in zip(names.tolist(), null.tolist(), strict=True)]
        self.start = np.concatenate([start.astype(np.int64), [body]])

    def blocks(self, first: int, end: int) -> np.ndarray:
        self.source.seek(int(self.start[first]))
        data = np.frombuffer(self.source.read(int(self.start[end] - self.start[first])), np.uint8)
        return decode_blocks(data, self.start[first:end] - self.start[first], self.low[first:end], self.width[first:end], self.count[first:end])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Up to ``n`` ids from position ``start``: reads only the blocks that hold them."""
        n = min(n, self.total - start)
        if n <= 0:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return self.blocks(first, -(-(start + n) // BLOCK))[start - first * BLOCK :][:n]

    def frames(self) -> Iterator[np.ndarray]:
        left, last = self.total, len(self.start) - 1
        for k in range(0, last, FRAME):
            ids = self.blocks(k, min(k + FRAME, last))[:left]
            left -= len(ids)
            yield ids


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, percentile: float = 0.95) -> DataFrame:
    """Encode and write all documents; (shard, uri, n_docs, n_ids) of the files, in ascending order of doc_id.

    One range shuffle of the texts puts documents in order; each task streams its
    range into one file, whose name has the task's attempt. A file counts once its row is
    in the stored result, which names one attempt for each range: no file is moved or
    replaced, and what a failed or speculative attempt left, ``sweep`` deletes.
    """

    def run(batches):
        bpe, shard = codec(path), TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:07d}-{TaskContext.get().taskAttemptId()}.pfor"
        fs, place = _open(uri)
        writer, sink, n_docs = None, None, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, ids, off in bpe.encode(batch.column(1)):
                if writer is None:
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(place)
                    writer = Writer(sink, percentile)
                writer.add(names[first:end], np.diff(off) + 1, np.insert(ids, off[1:], np.uint32(end_id)))
                n_docs += end - first
        if writer is None:
            return
        total = writer.close()
        sink.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "uri": [uri], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(_arrow.tidy(run), "shard bigint, uri string, n_docs bigint, n_ids bigint")


def sweep(manifest: DataFrame, folder: str) -> int:
    """Delete the files in ``folder`` that a stored manifest does not name; how many there were. A manifest has a row a file."""
    sc = manifest.sparkSession.sparkContext
    named = {r["uri"].rpartition("/")[2] for r in manifest.select("uri").collect()}
    place = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
    left = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName() not in named] if fs.exists(place) else []
    for path in left:
        fs.delete(path, False)
    return len(left)


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a stored manifest."""

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, place = _open(uri)
                with fs.open_input_file(place) as source:
                    reader = Reader(source)
                    lengths, docs = reader.lengths.astype(np.int64), reader.docs
                    start = base + np.cumsum(lengths) - lengths
                    crc, doc, left = [], 0, int(lengths[0]) if len(lengths) else 0
                    now = 0
                    for ids in reader.frames():
                        ids = ids.astype("<u4", copy=False)
                        at = 0
                        while at < len(ids):
                            take = min(left, len(ids) - at)
                            now = zlib.crc32(ids[at : at + take].data, now)
                            at += take
                            left -= take
                            if not left:
                                crc.append(now)
                                doc += 1
                                now, left = 0, int(lengths[doc]) if doc < len(lengths) else 0
                    for k in range(0, len(docs), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs[k : k + 50_000], start[k : k + 50_000], lengths[k : k + 50_000], crc[k : k + 50_000])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    # one row a file, and a file holds a whole partition of texts: the running sum is over few rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("base"))
    return based.repartition(max(1, files)).mapInArrow(_arrow.tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to token-id files in the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "pfor")
    manifest = scratch.write(write_files(docs, path, f"{scratch.path}/ids", end_id), "manifest")
    sweep(manifest, f"{scratch.path}/ids")
    return read_files(manifest)
