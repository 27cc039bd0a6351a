"""Exact dedup of a new batch against an immutable snapshot, through binary-fuse filters.

Texts are equal when their bytes are, after deleting ``[\\x20\\x09-\\x0D]``. Every
row gets a SHA-256 digest; from there only digests move.

* The snapshot's distinct digests are dealt into buckets of bounded size, and a
  static 3-wise binary-fuse filter is built for each. Filters are stored, and a
  later batch can use them again, as the snapshot never changes.
* The batch's digests are grouped first, so that thousands of copies are one row,
  and screened bucket by bucket. Those that a filter rejects are new for certain.
* Positives join the snapshot's digests, and the bytes of the two texts are
  compared. A digest whose bytes differ would stay two groups.
* Duplicates inside the batch, and inside the snapshot, are the grouping itself.

Null and empty texts are equal to each other and to texts of white space. Of
equal texts the longest original stays, then the smallest id (a null id after all
others). Repeated rows (same id, same text) count in the group size; they are one
document and all say the same. Very long texts are read once. An empty snapshot,
batch or table gives the result of the other part alone. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow
from ._shared import Scratch, fold

BLANK = b" \t\n\x0b\x0c\r"
#: Digests in a bucket, for which a filter takes about 1.2 MB.
BUCKET = 1_000_000
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
SMALL = 1_000_000


class BinaryFuse8:
    """Static filter with 8-bit fingerprints: no false negative, one in 256 false positives."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = _arrow.mix(keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        first = (((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)  # a segment, by its upper half
        g = _arrow.mix(h)
        inner = np.stack([(g >> np.uint64(s)).astype(np.int64) & (segment - 1) for s in (0, 20, 40)])
        return (first + np.arange(3)[:, None]) * segment + inner, (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        """A filter of the distinct 64-bit ``keys``."""
        keys = np.unique(keys)
        n = max(len(keys), 2)
        segment = min(1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
        slots = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        count = max(1, math.ceil(slots / segment) - 2 + 1)
        for seed in range(1, 200):
            place, mark = cls._places(keys, seed, segment, count)
            order = cls._peel(place, (count + 2) * segment)
            if order is not None:
                break
            if seed % 20 == 0:
                count += 1 + count // 10
        else:
            raise RuntimeError("no filter found")
        table = np.zeros((count + 2) * segment, np.uint8)
        for who, slot in reversed(order):
            value = mark[who].copy()
            for k in range(3):
                other = place[k, who]
                value ^= np.where(other == slot, np.uint8(0), table[other])
            table[slot] = value
        return cls(seed, segment, count, table)

    @staticmethod
    def _peel(place: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that each alone holds), or None if some never come free."""
        n = place.shape[1]
        degree = np.bincount(place.reshape(-1), minlength=slots)
        held = np.zeros(slots, np.int64)
        ids = np.arange(n, dtype=np.int64)
        for k in range(3):
            np.add.at(held, place[k], ids)
        order, left = [], n
        look = np.flatnonzero(degree == 1)
        while len(look):
            who, at = np.unique(held[look], return_index=True)
            order.append((who, look[at]))
            left -= len(who)
            touched = place[:, who].reshape(-1)
            np.subtract.at(degree, touched, 1)
            np.subtract.at(held, touched, np.tile(who, 3))
            touched = np.unique(touched)
            look = touched[degree[touched] == 1]
        return None if left else order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        place, mark = self._places(keys, self.seed, self.segment, self.count)
        return (self.table[place[0]] ^ self.table[place[1]] ^ self.table[place[2]]) == mark


def digests(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id, digest, points, *extra): SHA-256 of the normalised text, code points of the original."""

    def run(batches):
        for batch in batches:
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                points = _arrow.per_doc((buf & 0xC0) != 0x80, off)
                data = buf.tobytes()
                own = [hashlib.sha256(data[off[i] : off[i + 1]].translate(None, BLANK)).digest() for i in range(end - first)]
                cols = [batch.column(k).slice(first, end - first) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(own, pa.binary()), pa.array(points, pa.int64()), *cols], ["doc_id", "digest", "points", *batch.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *extra)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(_arrow.tidy(run), f"doc_id bigint, digest binary, points bigint{more}")


def _key(digest: Column) -> Column:
    """The digest's first 64 bits as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 9, 6)), 16, 10).cast("bigint"), F.lit(buckets))


def _as_keys(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, segment, count, prints): a filter for each bucket of a snapshot's distinct digests."""

    def one(table: pa.Table) -> pa.Table:
        f = BinaryFuse8.build(_as_keys(table.column("key")))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "count": pa.array([f.count], pa.int64()), "prints": pa.array([f.table.tobytes()], pa.binary())})

    keys = snapshot.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return keys.groupBy("bucket").applyInArrow(one, "bucket bigint, seed bigint, segment bigint, count bigint, prints binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct digests of ``batch`` that some filter may hold."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"digest": pa.array([], pa.binary())})
        seed, segment, count, prints = (right.column(c)[0].as_py() for c in ("seed", "segment", "count", "prints"))
        f = BinaryFuse8(seed, segment, count, np.frombuffer(prints, np.uint8))
        return pa.table({"digest": left.column("digest").combine_chunks().filter(pa.array(f.contains(_as_keys(left.column("key")))))})

    keys = batch.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest", _key(F.col("digest")).alias("key"))
    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(one, "digest binary")


def _rank() -> Column:
    return F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))


def _same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests of ``pairs`` (digest, a, b: two ids) whose texts have the same bytes once normalised."""

    def run(batches):
        for batch in batches:
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                data = buf.tobytes()
                bare = [data[off[i] : off[i + 1]].translate(None, BLANK) for i in range(end - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([hashlib.sha256(b).digest() for b in bare], pa.binary()), pa.array(bare, pa.binary())], ["doc_id", "digest", "bare"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = rows.join(wanted, "doc_id", "left_semi").mapInArrow(_arrow.tidy(run), "doc_id bigint, digest binary, bare binary").dropDuplicates(["doc_id", "digest"])
    old = pairs.join(texts, (pairs["a"] == texts["doc_id"]) & (pairs["digest"] == texts["digest"])).select(pairs["digest"], F.col("b"), F.col("bare").alias("old"))
    again = texts.select(F.col("doc_id").alias("b2"), F.col("digest").alias("d2"), F.col("bare").alias("new"))
    return old.join(again, (F.col("b") == F.col("b2")) & (F.col("digest") == F.col("d2"))).where(F.col("old") == F.col("new")).select("digest")


def dedup_batch(docs: DataFrame, incoming: Column) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of snapshot and batch.

    ``incoming`` says which rows of ``docs`` are the new batch; the others are the
    snapshot.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.write(digests(docs, F.coalesce(incoming, F.lit(True)).alias("fresh")), "digests")
    groups = scratch.write(rows.groupBy("fresh", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("best")), "groups")
    size = {r["fresh"]: r["n"] for r in groups.groupBy("fresh").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, -(-max(size.values(), default=0) // BUCKET))
    old, new = groups.where(~F.col("fresh")), groups.where("fresh")
    filters = scratch.write(build_filters(old, buckets), "filters")
    positive = screen(new, filters, buckets)
    a, b = old.select("digest", F.col("best.i").alias("a")), new.select("digest", F.col("best.i").alias("b"))
    pairs = scratch.write(positive.join(a, "digest").join(b, "digest"), "pairs")
    # a null id can't be looked up; its digest alone decides
    same = _same_bytes(docs, pairs.where("a is not null and b is not null")).unionByName(pairs.where("a is null or b is null").select("digest")).select("digest", F.lit(True).alias("same"))
    merged = groups.join(same, "digest", "left").withColumn("part", F.when(F.col("same"), F.lit(False)).otherwise(F.col("fresh")))
    best = merged.groupBy("digest", "part").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.collect_set("fresh").alias("sides"))
    best = best.select("digest", F.explode("sides").alias("fresh"), "group_size", F.col("best.i").alias("keep_id"))
    out = rows.join(best, ["digest", "fresh"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def halves() -> Column:
    """A stable division of documents into snapshot and batch, by id."""
    return fold("doc_id", 2) == 1
