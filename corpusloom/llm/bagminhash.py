"""Near-duplicate detection with BagMinHash signatures of word-shingle multisets.

A document is the multiset of its five-word shingles (words are runs of
characters outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text of one to four
words is one shingle). Similarity is the weighted Jaccard of two multisets.

A signature has ``COMPONENTS`` minima over Poisson processes: a shingle's weight
axis is cut into (0,1], (1,2], (2,4], ..., each with a process of points in time,
whose rate is the interval's length; a point has a place on the weight axis and
counts where that lies below the shingle's weight. Two documents agree in a
component with the probability of their weighted Jaccard. Points are made
in ascending order up to a horizon at which all components have a point but for one
document in a thousand; those are done again with twice the horizon.

1. Equal multisets become one node, so copies are never paired.
2. Signatures are banded; nodes that share a band lie in one bucket.
3. In rounds, each bucket picks a leader; members that are not yet known to be in
   the leader's component are verified against it by exact multiset overlap.
   So a bucket of thousands of near copies costs a few verifications a member.
4. Buckets that still hold several components are divided into blocks of members,
   bounded in number and in bytes, and each pair of blocks is worked through in
   memory. First only signatures travel: members of different components are
   compared by their equal components of the signature, of which two documents at
   the threshold have fewer than ``agree`` = 46 about once in a million (0 compares
   every pair of a bucket exactly). Members with such a partner then bring their
   multisets, and only links come out. So no link inside a bucket is lost, and no
   pair ever becomes a row.

A document is told from another by its id and its text. So rows of one id with
different texts are documents of their own, each in the class of its text; rows
equal in both are one document, which counts as often as it occurs and stays or
goes as a whole. Rows without an id are compared like any other; where no row of a
class has an id, its name is null and the document with the least hash of its text
stays. Null and empty texts have no shingles and are alone in their class. A
class is named by its least id. Ties of ids go to the least hash of the text. Very
long texts are one row's work. An empty table gives no rows. Extra columns stay as
they are in ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow
from ._shared import Scratch, own_key, packed
from .graph import components

SHINGLE, COMPONENTS, ROWS = 5, 80, 4
ROUNDS = 2
#: Members of a bucket that are compared in memory at once, and the bytes of their multisets.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Equal components of the signature below which a pair is not verified.
AGREE = 46
#: Rows of a key table that may be broadcast (about 40 bytes each).
SMALL = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, repeats included."""
    words = _arrow.Words(buf, off)
    h = words.hashes(lower=True)
    at, window = words.windows(size, h)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = words.count[short] > k
            whole[more] = _arrow.mix(whole[more] * _ODD + h[words.first[short[more]] + k])
        doc, window = np.concatenate([doc, short]), np.concatenate([window, _arrow.mix(whole)])
    return doc, window


def multiset(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight), sorted by document."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, components: int = COMPONENTS) -> np.ndarray:
    """[document, component] minima; infinite for a document without shingles."""
    total = np.bincount(doc, weight, docs)
    sig = np.full((docs, components), np.inf)
    todo, expect = total > 0, components * (np.log(components) + 7)
    while todo.any():
        use = todo[doc]
        d0, h0, w0 = doc[use], h[use], weight[use].astype(np.float64)
        sig[todo] = np.inf
        flat = sig.reshape(-1)
        level = 0
        while len(d0):
            low = 0.0 if level == 0 else float(1 << (level - 1))
            size = 1.0 if level == 0 else low
            on = w0 > low
            d, h_, w = d0[on], h0[on], w0[on]
            if not len(d):
                break
            state, t, limit = _arrow.mix(h_ ^ _arrow.mix(np.array([level + 1], np.uint64) * _ODD)), np.zeros(len(d)), (expect / np.maximum(total, 1))[d]
            while len(d):
                state = _arrow.mix(state + _GOLD)
                t = t - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
                live = t < limit
                d, w, state, t, limit = d[live], w[live], state[live], t[live], limit[live]
                place = _arrow.mix(state ^ _ODD)
                under = low + size * ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < w
                cell = d * components + (((place >> np.uint64(32)) * np.uint64(components)) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(flat, cell[under], t[under])
            level += 1
        todo = todo & np.isinf(sig).any(axis=1)
        expect *= 2
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """[document, band] hashes."""
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    out = np.tile(_arrow.mix(np.arange(1, bits.shape[1] + 1, dtype=np.uint64)), (len(sig), 1))
    for k in range(rows):
        out = _arrow.mix(out * _ODD + bits[:, :, k])
    return out


def _node(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int) -> list[bytes]:
    """16 bytes that name each document's multiset, whatever its order."""
    halves = []
    for seed in np.array([[1], [2]], np.uint64):
        total = np.zeros(docs, np.uint64)
        np.add.at(total, doc, _arrow.mix(_arrow.mix(h + seed * _GOLD) + weight.astype(np.uint64) * _ODD))
        halves.append(total)
    flat = np.ascontiguousarray(np.stack(halves, axis=1)).tobytes()
    return [flat[16 * i : 16 * i + 16] for i in range(docs)]


def sketch(docs: DataFrame) -> DataFrame:
    """(key, node, bands, bytes, size) of every row of (key, text); all but the key are null without shingles.

    ``bytes`` has eight bits of each signature component, ``size`` is the number of shingles.
    """

    def run(batches):
        for batch in batches:
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                n = end - first
                doc, h, weight = multiset(*shingles(buf, off))
                size = np.bincount(doc, weight, n).astype(np.int64)
                sig = signatures(doc, h, weight, n)
                band = bands(sig).astype(np.int64)
                low = _arrow.mix(sig.view(np.uint64)).astype(np.uint8)
                none = pa.array(size == 0)
                clear = lambda x: pc.if_else(none, pa.nulls(n, x.type), x)
                lists = pa.array([x if s else None for x, s in zip(band, size, strict=True)], pa.list_(pa.int64()))
                cols = [clear(pa.array(_node(doc, h, weight, n), pa.binary())), lists, clear(pa.array([x.tobytes() for x in low], pa.binary())), clear(pa.array(size))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *cols], ["key", "node", "bands", "bytes", "size"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(_arrow.tidy(run), f"key {kind}, node binary, bands array<bigint>, bytes binary, size bigint")


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it is as small as that."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, bag): the sorted shingle hashes of the nodes in ``wanted`` (key, node), from the rows of (key, text)."""

    def run(batches):
        for batch in batches:
            want = batch.column(1).to_pylist()
            for first, end, buf, off in _arrow.chunks(batch.column(0)):
                n = end - first
                doc, h, weight = multiset(*shingles(buf, off))
                upto = np.searchsorted(doc, np.arange(n + 1))
                bag = [np.repeat(h[upto[i] : upto[i + 1]], weight[upto[i] : upto[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(want[first:end], pa.binary()), pa.array(bag, pa.binary())], ["node", "bag"])

    # the hashes of the text are the join's key, so that rows without an id meet like any other
    of = _small(wanted.select(F.col("key.h").alias("h"), F.col("key.g").alias("g"), F.col("key.i").alias("i"), "node"))
    rows = docs.select(F.col("key.h").alias("th"), F.col("key.g").alias("tg"), F.col("key.i").alias("ti"), "text")
    met = rows.join(of, (F.col("th") == F.col("h")) & (F.col("tg") == F.col("g")) & F.col("ti").eqNullSafe(F.col("i")))
    return met.select("text", "node").mapInArrow(_arrow.tidy(run), "node binary, bag binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


def verify(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose weighted Jaccard is ``threshold`` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) * (1 - 1e-9):
                    keep.append(False)
                    continue
                both = overlap(x, y)
                keep.append(both >= threshold * (len(x) + len(y) - both) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = bags.select(F.col("node").alias("u"), F.col("bag").alias("a"))
    right = bags.select(F.col("node").alias("v"), F.col("bag").alias("b"))
    met = left.join(_small(pairs), "u").join(right, "v")
    return met.select("u", "v", "a", "b").mapInArrow(_arrow.tidy(run), "u binary, v binary")


class _Block:
    """The members of one bucket, or of two of its blocks: which of them to compare with which."""

    def __init__(self, table: pa.Table, threshold: float, agree: int):
        n = table.num_rows
        self.threshold, self.agree = threshold, agree
        column = lambda c: table.column(c).combine_chunks()
        self.band = column("bands").flatten().to_numpy().reshape(n, -1)
        self.low = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(n, -1)
        self.here = int(np.argmax(self.band[0] == column("band")[0].as_py()))
        self.block = table.column("block").to_numpy()
        self.across = table.column("p")[0] != table.column("q")[0]
        self.size = table.column("size").to_numpy()
        self.name = column("comp").dictionary_encode().indices.to_numpy()
        self.most = int(np.argmax(np.bincount(self.name)))

    def partners(self):
        """(member, its partners) of all pairs in different components that may be at the threshold, each pair once."""
        done = np.zeros(len(self.size), bool)
        for i in np.flatnonzero(self.name != self.most):
            done[i] = True
            near = np.flatnonzero(~done & (self.name != self.name[i]) | (self.name == self.most))
            if self.across:
                near = near[self.block[near] != self.block[i]]
            near = near[np.minimum(self.size[near], self.size[i]) >= self.threshold * np.maximum(self.size[near], self.size[i]) * (1 - 1e-9)]
            equal = self.band[near] == self.band[i]
            near = near[equal.any(axis=1) & (equal.argmax(axis=1) == self.here)]  # a pair is compared in its first bucket only
            same = (self.low[near] == self.low[i]).sum(axis=1)
            near = near[np.argsort(-same, kind="stable")[: int((same >= self.agree).sum())]]
            if len(near):
                yield i, near


def _block_links(table: pa.Table, threshold: float, agree: int) -> list[tuple[bytes, bytes]]:
    """Links between different components among the members of one bucket, or of two of its blocks."""
    block = _Block(table, threshold, agree)
    comp, node, bags = (table.column(c).to_pylist() for c in ("comp", "node", "bag"))
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    bag: dict[int, tuple] = {}

    def counts(i):
        if i not in bag:
            bag[i] = np.unique(np.frombuffer(bags[i], np.uint64), return_counts=True)
        return bag[i]

    links = []
    for i, near in block.partners():
        for j in near.tolist():
            a, b = root(comp[i]), root(comp[j])
            if a == b:
                continue
            (ui, ci), (uj, cj) = counts(i), counts(j)
            _, x, y = np.intersect1d(ui, uj, assume_unique=True, return_indices=True)
            both = int(np.minimum(ci[x], cj[y]).sum())
            if both >= threshold * (int(block.size[i]) + int(block.size[j]) - both) * (1 - 1e-9):
                links.append((node[i], node[j]))
                parent[max(a, b)] = min(a, b)
    return links


def _rest(mixed: DataFrame, nodes: DataFrame, bags: DataFrame, threshold: float, agree: int, scratch: Scratch) -> DataFrame:
    """(u, v): links between components inside the buckets of ``mixed`` (band, node, comp)."""

    def some(table: pa.Table) -> pa.Table:
        keep: set = set()
        for i, near in _Block(table, threshold, agree).partners():
            keep.update((int(i), *near.tolist()))
        return table.select(["band", "p", "q", "block", "node", "comp"]).take(pa.array(sorted(keep), pa.int64()))

    def one(table: pa.Table) -> pa.Table:
        links = _block_links(table, threshold, agree)
        if table.num_rows > BLOCK // 2:
            _arrow.settle()
        return pa.table({"u": pa.array([a for a, _ in links], pa.binary()), "v": pa.array([b for _, b in links], pa.binary())})

    signed = nodes.select("node", "bands", "bytes", "size")
    held = mixed.join(nodes.select("node", "size"), "node")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    dealt = held.select("band", "node", "comp").join(held.groupBy("band").agg(need.alias("blocks")), "band")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # each two blocks meet once, and each block meets itself
    dealt = dealt.select("band", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "comp")
    kind = "band bigint, p int, q int, block int, node binary, comp binary"
    # the number of partitions is stated: these rows are few bytes, but a lot of work each
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = scratch.write(dealt.join(signed, "node").repartition(parts, "band", "p", "q").groupBy("band", "p", "q").applyInArrow(some, kind), "near")
    return near.join(signed, "node").join(bags, "node").groupBy("band", "p", "q").applyInArrow(one, "u binary, v binary").distinct()


def _merge(comp: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``comp`` (node, comp) with the components that ``links`` (u, v) connect made one."""
    cu, cv = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    joined = links.join(cu, "u").join(cv, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return scratch.write(comp.join(_small(merged), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), name)


def _classed(docs: DataFrame, threshold: float, agree: int, scratch: Scratch) -> DataFrame:
    """(key, class_id, class_size, kept) of every row of (key, text); ``kept`` says whether the class's document that stays is this one."""
    rows = scratch.write(sketch(docs), "sketch", batch=2000)
    order = F.struct(F.col("key.i").isNull().alias("z"), F.col("key").alias("key"))
    first = lambda c: F.first(c).alias(c)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(order).alias("rep"), F.count(F.lit(1)).alias("n"), first("bands"), first("bytes"), first("size"))
    nodes = scratch.write(nodes, "nodes")

    band = nodes.select("node", F.explode("bands").alias("band"))
    full = band.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band")
    members = scratch.write(band.join(full, "band").select("band", "node"), "members")
    comp = scratch.write(members.select("node", F.col("node").alias("comp")).distinct(), "comp")
    own = scratch.write(nodes.select("node", "rep.key").join(comp.select("node"), "node", "left_semi"), "own")
    bags = scratch.write(_bags(docs, own).dropDuplicates(["node"]), "bags", batch=1000)

    for step in range(ROUNDS + 1):
        here = members.join(comp, "node")
        if step:  # buckets in which some pair is not yet connected
            mixed = here.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band")
            here = scratch.write(here.join(mixed, "band"), f"here{step}")
            if not here.limit(1).count():
                break
        if step == ROUNDS:
            links = scratch.write(_rest(here, nodes, bags, threshold, agree, scratch), "rest", batch=500)
        else:
            by = F.struct(F.xxhash64("node", F.lit(step)).alias("o"), F.col("node").alias("n"), F.col("comp").alias("c"))
            lead = here.groupBy("band").agg(F.min(by).alias("lead"))
            pairs = here.join(lead, "band").where(F.col("comp") != F.col("lead.c")).select(F.least("node", "lead.n").alias("u"), F.greatest("node", "lead.n").alias("v"))
            pairs = scratch.write(pairs.distinct(), f"pairs{step}")
            links = scratch.write(verify(pairs, bags, threshold), f"links{step}", batch=500)
        if links.limit(1).count():
            comp = _merge(comp, links, scratch, f"comp{step}")

    named = nodes.select("node", "rep", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(named.groupBy("comp").agg(F.min("rep").alias("best"), F.sum("n").alias("class_size")), "comp").select("node", "best", "class_size")
    met = rows.select("key", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    kept = alone | F.col("best.key").eqNullSafe(F.col("key"))
    return met.select("key", F.when(alone, F.col("key.i")).otherwise(F.col("best.key.i")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), kept.alias("kept"))


def _key(id_col: str, text_col: str) -> Column:
    key = own_key(id_col, text_col)
    return F.struct(key["i"].cast("bigint").alias("i"), key["h"].alias("h"), key["g"].alias("g"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))


def classes(docs: DataFrame, threshold: float = 0.8, agree: int = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) of every row."""
    out = _classed(_keyed(docs, id_col, text_col), threshold, agree, Scratch(docs.sparkSession, "near"))
    return out.select(F.col("key.i").alias("doc_id"), "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = 0.8, agree: int = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of a class other than those of its first document.

    Only the keys of what goes are joined: broadcast while few, else by a shuffle.
    """
    scratch = Scratch(docs.sparkSession, "one")
    out = _classed(_keyed(docs, id_col, text_col), threshold, agree, scratch)
    gone = scratch.write(out.where("not kept").select("key").distinct(), "gone")
    rows = docs.select(packed(docs).alias("row"), _key(id_col, text_col).alias("key")).select("row", "key.*")
    off = gone.select(F.col("key.h").alias("gh"), F.col("key.g").alias("gg"), F.col("key.i").alias("gi"))
    rest = rows.join(_small(off), (F.col("h") == F.col("gh")) & (F.col("g") == F.col("gg")) & F.col("i").eqNullSafe(F.col("gi")), "left_anti")
    return rest.select(*[F.col("row")[c].alias(c) for c in docs.columns])
