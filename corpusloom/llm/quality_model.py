"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: every word has a fixed sparse ternary index vector, drawn from its
hash, and its word vector is the sum of the index vectors of its neighbours over the
whole corpus. Sums need one pass and combine before the shuffle. A word found at
least ``LEAST`` times in the corpus has a vector of its own, however many such words
there are; rarer ones, whose sums would say little, share ``RARE`` buckets by their
hash. Word shapes (which kinds of characters a word has) have neighbours and vectors
too.

Words are counted first. Up to ``WORDS`` vectors go to every task; beyond that number
texts are dealt into groups of bounded bytes, and each group meets the vectors of its
own words in a cogrouped join. Both ways give the same features.

A document is the mean of its words' vectors, of its shapes' vectors, and of the
products of adjacent words' vectors. A network of one hidden layer gives a
logit, which a temperature fitted on rows set aside turns into a probability.
Labels are seen for at most ``max_labels`` documents; vectors count all texts.

Null and empty texts pool to zero and get the score of such a document. Repeated
rows get equal scores and count as often as they occur in the vectors. Very long
texts are one row's work. Of a labelled id with several texts, the one with the least
hash is learned from. Without labels of both kinds the score is the share of
label 1, or 0.5. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow
from ._labels import labelled
from ._shared import Scratch

DIMS, SHAPES, RARE = 32, 64, 4096
#: Occurrences that give a word a vector of its own, and vectors that go to every task (72 bytes each).
LEAST, WORDS = 100, 1_000_000
#: Bytes of text in a group that meets its vectors by a join.
GROUP_BYTES = 16 << 20

_SHAPE = np.full(256, 32, np.uint8)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 4
_SHAPE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
_SHAPE[list(b"#*$%&|<>")] = 16


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[_arrow.Words, np.ndarray, np.ndarray]:
    """The words, their hashes and their shapes. Hashes are greater than any shape or bucket."""
    words = _arrow.Words(buf, off)
    h = words.hashes(lower=True) | np.uint64(1 << 32)
    if not len(h):
        return words, h, h.astype(np.int64)
    both = np.stack([words.start, words.end], axis=1).reshape(-1)
    last = both[-1] == len(buf)
    kind = np.bitwise_or.reduceat(_SHAPE[buf], both[:-1] if last else both)[::2]
    return words, h, kind.astype(np.int64) & (SHAPES - 1)


def index(h: np.ndarray) -> np.ndarray:
    """[4, word]: two dimensions that are +1 and two that are -1, all different, of each hash."""
    m = _arrow.mix(h)
    out = np.stack([((m >> np.uint64(16 * k)) % np.uint64(DIMS - k)).astype(np.int64) for k in range(4)])
    for k in range(1, 4):  # the k-th draw counts the dimensions that are left
        for taken in np.sort(out[:k], axis=0):
            out[k] += out[k] >= taken
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return SHAPES + (h % np.uint64(RARE)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, is in the texts."""

    def run(batches):
        for batch in batches:
            for _, _, buf, off in _arrow.chunks(batch.column(0)):
                word, n = np.unique(_tokens(buf, off)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(_arrow.tidy(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_NAMES = [f"v{k}" for k in range(DIMS)]


def _sums(docs: DataFrame, frequent) -> DataFrame:
    """(key, v0, ...): neighbours of shapes, of rare words by bucket, and of each word in ``frequent`` (a broadcast, sorted; None for all words)."""

    def run(batches):
        known = None if frequent is None else frequent.value
        for batch in batches:
            for _, _, buf, off in _arrow.chunks(batch.column(0)):
                words, h, shape = _tokens(buf, off)
                if not len(h):
                    continue
                each, at = np.unique(h, return_inverse=True)  # the words that differ, and which each token is
                key = each.astype(np.int64)
                if known is not None:
                    found = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                    key = np.where(known[found] == key, key, _bucket(each)) if len(known) else _bucket(each)
                shapes = np.unique(shape)
                keys, place = np.unique(np.concatenate([key, shapes]), return_inverse=True)
                of_word, of_shape = index(each), index(np.arange(SHAPES, dtype=np.uint64))
                row, shape_row = place[: len(each)] * DIMS, np.zeros(SHAPES, np.int64)
                shape_row[shapes] = place[len(each) :] * DIMS
                pair = np.flatnonzero(words.doc[1:] == words.doc[:-1])
                here, after = at[pair], at[pair + 1]
                # who learns, from which index vectors, turned by how much, how often: counted where few differ
                own, often = np.unique(at * SHAPES + shape, return_counts=True)
                word, kind = own // SHAPES, own % SHAPES
                both = np.bincount(shape[pair] * SHAPES + shape[pair + 1], minlength=1)
                side = np.flatnonzero(both)
                left, right = side // SHAPES, side % SHAPES
                counted = ((row[word], of_shape[:, kind], 2, often), (shape_row[kind], of_word[:, word], 3, often), (shape_row[left], of_shape[:, right], 1, both[side]), (shape_row[right], of_shape[:, left], 0, both[side]))
                total = np.zeros(len(keys) * DIMS, np.int64)
                for k, sign in ((0, 1), (1, 1), (2, -1), (3, -1)):
                    cells = np.concatenate([row[here] + (of_word[k][after] + 1 & DIMS - 1), row[after] + of_word[k][here]])
                    total += sign * np.bincount(cells, minlength=len(total))
                    cells = np.concatenate([who + (near[k] + turn & DIMS - 1) for who, near, turn, _ in counted])
                    total += sign * np.bincount(cells, np.concatenate([n for *_, n in counted]), len(total)).astype(np.int64)
                table = total.reshape(len(keys), DIMS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(DIMS))], ["key", *_NAMES])

    rows = docs.select("text").mapInArrow(_arrow.tidy(run), "key bigint, " + ", ".join(f"{n} int" for n in _NAMES))
    return rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in _NAMES])


@dataclass
class Vectors:
    """(key, v: DIMS half-precision numbers) of shapes, buckets and words, stored; local where they are few."""

    table: DataFrame
    count: int
    local: object = None  # a broadcast of (sorted keys, matrix)


def word_vectors(docs: DataFrame, least: int | None = None) -> Vectors:
    """Unit vectors from the neighbours in every text of ``docs``."""
    least = LEAST if least is None else least
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "vectors")
    counts = scratch.write(count_words(docs).where(F.col("n") >= least).select("word"), "words")
    few = counts.count() <= WORDS
    if few:
        known = spark.sparkContext.broadcast(np.sort(counts.toPandas()["word"].to_numpy(np.int64)))
        sums = scratch.write(_sums(docs, known), "sums")
    else:  # all words, of which the rare ones go to their buckets afterwards
        every = scratch.write(_sums(docs, None), "every")
        own = every.join(counts.withColumnRenamed("word", "key"), "key", "left_semi")
        rest = every.join(counts.withColumnRenamed("word", "key"), "key", "left_anti")
        bucket = F.when(F.col("key").between(0, SHAPES - 1), F.col("key")).otherwise(SHAPES + F.pmod(F.pmod("key", F.lit(RARE)), F.lit(RARE)))
        rest = rest.withColumn("key", bucket).groupBy("key").agg(*[F.sum(n).alias(n) for n in _NAMES])
        sums = scratch.write(own.unionByName(rest), "sums")
    damped = lambda n: F.signum(n) * F.log1p(F.abs(n))
    mean = sums.agg(*[F.avg(damped(n)).alias(n) for n in _NAMES]).head()
    mean = np.array([mean[n] or 0.0 for n in _NAMES])

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy().astype(np.float64) for k in range(DIMS)], axis=1)
            x = np.sign(x) * np.log1p(np.abs(x)) - mean
            x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "v"])

    out = Vectors(scratch.write(sums.mapInArrow(run, "key bigint, v binary"), "vectors"), 0)
    out.count = out.table.count()
    if few:
        out.local = spark.sparkContext.broadcast(_matrix(out.table.toArrow()))
    return out


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their vectors); a vector of zeros at the end stands for what has none."""
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    flat = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float16).reshape(len(keys), DIMS)
    return keys[order], np.concatenate([flat[order], np.zeros((1, DIMS), np.float16)])


def _lookup(keys: np.ndarray, wanted: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``wanted`` keys; where there is none, of ``other``; else the last."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, at, len(keys) if other is None else _lookup(keys, other)) if not hit.all() else at


def pooled(buf: np.ndarray, off: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of features for each document."""
    words, h, s = _tokens(buf, off)
    keys, matrix = vectors
    out = np.zeros((words.docs, 3 * DIMS + 1), np.float32)
    out[:, -1] = np.log1p(words.count)
    full = np.flatnonzero(words.count > 0)
    if not len(full):
        return out
    n = words.count[full, None].astype(np.float32)
    at = words.first[:-1][full]
    v = matrix[_lookup(keys, h.astype(np.int64), _bucket(h))].astype(np.float32)
    out[full, :DIMS] = np.add.reduceat(v, at, axis=0) / n
    share = np.zeros((words.docs, SHAPES), np.float32)
    np.add.at(share.reshape(-1), words.doc * SHAPES + s, np.float32(1))
    out[full, DIMS : 2 * DIMS] = share[full] @ matrix[_lookup(keys, np.arange(SHAPES))].astype(np.float32) / n
    v[:-1] *= v[1:]
    v[words.first[1:][full] - 1] = 0
    out[full, 2 * DIMS : 3 * DIMS] = np.add.reduceat(v, at, axis=0) / np.maximum(n - 1, 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)  # no document lies far outside what was learned from
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, aside: int = 6) -> Network:
    """Adam on the logistic loss; each ``aside``-th row fits the temperature instead."""
    rng = np.random.default_rng(7)
    x = x.astype(np.float64)
    order = rng.permutation(len(x))
    hold, own = order[::aside], np.delete(order, np.s_[::aside])
    if not len(own):
        own = order
    mean, scale = x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-6)
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(err, p[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ err + decay * p[2], np.array([err.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logit, best = net.logit(x[hold]), (np.inf, 1.0)
    for t in np.geomspace(0.3, 10, 60):
        q = np.clip(1 / (1 + np.exp(-np.clip(logit / t, -30, 30))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[hold] * np.log(q) + (1 - y[hold]) * np.log(1 - q)).mean()), float(t)))
    net.temperature = best[1]
    return net


def _mapped(rows: DataFrame, vectors: Vectors, schema: str, one) -> DataFrame:
    """Rows with a text in column 1: their pooled features given to ``one(batch, first, end, x)``."""
    if vectors.local is not None:
        local = vectors.local

        def run(batches):
            for batch in batches:
                for first, end, buf, off in _arrow.chunks(batch.column(1)):
                    yield one(batch, first, end, pooled(buf, off, local.value))

        return rows.mapInArrow(_arrow.tidy(run), schema)

    scratch = Scratch(rows.sparkSession, "pooled")
    names = rows.columns
    size = rows.agg(F.sum(F.octet_length(names[1]))).head()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    # rows are dealt singly, so that equal ones do not meet; stored, so that a row's group stays what it is
    dealt = scratch.write(rows.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), "dealt")

    def needed(batches):
        for batch in batches:
            group = batch.column(0).to_numpy()
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                words, h, _ = _tokens(buf, off)
                g = group[first:end][words.doc]
                for k in np.unique(g):
                    own = np.unique(h[g == k])
                    keys = np.concatenate([own.astype(np.int64), np.unique(_bucket(own))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k)), pa.array(keys)], ["_g", "key"])

    words = dealt.select("_g", names[1]).mapInArrow(_arrow.tidy(needed), "_g bigint, key bigint")
    shapes = dealt.select("_g").distinct().withColumn("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHAPES - 1).cast("bigint"))))
    held = words.unionByName(shapes).distinct().join(vectors.table, "key")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _matrix(right)
        parts = []
        for batch in left.select(names).combine_chunks().to_batches():
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                parts.append(one(batch, first, end, pooled(buf, off, own)))
        return pa.Table.from_batches(parts)

    return dealt.groupBy("_g").cogroup(held.groupBy("_g")).applyInArrow(meet, schema)


def fit(docs: DataFrame, labels: DataFrame, vectors: Vectors, learn: Column | None = None, max_labels: int = 20_000) -> Network | float:
    """A network from the labelled rows that ``learn`` allows, or a constant score."""

    def one(batch, first, end, x):
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _mapped(labelled(docs, labels, max_labels, learn).select("doc_id", "text", "label"), vectors, f"doc_id {kind}, label double, x array<float>", one)
    rows = rows.toPandas().sort_values("doc_id")
    y = (rows["label"] >= 0.5).to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return train(np.stack(rows["x"].to_list()), y)


def score(docs: DataFrame, model: Network | float, vectors: Vectors) -> DataFrame:
    """(doc_id, score) of every row; no shuffle while the vectors go to every task."""

    def one(batch, first, end, x):
        value = model.probability(x) if isinstance(model, Network) else np.full(end - first, model)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(value.astype(np.float64))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs.select("doc_id", "text"), vectors, f"doc_id {kind}, score double", one)
