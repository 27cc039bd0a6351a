"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts, vectorised over a batch. The trees are fitted
on a bounded sample of labelled rows (``max_labels``), by histograms, with
monotonic constraints: more symbols, repeated lines, repeated words or capitals
never make a document better. They are flattened into node arrays, and a batch
is scored level by level with array indexing.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``. A document
fails the base rule with fewer than ``min_words`` words, or if more than half of
its words lie in three-word windows that occur twice or more.

Null and empty texts have no words and fail. Repeated rows get equal verdicts.
Very long texts are one row's work. Without labels of both kinds the trees keep
everything, and the base rule alone decides. An empty table gives no rows. Extra
columns of the input are carried by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow
from ._labels import labelled
from ._shared import packed

SYMBOLS = b"#*$%&|<>"

_CLASS = {name: np.zeros(256, np.uint8) for name in ("symbol", "upper", "lower", "digit", "mark")}
_CLASS["symbol"][list(SYMBOLS)] = 1
_CLASS["upper"][65:91] = 1
_CLASS["lower"][97:123] = 1
_CLASS["digit"][48:58] = 1
_CLASS["mark"][[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "wide", "line_words")
#: Sign of each feature's effect on quality, 0 where it is free.
MONOTONE = dict(zip(FEATURES, (0, 0, -1, -1, -1, -1, 0, 0, 0, 0, 0), strict=True))


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (doc, h) occur twice or more."""
    key = _arrow.mix(h ^ _arrow.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    key = _arrow.mix(h ^ _arrow.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc[first], minlength=docs)


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each document of flat bytes."""
    words = _arrow.Words(buf, off)
    docs = words.docs
    h = words.hashes()
    point = (buf & 0xC0) != 0x80
    out = {"n_words": words.count.astype(np.int64), "word_chars": _arrow.per_doc(point & words.ink, off)}
    for name, table in _CLASS.items():
        out[f"n_{name}"] = _arrow.per_doc(table[buf], off)
    out["n_points"] = _arrow.per_doc(point, off)

    at, window = words.windows(3, h)
    cover = np.zeros(len(h) + 2, bool)
    again = at[_repeated(words.doc[at], window)]
    for k in range(3):
        cover[again + k] = True
    out["n_repeat"] = _arrow.per_doc(cover[: len(h)], words.first)
    out["n_distinct"] = _distinct(words.doc, h, docs)

    feed = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([off[:-1], feed + 1]))
    end = np.sort(np.concatenate([off[1:], feed]))
    doc = np.searchsorted(off, end, "right") - 1
    doc = np.minimum(doc, docs - 1)
    # an empty text shares its offset with the next; lines without ink are dropped next anyway
    ink = np.concatenate([[0], np.cumsum(words.ink)])
    full = ink[end] > ink[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(off, start, "right") - 1
    out["n_lines"] = np.bincount(doc, minlength=docs)
    out["n_dup"] = out["n_lines"] - _distinct(doc, _arrow.segment_hash(buf, start, end), docs)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(s["n_words"], 1)
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    points = np.maximum(s["n_points"], 1)
    return np.stack(
        [np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbol"] / n, s["n_dup"] / np.maximum(s["n_lines"], 1), s["n_repeat"] / n, s["n_upper"] / letters, s["n_digit"] / points, s["n_mark"] / n, s["n_distinct"] / n, (s["word_chars"] - s["n_upper"] - s["n_lower"] - s["n_digit"] - s["n_mark"]) / points, n / np.maximum(s["n_lines"], 1)],
        axis=1,
    )


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


class Booster:
    """Second-order boosting of the logistic loss on binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray, sign: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        base = float(np.log(rate / (1 - rate)))
        nodes: list[list[float]] = []
        roots, margin = [], np.full(len(y), base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            self._grow(nodes, np.arange(len(y)), code, cuts, p - y, np.maximum(p * (1 - p), 1e-6), sign, -np.inf, np.inf, 0, margin)
        table = np.array(nodes)
        return Trees(np.array(roots), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], base, self.depth)

    def _grow(self, nodes, rows, code, cuts, g, h, sign, low, high, depth, margin) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best_value = float(np.clip(-total_g / (total_h + self.ridge), low, high))
        nodes.append([0, 0.0, me, me, self.rate * best_value])
        split = self._split(rows, code, g, h, total_g, total_h, sign, low, high, best_value) if depth < self.depth else None
        if split is None:
            margin[rows] += self.rate * best_value
            return me
        j, b, wl, wr = split
        middle = (wl + wr) / 2
        go = code[rows, j] <= b
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(sign[j])]
        left = self._grow(nodes, rows[go], code, cuts, g, h, sign, *bounds[0], depth + 1, margin)
        right = self._grow(nodes, rows[~go], code, cuts, g, h, sign, *bounds[1], depth + 1, margin)
        nodes[me] = [j, float(cuts[j][b]), left, right, 0.0]
        return me

    def _split(self, rows, code, g, h, total_g, total_h, sign, low, high, w):
        best, found = 1e-4, None
        loss = lambda sg, sh, v: sg * v + 0.5 * (sh + self.ridge) * v * v
        here = loss(total_g, total_h, w)
        for j in range(code.shape[1]):
            own = code[rows, j]
            gl = np.cumsum(np.bincount(own, g[rows], self.bins))[:-1]
            hl = np.cumsum(np.bincount(own, h[rows], self.bins))[:-1]
            gr, hr = total_g - gl, total_h - hl
            wl = np.clip(-gl / (hl + self.ridge), low, high)
            wr = np.clip(-gr / (hr + self.ridge), low, high)
            gain = here - loss(gl, hl, wl) - loss(gr, hr, wr)
            gain[(hl < self.least) | (hr < self.least) | (sign[j] * (wr - wl) < 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, k, float(wl[k]), float(wr[k]))
        return found


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Trees | None:
    """Trees from a bounded sample of labelled rows; None without labels of both kinds."""

    def run(batches):
        for batch in batches:
            for first, end, buf, off in _arrow.chunks(batch.column("text")):
                x = features(statistics(buf, off))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, end - first) for c in ("doc_id", "label")] + [pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = labelled(docs, labels, max_labels).mapInArrow(_arrow.tidy(run), f"doc_id {kind}, label double, x array<double>")
    rows = rows.toPandas().sort_values("doc_id")
    if not len(rows) or not 0 < (rows["label"] >= 0.5).sum() < len(rows):
        return None
    return Booster().fit(np.stack(rows["x"].to_list()), (rows["label"] >= 0.5).to_numpy(float), np.array([MONOTONE[f] for f in FEATURES]))


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, threshold: float = 0.3) -> DataFrame:
    """The id with the statistics, base verdict, verdict and score of every row; no shuffle."""

    def run(batches):
        for batch in batches:
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                s = statistics(buf, off)
                n, repeat = s["n_words"], s["n_repeat"]
                failed = (n < min_words) | (100 * repeat > 50 * n)
                score = trees.probability(features(s)) if trees is not None else np.ones(len(n))
                cols = [n, s["word_chars"], s["n_symbol"], s["n_dup"], repeat]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(c, pa.int64()) for c in cols), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["id", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_arrow.tidy(run), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, trees: Trees | None, text_col: str = "text", min_words: int = 50, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def run(batches):
        for batch in batches:
            keep = []
            for _, _, buf, off in _arrow.chunks(batch.column(1)):
                s = statistics(buf, off)
                n, repeat = s["n_words"], s["n_repeat"]
                ok = (n >= min_words) & (100 * repeat <= 50 * n)
                keep.append(ok & (trees.probability(features(s)) >= threshold) if trees is not None else ok)
            yield batch.filter(pa.array(np.concatenate(keep)) if keep else pa.array([], pa.bool_()))

    rows = docs.select(packed(docs, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_arrow.tidy(run), rows.schema)
    return out.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
