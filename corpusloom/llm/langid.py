"""Language identification by prediction by partial matching.

For each language, a context tree of bytes up to order ``ORDER`` is counted on a
bounded sample of its documents (``per_lang``) and then frozen. The code length
of a byte is that of method C: the deepest context in the tree codes it, or
escapes to the next shorter one, down to 8 bits for a byte never seen. A text's
language is that with the shortest total code.

Every context and every symbol seen in it is kept, whatever their number. As
statistics are frozen, the code length of each seen symbol is worked out once, with
all escapes that lead to it; a symbol that no language has seen in a context adds the
context's escapes and goes on with the next shorter one. Tables are sparse: an entry
for each symbol seen, not for each that could be.

Languages code independently of each other, so that they may be dealt into groups: a
group's tables are made on the driver and broadcast, and ``GRAMS`` and ``LANGS`` bound
them. Languages beyond one group are further passes over the texts, between which the
best so far is stored with each row.

A null text, or one without a letter, is ``und`` with score 0. The score is the
posterior of the language under equal priors. Ties go to the first language by
name. Repeated rows get equal results; a row without an id is never learned from
and counts as held out. Very long texts are worked through in slices. With nothing
to learn from, every row is ``und``. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _arrow
from ._shared import Scratch

ORDER = 3
#: A group's languages, and the distinct windows of bytes that they have (a language with more is a group alone).
LANGS, GRAMS = 16, 1_000_000
#: Values (byte by language) that are summed at once.
SLICE = 1 << 21


@dataclass
class Model:
    """The trees of a group of languages.

    ``row`` is the deepest context of each history of ``ORDER`` symbols; ``seen`` are the sorted codes of (context,
    symbol) that some language has, with their ``bits`` [entry, language]; ``escape`` [context, language] and
    ``shorter`` lead on from a context for other symbols.
    """

    langs: list[str]
    symbol: np.ndarray  # of each byte; the last symbol stands for all bytes never seen
    row: np.ndarray
    seen: np.ndarray
    bits: np.ndarray
    escape: np.ndarray
    shorter: np.ndarray


def _slices(off: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    for a in range(0, int(off[-1]), step):
        yield a, min(a + step, int(off[-1]))


def _before(buf: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document, [byte k before] for k of 1 to ``ORDER``) of the bytes ``a:b``; zeros come before a text."""
    at = np.arange(a, b)
    doc = np.searchsorted(off, at, "right") - 1
    start = off[doc]
    return doc, [np.where(at - k >= start, buf[np.maximum(at - k, 0)], 0).astype(np.uint8) for k in range(1, ORDER + 1)]


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of all windows of ORDER + 1 bytes in (lang, text); a text begins after zero bytes."""

    def run(batches):
        for batch in batches:
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=str), return_inverse=True)
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                for a, b in _slices(off, 1 << 20):
                    doc, back = _before(buf, off, a, b)
                    gram = buf[a:b].astype(np.int64)
                    for k, x in enumerate(back, 1):
                        gram |= x.astype(np.int64) << 8 * k
                    own, n = np.unique(code[first:end][doc] << 32 | gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(langs[own >> 32].astype(object), pa.string()), pa.array(own & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(_arrow.tidy(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """Frozen statistics: (lang, gram, n, group), stored, and the number of groups."""

    grams: DataFrame
    groups: int

    def model(self, group: int) -> Model:
        rows = self.grams.where(F.col("group") == group).select("lang", "gram", "n").toPandas()
        return compile_trees(sorted(rows["lang"].unique()), rows["lang"].to_numpy(), rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))


def fit(docs: DataFrame, learn: Column, per_lang: int = 2000) -> Trees | None:
    """Trees of every language in ``docs``, from about ``per_lang`` documents each that ``learn`` allows."""
    scratch = Scratch(docs.sparkSession, "ppm")
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    have = scratch.write(known.groupBy("lang").agg(F.count(F.lit(1)).alias("have")), "langs")
    some = F.broadcast(have) if have.count() <= 100_000 else have
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    grams = scratch.write(count_grams(known.join(some, "lang").where(draw < per_lang / F.col("have"))), "grams")
    # a row a language: dealt in order of their names, so that a tie goes to the first group
    w = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grams.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"))
    cost = F.greatest(F.col("grams") / GRAMS, F.lit(1.0 / LANGS))
    group = F.floor(F.coalesce(F.sum(cost).over(w), F.lit(0.0)) + 1e-9).cast("int")
    dealt = scratch.write(sizes.withColumn("group", F.dense_rank().over(Window.orderBy(group)) - 1).select("lang", "group"), "dealt")
    last = dealt.agg(F.max("group")).head()[0]
    if last is None:
        return None
    grouped = scratch.write(grams.join(dealt, "lang"), "grouped") if last else grams.withColumn("group", F.lit(0))
    return Trees(grouped, last + 1)


def compile_trees(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Code lengths from the counts of ``gram`` (oldest byte highest) in each language."""
    byte = np.stack([(gram >> 8 * k) & 255 for k in range(ORDER, -1, -1)], axis=1)
    known = np.unique(np.concatenate([byte.reshape(-1), [0]]))
    symbol = np.full(256, len(known), np.int64)
    symbol[known] = np.arange(len(known))
    size, many = len(known) + 1, len(langs)
    s = symbol[byte]
    who = np.searchsorted(langs, lang.astype(str)) if len(lang) else np.zeros(0, np.int64)

    seen, bits = np.zeros(0, np.int64), np.zeros((0, many))
    escapes, shorter = [], []
    contexts_before, first_before, first = np.zeros(0, np.int64), 0, 0
    row = np.zeros((size,) * ORDER, np.int32)
    for k in range(ORDER + 1):
        ctx = np.zeros(len(s), np.int64)
        for j in range(ORDER - k, ORDER):
            ctx = ctx * size + s[:, j]
        contexts = np.unique(ctx) if k else np.zeros(1, np.int64)
        at = np.searchsorted(contexts, ctx)
        # counts of each (context, symbol) by language, and of each context
        codes, entry = np.unique((at + first) * size + s[:, ORDER], return_inverse=True)
        count = np.zeros((len(codes), many))
        np.add.at(count, (entry, who), n)
        own = codes // size - first
        total, kinds = np.zeros((len(contexts), many)), np.zeros((len(contexts), many))
        np.add.at(total, own, count)
        np.add.at(kinds, own, (count > 0).astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            code = np.log2((total + kinds)[own] / count)
        if k:
            up = first_before + np.searchsorted(contexts_before, contexts % size ** (k - 1))
            lower = bits[np.searchsorted(seen, up[own] * size + codes % size)]
        else:
            up, lower = np.full(1, -1), np.full((len(codes), many), 8.0)
        seen, bits = np.concatenate([seen, codes]), np.concatenate([bits, np.where(count > 0, code, escape[own] + lower)])
        escapes.append(escape)
        shorter.append(up)
        if k:
            row[(..., *[(contexts // size ** (k - 1 - j)) % size for j in range(k)])] = first + np.arange(len(contexts))
        contexts_before, first_before, first = contexts, first, first + len(contexts)
    return Model(list(langs), np.minimum(symbol, size - 1), row.reshape(-1), seen, bits.astype(np.float32), np.concatenate(escapes).astype(np.float32), np.concatenate(shorter))


def code_lengths(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    size = round(len(model.row) ** (1 / ORDER))
    out = np.zeros((len(off) - 1, len(model.langs)))
    last = max(0, len(model.seen) - 1)
    for a, b in _slices(off, max(1 << 14, SLICE // max(1, len(model.langs)))):
        doc, back = _before(buf, off, a, b)
        history = np.zeros(b - a, np.int64)
        for x in reversed(back):
            history = history * size + model.symbol[x]
        now, at, own = model.row[history].astype(np.int64), np.arange(b - a), model.symbol[buf[a:b]]
        bits = np.zeros((b - a, len(model.langs)), np.float32)
        while len(at):
            code = now * size + own
            entry = np.minimum(np.searchsorted(model.seen, code), last)
            hit = model.seen[entry] == code if len(model.seen) else np.zeros(len(at), bool)
            bits[at[hit]] += model.bits[entry[hit]]
            at, own, now = at[~hit], own[~hit], now[~hit]
            bits[at] += model.escape[now]
            now = model.shorter[now]
            never = now < 0
            bits[at[never]] += 8
            at, own, now = at[~never], own[~never], now[~never]
        full, starts = np.unique(doc, return_index=True)
        out[full] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
    return out


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    letter = _arrow.per_doc(_LETTER[buf], off) > 0
    for i in np.flatnonzero(~letter & (_arrow.per_doc(buf >= 128, off) > 0)):
        letter[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return letter


def _verdicts(ids: pa.Array, buf: np.ndarray, off: np.ndarray, lang: np.ndarray, lead: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    ok = _lettered(buf, off) & np.isfinite(lead)
    score = np.where(ok, 1 / np.maximum(total, 1), 0.0)
    rate = np.where(ok, lead / np.maximum(np.diff(off), 1), 0.0)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.where(ok, lang, "und"), pa.string()), pa.array(score), pa.array(rate)], ["id", "lang_pred", "score", "bits_per_byte"])


VERDICTS = "lang_pred string, score double, bits_per_byte double"


def _pass(rows: DataFrame, model, last: bool) -> DataFrame:
    """``rows`` (id, text, lang, lead, sum) with the best of another group's languages, or the verdicts after the last; ``model`` is a broadcast.

    ``lead`` is the shortest code so far and ``sum`` that of 2 ** (lead - code) over all languages so far.
    """

    def run(batches):
        m = model.value
        for batch in batches:
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                n = end - first
                old = [batch.column(k).slice(first, n) for k in (2, 3, 4)]
                lang, lead, total = np.array(old[0].to_pylist(), object), old[1].to_numpy(zero_copy_only=False), old[2].to_numpy(zero_copy_only=False)
                bits = code_lengths(m, buf, off)
                best = bits.min(axis=1)
                ours = np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(axis=1)
                wins = best < lead
                low = np.minimum(best, lead)
                total = ours * np.exp2(np.maximum(low - best, -1000)) + np.where(np.isinf(lead), 0, total * np.exp2(np.maximum(low - lead, -1000)))
                lang[wins] = np.array(m.langs, object)[bits.argmin(axis=1)[wins]]
                if last:
                    yield _verdicts(batch.column(0).slice(first, n), buf, off, lang, low, total)
                    continue
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(lang, pa.string()), pa.array(low), pa.array(total)], ["id", "text", "lang", "lead", "sum"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_arrow.tidy(run), f"id {kind}, {VERDICTS}" if last else rows.schema)


def identify(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, bits_per_byte) of every row. No shuffle; one pass for each group of languages."""
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`")
    if trees is None:
        return docs.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(float("inf")).alias("lead"), F.lit(0.0).alias("sum"))
    scratch = Scratch(spark, "languages")
    for g in range(trees.groups):
        last = g + 1 == trees.groups
        model = spark.sparkContext.broadcast(trees.model(g))
        rows = _pass(rows, model, last)
        if not last:
            rows = scratch.write(rows, f"pass{g}")
            model.unpersist()
    return rows.withColumnRenamed("id", id_col)
