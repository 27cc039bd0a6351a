"""Retrieval for many queries at once: lexical and dense rankings, fusion, context."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..sources.tables import stored

#: Values of a query block that a task multiplies at once (numbers of 8 bytes), and queries of one set.
BLOCK_VALUES, QUERY_ROWS = 100_000, 100_000

#: Rows (query, token) of a query set that may be broadcast, about 50 bytes each.
BROADCAST_ROWS = 1_000_000

#: Documents and scores that a task of the lexical ranking makes at once, and distinct tokens that one counts before it hands them on.
SCORE_ROWS, SCORE_VALUES, HELD_TOKENS = 64, 2_000_000, 1_000_000

#: What Python takes for white space and Java does not, and the white space of both.
_SEPARATORS, _SPACE = re.compile("[\x1c-\x1f]"), re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def units(cards: DataFrame, fields: list[str], questions: str, id_col: str = "doc_id") -> DataFrame:
    """(id, unit, text): title-like fields and each question as a unit; empty ones go."""
    one = [F.struct(F.lit(f).alias("unit"), F.col(f).alias("text")) for f in fields]
    many = F.transform(F.coalesce(F.col(questions), F.array().cast("array<string>")), lambda q: F.struct(F.lit("question").alias("unit"), q.alias("text")))
    rows = cards.select(id_col, F.explode(F.concat(F.array(*one), many)).alias("u")).select(id_col, "u.unit", "u.text")
    return rows.where(X.strip(F.coalesce("text", F.lit(""))) != "")


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, token, tf)"""
    return docs.select(id_col, F.explode(tokens).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))


def _bounded(side: DataFrame, rows: int) -> DataFrame:
    """``side`` to be broadcast if ``rows`` are few enough; otherwise the join shuffles."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def lexical_statistics(docs: DataFrame, n: int = 4) -> DataFrame:
    """(token, df) of ``docs`` (doc_id, text): in how many documents each token is. Combined before the shuffle."""
    return _counted(docs, n).where("token is not null").select("token", "df")


def _counted(docs: DataFrame, n: int) -> DataFrame:
    """(token, df, size) of ``docs``; without a token, how many documents and tokens there are."""

    def run(batches):
        codes, known, rest, n_docs, size = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), Counter(), 0, 0

        def partly():
            code, df = known[0], known[1].tolist()
            names = _unpacked(code, n) + list(rest)
            return pa.RecordBatch.from_pydict({"token": pa.array(names, pa.string()), "df": pa.array(df + list(rest.values()), pa.int64()), "size": pa.array([0] * len(names), pa.int64())})

        held = 0
        for batch in batches:
            for text in batch.column(0):
                code, words = _bag(text.as_py() or "", n)
                n_docs, size = n_docs + 1, size + len(code) + len(words)
                codes.append(_tallied(code)[0])
                rest.update(set(words))
                held += len(codes[-1])
                if held > HELD_TOKENS:
                    known, codes, held = _added(known, _tallied(np.concatenate(codes))), [], 0
                if len(known[0]) + len(rest) > HELD_TOKENS:
                    # what was tallied goes on; texts that wait for their tally wait longer
                    yield partly()
                    known, rest = (known[0][:0], known[1][:0]), Counter()
        if codes:
            known = _added(known, _tallied(np.concatenate(codes)))
        yield partly()
        yield pa.RecordBatch.from_pydict({"token": pa.array([None], pa.string()), "df": pa.array([n_docs], pa.int64()), "size": pa.array([size], pa.int64())})

    found = docs.select("text").mapInArrow(run, "token string, df bigint, size bigint")
    return found.groupBy("token").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))


def _tallied(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each comes: sorted, as ``np.unique`` without counts hashes, which takes longer."""
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.concatenate([first, [len(code)]]))


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tallies as one."""
    code, many = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.argsort(code, kind="stable")
    code, many = code[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(many, first) if len(first) else many


def _words(text: str) -> list[str]:
    """``text`` split at white space, as Java's ``(?U)\\s`` has it: without the four separators that Python adds."""
    return text.split() if not _SEPARATORS.search(text) else [w for w in _SPACE.split(text) if w]


def _bag(text: str, n: int) -> tuple[np.ndarray, list[str]]:
    """What ``lexical_tokens`` has: tokens of ``n`` code points that fit in 64 bits as numbers, the others as they are."""
    words = _words(text)
    if n > 4:
        return np.zeros(0, np.uint64), [text[k : k + n] for k in range(len(text) - n + 1)] + words
    c = np.frombuffer(text.encode("utf-16-le"), np.uint16).astype(np.uint64)
    if len(c) == len(text):
        some = max(0, len(c) - n + 1)
        code = c[:some].copy()
        for k in range(1, n):
            code |= c[k : k + some] << np.uint64(16 * k)
        short = [w for w in words if len(w) == n]
        if not short:
            return code, words
        return np.concatenate([code, np.frombuffer("".join(short).encode("utf-16-le"), np.uint16).reshape(-1, n).astype(np.uint64) @ (1 << np.arange(0, 16 * n, 16, dtype=np.uint64))]), [w for w in words if len(w) != n]
    both = [text[k : k + n] for k in range(len(text) - n + 1)] + words
    plain = [g for g in both if len(g) == n and max(g) <= "\uffff"]
    return np.array([_code(g) for g in plain], np.uint64), [g for g in both if len(g) != n or max(g) > "\uffff"]


def _code(token: str) -> int:
    return int.from_bytes(token.encode("utf-16-le"), "little")


def _unpacked(code: np.ndarray, n: int) -> list[str]:
    cells = (code[:, None] >> np.arange(0, 16 * min(n, 4), 16, dtype=np.uint64)[None, :]) & np.uint64(0xFFFF)
    text = cells.astype("<u2").tobytes().decode("utf-16-le")
    return [text[k : k + n] for k in range(0, len(text), n)]


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 30, n: int = 4, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, same_work: bool = False, fill: bool = False, statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for ``docs`` (doc_id, text) and ``queries`` (query_id, text).

    Document frequencies are of the whole vocabulary, as the mean idf needs them; ``statistics`` gives those of
    ``lexical_statistics`` if an index has them. From there on only tokens of queries count: while these
    are few and no id is null or repeated, each task scores its documents against all queries and keeps the best
    ``k`` of each. A repeated query token counts repeatedly. A negative idf becomes ``floor`` times the mean idf.

    With ``same_work`` only documents of a query's ``work`` are ranked (both sides have that column); statistics
    are still those of all. With ``fill`` a query that fewer than ``k`` documents share a token with gets
    the first others by id, with score 0.
    """
    bag = X.lexical_tokens(F.col("text"), n)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    asked = queries.withColumn("text", F.coalesce("text", F.lit("")))
    tokens = stored(postings(asked, "query_id", bag).withColumnRenamed("tf", "qf"), "asked")
    rows = tokens.count()
    if statistics is None:
        counted = stored(_counted(docs, n), "df")
        df = counted.where("token is not null").select("token", "df")
        n_docs, size = counted.where("token is null").agg(F.sum("df"), F.sum("size")).first()
        avgdl = size / n_docs if n_docs else None
    else:
        df = stored(statistics, "df")
        n_docs, avgdl = docs.agg(F.count(F.lit(1)), F.avg(X.lexical_length(F.col("text"), n))).first()
    idf = df.select("token", F.lit(avgdl).cast("double").alias("avgdl"), (F.log(F.lit(n_docs or 0) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    wanted = tokens.select("token").distinct()
    plan = idf.join(_bounded(wanted, rows), "token").join(F.broadcast(mean)).select("token", "avgdl", F.when(F.col("idf") < 0, floor * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    plan = plan.join(_bounded(tokens, rows), "token")
    if rows <= BROADCAST_ROWS and not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").take(1):
        return top(_best(docs, asked, plan.select("token", "query_id", (F.col("qf") * F.col("idf")).alias("weight")), avgdl or 1.0, k, n, k1, b, same_work, fill), k)
    length = X.lexical_length(F.col("text"), n).alias("dl")
    tf = _query_tokens(docs.select("doc_id", "text", length), wanted, n)
    weight = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = tf.join(_bounded(plan, rows), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    if same_work:
        score = score.join(asked.select("query_id", "work"), "query_id").join(docs.select("doc_id", "work"), ["doc_id", "work"]).select("query_id", "doc_id", "score")
    score = stored(score, "scores")
    best = top(score, k)
    if not fill:
        return best
    # at most k documents come before the k-th that shares no token: the first 2k by id are enough for every query
    first = lambda d: d.select("doc_id").orderBy("doc_id").limit(2 * k)
    if same_work:
        w = Window.partitionBy("work").orderBy("doc_id")
        early = docs.select("doc_id", "work", F.row_number().over(w).alias("_k")).where(F.col("_k") <= 2 * k)
        none = asked.select("query_id", "work").join(early, "work").select("query_id", "doc_id")
    else:
        none = asked.select("query_id").join(F.broadcast(first(docs)))
    none = none.join(score.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(best.drop("rank").unionByName(none), k)


def _query_tokens(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, dl, token, tf) of the tokens that are ``wanted``, from (doc_id, text, dl)."""
    bag = X.lexical_tokens(F.col("text"), n)
    return docs.select("doc_id", "dl", F.explode(bag).alias("token")).join(wanted, "token", "left_semi").groupBy("doc_id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def _best(docs: DataFrame, asked: DataFrame, plan: DataFrame, avgdl: float, k: int, n: int, k1: float, b: float, same_work: bool, fill: bool) -> DataFrame:
    """(query_id, doc_id, score): for each query its best ``k`` documents of every task, by ``plan`` (token, query_id, weight).

    Weights are held by token; a slice of documents becomes a matrix with a column for each query. With ``same_work``
    they are held by token and work, and a document meets those of its own work alone. Ids are neither null nor repeated.
    """
    works = ["work"] if same_work else []
    who = [tuple(r) for r in asked.select("query_id", *(F.col(w).cast("string") for w in works)).distinct().where("query_id is not null").collect()]
    if same_work:
        who = [r for r in who if r[1] is not None]
    columns: dict = {}
    for i, r in enumerate(who):
        columns.setdefault(r[0], []).append(i)
    said = [(t, i, w) for t, q, w in plan.toPandas().itertuples(index=False, name=None) for i in columns.get(q, ())]
    held = docs.sparkSession.sparkContext.broadcast((who, sorted({t for t, _, _ in said}), said))
    kinds = {c: d.schema[c].dataType for c, d in (("query_id", asked), ("doc_id", docs))}
    number = kinds["doc_id"].typeName() in ("long", "integer", "short", "byte")

    def run(batches):
        who, names, said = held.value
        at = {t: i for i, t in enumerate(names)}
        said = sorted((at[t], i, w) for t, i, w in said)
        of, column, weight = (np.array([x[c] for x in said], kind) for c, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
        first = None if same_work else np.searchsorted(of, np.arange(len(names) + 1))
        coded = sorted((_code(t), i) for t, i in at.items() if n <= 4 and len(t) == n and max(t) <= "\uffff")
        code, code_at = np.array([c for c, _ in coded], np.uint64), np.array([i for _, i in coded], np.int64)
        work_at = {w: i for i, w in enumerate(sorted({r[1] for r in who}))} if same_work else {}
        own = np.array([work_at[r[1]] for r in who], np.int64) if same_work else None
        if same_work:
            slot = of * len(work_at) + own[column]
            order = np.argsort(slot, kind="stable")
            slot, column, weight = slot[order], column[order], weight[order]
            # where each slot begins: looked up while that is a small table, otherwise searched for
            few = len(names) * len(work_at) <= SCORE_VALUES
            first = np.searchsorted(slot, np.arange(len(names) * len(work_at) + 1)) if few else None
        width, got = len(who), []
        cut, cut_id = np.full(width, -np.inf), np.zeros(width, np.int64 if number else object)

        def fewer():
            q, s, d = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((d if number else np.unique(d, return_inverse=True)[1], -s, q))
            q, s, d = q[order], s[order], d[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            cut[q[last]], cut_id[q[last]] = s[last], d[last]
            got[:] = [(q[place < k], s[place < k], d[place < k])]

        def tokens(text):
            codes, words = _bag(text, n)
            found, count = _tallied(codes)
            where = np.minimum(np.searchsorted(code, found), max(0, len(code) - 1))
            hit = code[where] == found if len(code) else np.zeros(len(found), bool)
            rest = Counter(map(at.get, words))
            rest.pop(None, None)
            ids = np.concatenate([code_at[where[hit]], np.fromiter(rest, np.int64, len(rest))]) if len(code) else np.fromiter(rest, np.int64, len(rest))
            tf = np.concatenate([count[hit], np.fromiter(rest.values(), np.int64, len(rest))])
            return ids, tf * (k1 + 1) / (tf + k1 * (1 - b + b * (len(codes) + len(words)) / avgdl))

        step, waiting = max(1, min(SCORE_ROWS, SCORE_VALUES // max(1, width))), 0
        for batch in batches:
            if not width:
                continue
            ids = np.array(batch.column(0).to_pylist(), np.int64 if number else object)
            for low in range(0, batch.num_rows, step):
                texts = batch.column(1).slice(low, step).to_pylist()
                bags = [tokens(t) for t in texts]
                token, gain = np.concatenate([x for x, _ in bags]), np.concatenate([x for _, x in bags])
                row = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
                if same_work:
                    theirs = np.array([work_at.get(w, -1) for w in batch.column(2).slice(low, step).to_pylist()], np.int64)
                    met = theirs[row] >= 0
                    token, gain, row = token[met], gain[met], row[met]
                    key = token * len(work_at) + theirs[row]
                    begin = first[key] if few else np.searchsorted(slot, key)
                    many = (first[key + 1] if few else np.searchsorted(slot, key, "right")) - begin
                else:
                    begin, many = first[token], first[token + 1] - first[token]
                spot = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat(row, many) * width + column[spot]
                score = np.round(np.bincount(cell, np.repeat(gain, many) * weight[spot], len(bags) * width), 6).reshape(len(bags), width) + 0.0
                some = np.full(len(bags) * width, fill)
                some[cell] = True
                some = some.reshape(len(bags), width)
                if same_work:
                    some &= theirs[:, None] == own[None, :]
                some &= score >= cut
                r, q = np.nonzero(some)
                s, d = score[r, q], ids[low + r]
                new = s > cut[q]
                new[~new] = (d[~new] < cut_id[q[~new]]).astype(bool)
                got.append((q[new], s[new], d[new]))
                waiting += int(new.sum())
                if waiting > max(4 * width * k, 100_000):
                    fewer()
                    waiting = 0
        if got:
            fewer()
            for low in range(0, len(got[0][0]), 100_000):
                q, s, d = (x[low : low + 100_000] for x in got[0])
                yield pa.RecordBatch.from_arrays([pa.array([who[i][0] for i in q.tolist()], to_arrow_type(kinds["query_id"])), pa.array(d.tolist(), to_arrow_type(kinds["doc_id"])), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

    source = docs.select("doc_id", "text", *(F.col(w).cast("string").alias(w) for w in works))
    return source.mapInArrow(run, ", ".join(f"{c} {kind.simpleString()}" for c, kind in kinds.items()) + ", score double")


def top(score: DataFrame, k: int, *ties: str) -> DataFrame:
    """The best ``k`` of each query by score, then by ``ties`` and id; adds ``rank`` from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("doc_id",)))
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarities(units: DataFrame, queries: DataFrame, keep: int, same_work: bool | None = None, mask: bool = False) -> DataFrame:
    """(query_id, unit_id, doc_id, score): for each query its best ``keep`` units of every task.

    Inner products by matrix multiplication of a task's rows with blocks of
    queries. A query set is stated and bounded (``QUERY_ROWS``); a task takes it in blocks, so that
    the units are read once. With
    ``same_work`` True, units of another work than the query's are left out; with
    ``mask`` they score -1, before any is cut off.
    """
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("work").cast("string").alias("work"), "embedding")
    rows = stored(rows.orderBy("query_id"), "queries")
    if (count := rows.count()) > QUERY_ROWS:
        raise ValueError(f"{count} queries at once: more than {QUERY_ROWS}; ask in parts")
    held = rows.toPandas().sort_values("query_id")
    width = len(held["embedding"].iloc[0]) if len(held) else 1
    asked = queries.sparkSession.sparkContext.broadcast((held["query_id"].to_numpy(np.int64), held["work"].to_numpy(object), np.array(held["embedding"].tolist(), np.float64).reshape(len(held), width)))
    step = max(1, BLOCK_VALUES // max(1, width))

    def run(batches):
        ids, works, matrix = asked.value
        best_unit = np.full((len(ids), keep), np.iinfo(np.int64).max)
        best = np.full((len(ids), keep), -np.inf)
        docs: dict[int, str | None] = {}
        work_at = {w: i for i, w in enumerate(dict.fromkeys(works.tolist()))}
        own = np.array([work_at[w] for w in works.tolist()], np.int64)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vec = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            unit = batch.column("unit_id").to_numpy(zero_copy_only=False)
            work = np.array([work_at.get(w, -1) for w in batch.column("work").to_pylist()], np.int64)
            docs.update(zip(unit.tolist(), batch.column("doc_id").to_pylist(), strict=True))
            for first in range(0, len(ids), step):
                block = slice(first, first + step)
                score = np.round(matrix[block] @ vec.T, 6) + 0.0
                if same_work or mask:
                    inside = own[block][:, None] == work[None, :]
                    score = np.where(inside, score, -np.inf if same_work else -1.0)
                best[block], best_unit[block] = _kept(best[block], best_unit[block], score, unit)
            if len(docs) > 4 * best.size:
                used = set(best_unit.reshape(-1).tolist())
                docs = {u: d for u, d in docs.items() if u in used}
        for i, q in enumerate(ids.tolist()):
            full = np.isfinite(best[i])
            u = best_unit[i][full].tolist()
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([q] * len(u), pa.int64()), "unit_id": pa.array(u, pa.int64()), "doc_id": pa.array([docs[x] for x in u], pa.string()), "score": pa.array(best[i][full], pa.float64())})

    source = units.select(F.col("unit_id").cast("bigint").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("work").cast("string").alias("work"), "embedding")
    return source.mapInArrow(run, "query_id bigint, unit_id bigint, doc_id string, score double")


def _kept(best: np.ndarray, named: np.ndarray, score: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of each row of ``best`` (named by ``named``, in order) and of ``score`` (named by ``unit``), then the least names.

    Only scores that could still be among a row's best are sorted.
    """
    keep = best.shape[1]
    score = np.where(np.isnan(score), -np.inf, score)
    cut, last = best[:, -1:], named[:, -1:]
    some = (score > -np.inf) & ((score > cut) | (score == cut) & (unit[None, :] < last))
    if score.shape[1] > keep:
        some &= score >= np.partition(score, score.shape[1] - keep, axis=1)[:, -keep, None]
    q, u = np.nonzero(some)
    if not len(q):
        return best, named
    row = np.concatenate([np.repeat(np.arange(len(best)), keep), q])
    value, name = np.concatenate([best.reshape(-1), score[q, u]]), np.concatenate([named.reshape(-1), unit[u]])
    order = np.lexsort((name, -value, row))
    order = order[np.searchsorted(row[order], np.arange(len(best)))[:, None] + np.arange(keep)]
    return value[order], name[order]


def dense_topk(units: DataFrame, queries: DataFrame, pool: int = 30, scan: int = 240, same_work: bool | None = None, mask: bool = False) -> DataFrame:
    """(query_id, doc_id, score, unit_id, rank): the best distinct documents among each query's best ``scan`` units."""
    best = top(similarities(units, queries, scan, same_work, mask), scan, "unit_id").drop("rank")
    folded = best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min_by("unit_id", F.struct(-F.col("score"), F.col("unit_id"))).alias("unit_id"))
    return top(folded, pool)


def rrf(first: DataFrame, second: DataFrame, top_k: int, k: int = 60, pool: int = 30) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (query_id, doc_id, rank); ties keep the first ranking's order, then the second's."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(second.select("query_id", "doc_id", F.lit(None).cast("int").alias("a"), F.col("rank").alias("b")))
    one = both.groupBy("query_id", "doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    gain = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    one = one.withColumn("score", F.round(gain("a") + gain("b"), 9)).withColumn("tie", F.coalesce("a", pool + F.col("b")))
    return top(one, top_k, "tie", "doc_id").select("query_id", "doc_id", "score", "rank")


def clamped(k: int, low: int = 1, high: int = 8, default: int = 4) -> int:
    """How many documents a service returns for what it was asked; nothing asked is ``default``."""
    return max(low, min(int(k or default), high))


def hybrid_search(docs: DataFrame, units: DataFrame, queries: DataFrame, top_k: int = 6, pool: int = 30, same_work: bool = False) -> DataFrame:
    """Dense and lexical rankings of each query (query_id, text, work, embedding), fused.

    With ``same_work`` both are of the query's work: the dense one by a mask, so that others stay behind at
    score -1, the lexical one strictly. A query without a vector has its lexical ranking alone.
    """
    dense = dense_topk(units, queries.where("embedding is not null"), pool, pool * 8, mask=same_work)
    lexical = bm25_topk(docs, queries, pool, same_work=same_work, fill=True).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rrf(dense, lexical, min(top_k, pool), pool=pool)


def soft_hint(free: DataFrame, hinted: DataFrame, top_k: int) -> DataFrame:
    """Rankings without and with the work filter, fused: the hint helps and excludes nothing.

    In a tie the free ranking's documents come first. A query without a hinted ranking keeps its free one.
    """
    return rrf(free, hinted, top_k, pool=max(20, 3 * top_k))


def rerank(ranking: DataFrame, texts: DataFrame, model, top_k: int) -> DataFrame:
    """``ranking`` ordered by ``model(query text, text)``, a scalar pandas UDF."""
    met = ranking.join(texts, ["query_id", "doc_id"])
    return top(met.withColumn("score", model("query_text", "text")), top_k).select("query_id", "doc_id", "score", "rank")


def embedding_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(key, text) of distinct texts whose SHA-1 the cache lacks."""
    keyed = texts.where(F.col(text).isNotNull()).select(F.sha1(F.col(text).cast("binary")).alias("key"), text)
    return keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
