"""Ranking metrics and judged-answer statistics."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import stored


class Judge(Protocol):
    """A model that grades answers; it runs on executors, so it must pickle."""

    def faithfulness(self, question: str, answer: str, evidence: str) -> tuple[float, list[str], list[str]]: ...

    def correctness(self, question: str, answer: str, reference: str) -> tuple[int, bool]: ...


class OfflineJudge:
    """Deterministic stand-in: words of the answer found in the evidence, and in the reference."""

    @staticmethod
    def _share(answer, text):
        words, known = (answer or "").lower().split(), set((text or "").lower().split())
        return sum(w in known for w in words) / len(words) if words else 0.0

    def faithfulness(self, question, answer, evidence):
        known = set((evidence or "").lower().split())
        return round(self._share(answer, evidence), 4), [w for w in (answer or "").split() if w.lower() not in known], []

    def correctness(self, question, answer, reference):
        share = self._share(answer, reference)
        return 1 + int(4 * share), share > 0


def judge(answers: DataFrame, client: Judge) -> DataFrame:
    """``answers`` (question, answer, evidence, reference, refused, ...) with a judge's grades, each asked for once.

    A refused answer is not shown: its correctness is 1 and its faithfulness missing.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.refused:
                    rows.append((None, [], [], 1, False))
                else:
                    rows.append((*client.faithfulness(r.question, r.answer, r.evidence), *client.correctness(r.question, r.answer, r.reference)))
            yield pdf.assign(**dict(zip(GRADES, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in GRADES})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema.fields)
    return stored(answers.mapInPandas(run, f"{kept}, faithfulness double, unsupported array<string>, contradicted array<string>, correctness int, answers_question boolean"), "judged")


GRADES = ("faithfulness", "unsupported", "contradicted", "correctness", "answers_question")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the middle of each group's sorted values, the upper one of two.

    Equal values are counted before the shuffle; what is ordered is a group's distinct values.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = n.withColumn("_upto", upto).withColumn("_half", F.floor(F.sum("_n").over(w) / 2))
    return ranked.where(F.col("_upto") > F.col("_half")).groupBy(*keys).agg(F.min(value).alias("median"))


def per_query(ranking: DataFrame, gold: DataFrame, depth: int = 10, miss: float = 0.0) -> DataFrame:
    """(query_id, kind, hit1, hit5, hit10, recall10, rr, ndcg) of every query in ``gold`` (query_id, kind, doc_id).

    hit@k asks for any gold document, recall for the share of them; the ideal gain
    has min(gold, depth) hits. A query without a ranking scores 0, its reciprocal rank ``miss``.
    """
    asked = gold.groupBy("query_id", "kind").agg(F.count_distinct("doc_id").alias("n"))
    hits = ranking.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= depth, X.dcg(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("rank") <= 10, 1).otherwise(0)).alias("in10")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(depth)).cast("int")), F.lit(0.0), lambda a, i: a + X.dcg(i))
    hit = lambda k: F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"hit{k}")
    return asked.join(hits, "query_id", "left").select("query_id", "kind", hit(1), hit(5), hit(10), (F.coalesce("in10", F.lit(0)) / F.col("n")).alias("recall10"), F.coalesce(1 / F.col("first"), F.lit(miss)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def summary(scores: DataFrame) -> DataFrame:
    """Means overall (kind ALL) and by kind."""
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    out = scores.rollup("kind").agg(F.count(F.lit(1)).alias("n"), mean("hit1", "hit_at_1"), mean("hit5", "hit_at_5"), mean("hit10", "hit_at_10"), mean("recall10", "recall_at_10"), mean("rr", "mrr"), mean("ndcg", "ndcg_at_10"), F.grouping("kind").alias("g"))
    return out.withColumn("kind", F.when(F.col("g") == 1, "ALL").otherwise(F.col("kind"))).drop("g")


def judged(rows: DataFrame) -> DataFrame:
    """Statistics of judged answers: a refusal's correctness is 1; missing faithfulness is left out."""
    right = F.when(F.col("refused"), 1).otherwise(F.col("correctness"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("refused").cast("int")).alias("refusals"), F.avg("faithfulness").alias("faithfulness"), F.avg((F.col("faithfulness") >= 0.9).cast("int")).alias("faithful_share"),
        F.avg(right).alias("correctness"), F.avg((right >= 4).cast("int")).alias("correct_share"), F.avg("n_cit").alias("citations"), F.avg("n_dropped").alias("dropped"), F.sum(F.arrays_overlap("gold", "top3").cast("int")).alias("gold_in_top3"),
    )


def stratified(df: DataFrame, kind: str, key: str, quotas: dict[str, int] | int, seed: int = 7) -> DataFrame:
    """Up to a quota of rows of each kind, in the order of a hash of the key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    quota = F.lit(quotas) if isinstance(quotas, int) else F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(kind)], F.lit(0))
    k = F.row_number().over(Window.partitionBy(kind).orderBy(order, key))
    return df.withColumn("_k", k).where(F.col("_k") <= quota).drop("_k")
