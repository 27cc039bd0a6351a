"""Planning, collecting, validating and repairing generated records."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import stored
from .sequence import budget_plan, chunk


def to_do(chapters: DataFrame, done: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Chapters that neither exist nor wait in the ledger."""
    return chapters.join(done.select(key), key, "left_anti").join(pending.select(key), key, "left_anti")


def plan(chapters: DataFrame, cap: float, order: list[str], group: str, cost: str) -> DataFrame:
    """The chapters that a budget pays for, in order."""
    return budget_plan(chapters, group, order, cost, cap)


def requests(chapters: DataFrame, order: list[str], size: int = 500) -> DataFrame:
    """Adds ``request_id`` and the number of the batch that a chapter goes with.

    Rows are numbered from the counts of sorted partitions, so that no task sees all of them.
    """
    dealt = chapters.withColumn("request_id", X.request_id(F.col("work"), F.col("chapter"))).orderBy(*order)
    dealt = stored(dealt.withColumn("_p", F.spark_partition_id()), "requests")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    k = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_base")
    return dealt.join(F.broadcast(base), "_p").withColumn("batch", chunk(k, size)).drop("_p", "_base")


LEDGER = "request_id string, work string, chapter string, batch bigint, model string, status string"


class CardModel(Protocol):
    """What writes records; calls run on executors, so a client must pickle."""

    name: str

    def card(self, prompt: str) -> tuple[str, int, int]:
        """(JSON of the card, input tokens, output tokens); raises where the model refuses or fails."""


class OfflineCards:
    """Deterministic stand-in: a title from the prompt's first words."""

    name = "offline"

    def card(self, prompt):
        words = prompt.split()
        return json.dumps({"title_te": " ".join(words[:3]), "n_words": len(words)}), len(words), 5


def written(asked: DataFrame, client: CardModel) -> DataFrame:
    """(request_id, body, error, input_tokens, output_tokens) for (request_id, prompt): each is asked once and stored."""

    def run(batches):
        for pdf in batches:
            rows = []
            for prompt in pdf["prompt"]:
                try:
                    body, given, made = client.card(prompt)
                    rows.append((body, None, given, made))
                except Exception as e:  # a model's refusal is a result: the chapter stays to be done
                    rows.append((None, f"{type(e).__name__}: {e}", 0, 0))
            yield pdf[["request_id"]].assign(**dict(zip(("body", "error", "input_tokens", "output_tokens"), map(list, zip(*rows, strict=True)), strict=True)))

    return stored(asked.select("request_id", "prompt").mapInPandas(run, "request_id string, body string, error string, input_tokens bigint, output_tokens bigint"), "written")


def generate(asked: DataFrame, client: CardModel, price: tuple[float, float], cap: float | None = None, at_once: int = 8) -> DataFrame:
    """``written`` in chunks of ``at_once`` rows in order of ``request_id``, until what was spent reaches ``cap``.

    As in a synchronous run, a chunk once begun is finished, so the cap may be overshot by one chunk.
    """
    if cap is None:
        return written(asked, client)
    k = stored(asked.withColumn("batch", chunk(F.row_number().over(Window.orderBy("request_id")), at_once)), "chunks")  # a budget's plan: bounded by it
    out, spent = None, 0.0
    for c in range(-(-k.count() // at_once)):
        if spent >= cap:
            break
        part = written(k.where(F.col("batch") == c), client)
        row = part.agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")).head()
        spent += ((row["i"] or 0) * price[0] + (row["o"] or 0) * price[1]) / 1e6
        out = part if out is None else out.unionByName(part)
    return written(asked.limit(0), client) if out is None else out


def submit(chapters: DataFrame, ledger: DataFrame, model: str, order: list[str], size: int = 500) -> DataFrame:
    """Rows that the ledger gains: chapters (work, chapter) whose request does not wait in it and did not succeed."""
    asked = requests(chapters, order, size)
    open_ = ledger.where("status not in ('failed', 'unparsable')").select("request_id")
    fresh = asked.join(open_, "request_id", "left_anti")
    return fresh.select("request_id", "work", "chapter", "batch", F.lit(model).alias("model"), F.lit("waiting").alias("status"))


def settled(ledger: DataFrame, collected: DataFrame) -> DataFrame:
    """The ledger with the status of what was collected (request_id, status)."""
    now = collected.select("request_id", F.col("status").alias("now"))
    return ledger.join(now, "request_id", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def collect(results: DataFrame, ledger: DataFrame, schema: str) -> DataFrame:
    """Results joined to their requests, parsed; ``status`` is ok, unparsable, failed or waiting, so that only ok counts as done."""
    card = F.from_json("body", schema)
    met = ledger.drop("status").join(results, "request_id", "left").withColumn("card", card)
    parsed = F.col("card").isNotNull() & F.coalesce(F.json_object_keys("body").isNotNull(), F.lit(False))
    status = F.when(F.col("body").isNull() & F.col("error").isNull(), "waiting").when(F.col("error").isNotNull(), "failed").when(~parsed, "unparsable").otherwise("ok")
    return met.withColumn("status", status)


def bad_anchors(anchors: Column, verse_ids: Column) -> Column:
    """Anchored ids that the chapter lacks; repeats are kept."""
    return F.filter(F.flatten(F.transform(anchors, lambda a: a["verse_ids"])), lambda v: ~F.array_contains(verse_ids, v))


def errors(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules]))


def card_errors(level: int = 2) -> Column:
    """Rules over a row with ``card``, ``n_verses`` and ``verse_ids``; level 2 adds the stricter counts."""
    questions, anchors, entities = F.size("card.questions_te"), F.size("card.anchors"), F.size("card.entities")
    rules = [
        ("questions", ~questions.between(F.when(F.col("n_verses") < 5, 4).otherwise(8), F.lit(16))),
        ("bad_anchor", F.size(bad_anchors(F.col("card.anchors"), F.col("verse_ids"))) > 0),
        ("latin", X.has_latin(F.col("card.summary_te")) | X.has_latin(F.col("card.title_te"))),
        ("empty_summary", X.strip(F.coalesce("card.summary_te", F.lit(""))) == ""),
    ]
    if level > 1:
        rules += [("anchors", ~anchors.between(3, 10)), ("entities", ~entities.between(5, 60))]
    return errors(*rules)


def validation_summary(cards: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """(ok, fail, missing): cards (key, errors) without and with errors, and chapters that have none."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    met = chapters.select(key).distinct().join(cards.select(key, "errors", F.lit(True).alias("has")), key, "full_outer")
    return met.agg(n(F.col("has") & (F.size("errors") == 0)).alias("ok"), n(F.col("has") & (F.size("errors") > 0)).alias("fail"), n(F.col("has").isNull()).alias("missing"))


def repair_anchor(verse: Column, prefix: Column, verse_ids: Column) -> Column:
    """A valid id for an anchor: itself, or the chapter's prefix with its last number; null if there is none."""
    guess = F.concat(prefix, F.lit("-"), F.regexp_extract(verse, r"(?U)(\d+)\D*$", 1))
    return F.when(F.array_contains(verse_ids, verse), verse).when(F.array_contains(verse_ids, guess), guess)


def repair(cards: DataFrame, least: int = 3) -> DataFrame:
    """Cards with anchors rewritten, and ``action``: delete, repaired or keep."""
    fixed = F.transform(
        "card.anchors",
        lambda a: F.struct(a["topic_te"].alias("topic_te"), F.array_compact(F.transform(a["verse_ids"], lambda v: repair_anchor(v, F.col("adhyaya_id"), F.col("verse_ids")))).alias("verse_ids")),
    )
    out = cards.withColumn("_anchors", F.filter(fixed, lambda a: F.size(a["verse_ids"]) > 0))
    drop = (F.size("_anchors") < least) | X.has_latin(F.col("card.summary_te")) | (F.size("card.questions_te") == 0)
    out = out.withColumn("action", F.when(F.coalesce(drop, F.lit(True)), "delete").when(F.col("_anchors") != F.col("card.anchors"), "repaired").otherwise("keep"))
    return out.withColumn("card", F.col("card").withField("anchors", F.col("_anchors"))).drop("_anchors")


def usage_totals(usage: DataFrame, prices: DataFrame, by: list[str], batch: bool = False) -> DataFrame:
    """Tokens and dollars by ``by``; ``prices`` (model, input_price, output_price) is a small dimension."""
    met = usage.join(prices, "model")
    dollars = X.cost({"i": F.col("input_tokens"), "o": F.col("output_tokens")}, {"i": F.col("input_price"), "o": F.col("output_price")}, batch)
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(dollars), 4).alias("usd"))
