"""Question answering as columns added stage by stage, with a model behind a protocol.

Stages: normalise, route, retrieve, fetch, generate, verify; a question whose
citations fail is generated once more, and one without verified citations is
refused. The loop has at most two rounds, whatever the number of questions.
"""

from __future__ import annotations

import unicodedata
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import stored

CITATIONS = "array<struct<verse_id:string,quote:string>>"


class ModelClient(Protocol):
    """What an outside model is asked; calls run on executors, so a client must pickle."""

    def normalise(self, question: str) -> str: ...

    def route(self, question: str) -> tuple[str, list[str]]: ...

    def answer(self, question: str, passages: list[dict], attempt: int) -> tuple[str, list[dict], bool]: ...


class OfflineClient:
    """Deterministic stand-in: cites the first words of the first passages."""

    def normalise(self, question):
        return question.strip()

    def route(self, question):
        return ("story", []) if question else ("out_of_scope", [])

    def answer(self, question, passages, attempt):
        cites = [{"verse_id": p["verse_id"], "quote": " ".join(p["text"].split()[:6])} for p in passages[:3]]
        return f"{len(passages)} passages", cites, bool(passages)


def understood(questions: DataFrame, client: ModelClient) -> DataFrame:
    """Adds ``question``, ``route`` and ``works`` to (query_id, text)."""

    def run(batches):
        for pdf in batches:
            q = [client.normalise(t or "") for t in pdf["text"]]
            routes = [client.route(x) for x in q]
            yield pd.DataFrame({"query_id": pdf["query_id"], "question": q, "route": [r for r, _ in routes], "works": [w for _, w in routes]})

    return questions.select("query_id", "text").mapInPandas(run, "query_id bigint, question string, route string, works array<string>")


def generated(asked: DataFrame, client: ModelClient, attempt: int, cap: int = 5) -> DataFrame:
    """Adds ``answer``, ``citations`` (at most ``cap``) and ``answerable`` to (query_id, question, passages, ...).

    The rest of a row travels with its question, so that nothing is joined again and a model is asked once.
    """

    def run(batches):
        for pdf in batches:
            got = [client.answer(q, [dict(p.asDict() if hasattr(p, "asDict") else p) for p in ps], attempt) for q, ps in zip(pdf["question"], pdf["passages"], strict=True)]
            yield pdf.assign(answer=[g[0] for g in got], citations=[[c | {"quote": unicodedata.normalize("NFC", c["quote"])} for c in g[1][:cap]] for g in got], answerable=[g[2] for g in got])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(run, f"{kept}, answer string, citations {CITATIONS}, answerable boolean")


def verified(answers: DataFrame) -> DataFrame:
    """Adds ``verified`` and ``failed``: a citation must name a passage that was given and quote it verbatim; both in NFC."""
    passage = lambda c: F.get(F.filter("passages", lambda p: p["verse_id"] == c["verse_id"]), F.lit(0))
    reason = lambda c: F.when(passage(c).isNull(), "not in retrieved chapters").when(~X.quoted_in(passage(c)["text"], c["quote"], composed=True), "not verbatim").otherwise("")
    marked = F.transform("citations", lambda c: F.struct(c["verse_id"].alias("verse_id"), c["quote"].alias("quote"), reason(c).alias("reason")))
    out = answers.withColumn("_m", marked)
    return out.withColumn("verified", F.filter("_m", lambda c: c["reason"] == "")).withColumn("failed", F.filter("_m", lambda c: c["reason"] != "")).drop("_m")


def checked(citations: DataFrame, passages: DataFrame, key: list[str], slice_: int = 1000) -> DataFrame:
    """(key, given, status) for citations (key, given, quote) of passages (given, text): verified, not verbatim or not in retrieved chapters.

    Quotes are gathered by the passage that they cite, at most ``slice_`` to a row, and tested beside it: a
    passage is read, and squashed, once a slice. A null quote is not verbatim.
    """
    rows = F.struct(*key, X.squash(F.col("quote")).alias("q"))
    dealt = citations.withColumn("_n", F.pmod(F.xxhash64(*key), F.lit(1 << 20)))
    n = citations.groupBy("given").agg(F.ceil(F.count(F.lit(1)) / slice_).alias("_s"))
    some = dealt.join(n, "given").groupBy("given", F.pmod("_n", F.col("_s")).alias("_k")).agg(F.collect_list(rows).alias("cs"))
    met = some.join(passages.select("given", X.squash(F.col("text")).alias("p")), "given", "left")
    said = F.transform("cs", lambda c: F.struct(c.alias("c"), F.when(F.col("p").isNull(), "not in retrieved chapters").when((F.length(c["q"]) >= 8) & F.contains("p", c["q"]), "verified").otherwise("not verbatim").alias("status")))
    return met.select("given", F.explode(said).alias("x")).select(*[F.col("x.c")[k].alias(k) for k in key], "given", "x.status")


def answer(questions: DataFrame, passages: DataFrame, client: ModelClient, retries: int = 1) -> DataFrame:
    """(query_id, question, route, status, answer, verified, attempts) of every question.

    ``passages`` is (query_id, verse_id, text, rank), what retrieval and context
    selection gave each question. What a model said is stored after each stage, so that it is
    asked once for each question and attempt, however often the result is read.
    """
    given = F.transform(F.array_sort(F.collect_list(F.struct("rank", "verse_id", "text"))), lambda p: F.struct(p["verse_id"].alias("verse_id"), p["text"].alias("text")))
    passages = passages.withColumn("text", X.nfc(F.col("text")))
    asked = stored(understood(questions, client), "asked").join(passages.groupBy("query_id").agg(given.alias("passages")), "query_id", "left")
    asked = stored(asked.withColumn("passages", F.coalesce("passages", F.array().cast("array<struct<verse_id:string,text:string>>"))), "given")
    open_ = (F.col("route") != "out_of_scope") & (F.size("passages") > 0)
    refused = asked.where(~open_).select("query_id", "question", "route", F.lit("refused").alias("status"), F.lit(None).cast("string").alias("answer"), F.array().cast("array<struct<verse_id:string,quote:string,reason:string>>").alias("verified"), F.lit(0).alias("attempts"))
    todo, done = asked.where(open_), [refused]
    for attempt in range(retries + 1):
        out = verified(stored(generated(todo, client, attempt), f"attempt{attempt}")).withColumn("attempts", F.lit(attempt + 1))
        again = F.col("answerable") & ((F.size("failed") > 0) | (F.size("verified") == 0)) if attempt < retries else F.lit(False)
        good = F.col("answerable") & (F.size("verified") > 0)
        done.append(out.where(~again).select("query_id", "question", "route", F.when(good, "answered").otherwise("refused").alias("status"), F.when(good, F.col("answer")).alias("answer"), "verified", "attempts"))
        todo = out.where(again).select(*todo.columns)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def routable(works: Column, known: list[str]) -> Column:
    """Of the works that a router named, those that exist, in its order."""
    return F.filter(works, lambda w: w.isin(known))


def to_read(ranking: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` documents of each ranking, whose verses are read."""
    return ranking.where(F.col("rank") <= n)


def prompt(passages: DataFrame) -> DataFrame:
    """(query_id, prompt): '[id] (speaker)' and text of each passage in order, with a header where the chapter changes."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "chapter", "verse_id", "speaker", "text")))
    rows = passages.groupBy("query_id").agg(lines.alias("p"))
    head = lambda x, i: F.when((i == 0) | (F.get("p", i - 1)["chapter"] != x["chapter"]), F.concat(F.lit("## "), x["chapter"], F.lit("\n"))).otherwise("")
    who = lambda x: F.coalesce(F.concat(F.lit(" ("), x["speaker"], F.lit(")")), F.lit(""))
    return rows.select("query_id", F.array_join(F.transform("p", lambda x, i: F.concat(head(x, i), F.lit("["), x["verse_id"], F.lit("]"), who(x), F.lit("\n"), x["text"])), "\n").alias("prompt"))
