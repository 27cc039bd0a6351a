"""The corpus build as a whole, generation and judging, and files."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cards, evaluate, qa, records, retrieve
from corpusloom.plans import build
from corpusloom.sources import readers, sinks

WORK = records.Work("vip", "Work", "వర్క్", dotted=True, edition="e", source="wiki", license="l")
SOURCE = build.Source("विष्णु/")


def page(n, lines):
    return f"विष्णु/अध्यायः {n}", "{{header}}\n" + "\n".join(lines)


def verse(words, n):
    return f"{words} ॥ {n} ॥"


TEXTS = ["रामो वनं जगाम सीतया सह", "लक्ष्मणः पश्चात् ययौ धनुष्मान्", "रावणो लङ्कायां वसति स्म", "हनूमान् सागरं ततार वीरः", "विभीषणः शरणं प्राप राघवम्", "सुग्रीवः सेनां समानयत् ततः"]


@pytest.fixture(scope="module")
def pages(spark):
    one = page(1, ["पराशर उवाच", verse(TEXTS[0], 1), verse(TEXTS[1], 2)])
    two = page(3, [TEXTS[2] + " ।", verse("अन्यत्", 1), verse(TEXTS[3], 2), verse(TEXTS[3], 2)])
    more = [("विष्णु/अध्यायः ३", "short"), ("विष्णु/प्रथमोऽध्यायः", "x" * 999), ("अन्यत्/अध्यायः 1", "no")]
    return spark.createDataFrame([one, two, *more], "title string, text string")


def test_pages_of_chapters(pages):
    got = {r["chapter"]: r["title"] for r in build.chapter_pages(pages, SOURCE).collect()}
    assert got == {1: "विष्णु/अध्यायः 1", 3: "विष्णु/अध्यायः 3"}


def test_records_and_manifests(pages):
    rec, man = build.build(build.chapter_pages(pages, SOURCE), WORK, "https://x/")
    rows = {r["id"]: r for r in rec.collect()}
    assert set(rows) == {"vip-1-1-1", "vip-1-1-2", "vip-1-3-1", "vip-1-3-2"}
    assert rows["vip-1-1-2"]["speaker_iast"] == "parāśara uvāca" and rows["vip-1-3-1"]["sloka_devanagari"] == f"{TEXTS[2]} । अन्यत्"
    assert rows["vip-1-3-2"]["sloka_devanagari"] == f"{TEXTS[3]} {TEXTS[3]}"  # halves of one number in a row are one verse
    assert rows["vip-1-1-1"]["citation_te"] == "వర్క్ 1.1.1" and rows["vip-1-1-1"]["source_url"].startswith("https://x/%E0")
    m = {r["adhyaya_id"]: r for r in man.collect()}
    assert m["vip-1-1"]["verse_ids"] == ["vip-1-1-1", "vip-1-1-2"] and m["vip-1-1"]["speakers"] == ["parāśara uvāca"]


def test_the_whole_flow(spark, pages):
    """The older edition has chapter 3 as 2, and cuts its first verse in two."""
    old_pages = spark.createDataFrame([page(1, [verse(TEXTS[0], 1), verse(TEXTS[1], 2)]), page(2, [verse(TEXTS[2], 1), verse("अन्यत्", 2), verse(TEXTS[3], 3)])], "title string, text string")
    old, _ = build.build(build.chapter_pages(old_pages, SOURCE), WORK)
    got = build.flow(pages, old, WORK, SOURCE)
    assert {(r["new_ch"], r["old_ch"]) for r in got["chapter_map"].collect()} == {(1, 1), (3, 2)}
    rec = {r["id"]: r["sloka_devanagari"] for r in got["records"].collect()}
    assert set(rec) >= {"vip-1-1-1", "vip-1-1-2", "vip-1-2-1", "vip-1-2-3"} and rec["vip-1-2-3"].startswith(TEXTS[3])
    assert {r["bucket"] for r in got["reconciled"].collect()} <= {"same", "close"}


def test_parking(spark):
    mapped = spark.createDataFrame([("1", 3, "1", 5)], "new_book string, new_ch bigint, old_book string, old_ch bigint")
    rows = build.renumbered(spark.createDataFrame([("1", 3), ("1", 5), ("1", 7)], "book string, chapter bigint").withColumn("was", F.col("chapter")), mapped)
    assert {r["was"]: r["chapter"] for r in rows.collect()} == {3: "5", 5: "5w", 7: "7"}


def test_generation_stops_at_the_cap(spark):
    class Failing(cards.OfflineCards):
        def card(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("refusal")
            return super().card(prompt)

    asked = spark.createDataFrame([(f"r{k:02}", "bad" if k == 1 else "one two three four") for k in range(20)], "request_id string, prompt string")
    got = {r["request_id"]: r for r in cards.generate(asked, Failing(), (1e6, 0.0), cap=20, at_once=4).collect()}
    assert len(got) == 8 and got["r01"]["error"] == "RuntimeError: refusal"  # 12 dollars, then 28: the second chunk was begun below the cap
    assert json.loads(got["r00"]["body"]) == {"title_te": "one two three", "n_words": 4}


def test_failed_requests_go_again(spark):
    chapters = spark.createDataFrame([("w", str(k)) for k in range(4)], "work string, chapter string")
    ledger = cards.submit(chapters, spark.createDataFrame([], cards.LEDGER), "m", ["chapter"], 2)
    assert sorted((r["chapter"], r["batch"]) for r in ledger.collect()) == [("0", 0), ("1", 0), ("2", 1), ("3", 1)]
    results = spark.createDataFrame([("w__0", '{"title_te": "t"}', None), ("w__1", None, "expired"), ("w__2", "{", None)], "request_id string, body string, error string")
    now = cards.settled(ledger, cards.collect(results, ledger, "title_te string"))
    assert {r["chapter"]: r["status"] for r in now.collect()} == {"0": "ok", "1": "failed", "2": "unparsable", "3": "waiting"}
    assert {r["chapter"] for r in cards.submit(chapters, now, "m", ["chapter"]).collect()} == {"1", "2"}


def test_a_model_is_asked_once(spark, tmp_path):
    class Counting(evaluate.OfflineJudge):
        def faithfulness(self, question, answer, evidence):
            with (tmp_path / "calls").open("a") as f:
                f.write("x")
            return super().faithfulness(question, answer, evidence)

    rows = [("q", "a b", "a", "a b", False), ("q", None, None, None, True)]
    got = evaluate.judge(spark.createDataFrame(rows, "question string, answer string, evidence string, reference string, refused boolean"), Counting())
    assert got.count() == 2 and [r["faithfulness"] for r in got.orderBy("refused").collect()] == [0.5, None]
    assert (tmp_path / "calls").read_text() == "x"


def test_upper_median(spark):
    rows = [("a", v) for v in (3, 1, 2, 2)] + [("b", 5), ("b", None), ("c", 1), ("c", 9)]
    got = {r["k"]: r["median"] for r in evaluate.upper_median(spark.createDataFrame(rows, "k string, v int"), ["k"], "v").collect()}
    assert got == {"a": 2, "b": 5, "c": 9}


def test_lexical_ranking_is_filled_and_filtered(spark):
    docs = spark.createDataFrame([(1, "sun moon", "a"), (2, "rain", "b"), (3, "sunny day", "b"), (4, "zz", "b")], "doc_id bigint, text string, work string")
    asked = spark.createDataFrame([(1, "sunny", "b")], "query_id bigint, text string, work string")
    free = retrieve.bm25_topk(docs, asked, 3, fill=True).orderBy("rank").collect()
    assert [r["doc_id"] for r in free] == [3, 1, 2] and free[1]["score"] == free[2]["score"] == 0
    own = retrieve.bm25_topk(docs, asked, 3, same_work=True, fill=True).orderBy("rank").collect()
    assert [r["doc_id"] for r in own] == [3, 2, 4]
    assert [retrieve.clamped(k) for k in (0, 1, 5, 99, -3)] == [4, 1, 5, 8, 1]


def test_passages_of_questions_are_made_once(spark, tmp_path):
    def read(batches):
        for pdf in batches:
            with open(tmp_path / "reads", "a") as f:
                f.write("x" * len(pdf))
            yield pdf

    p = spark.createDataFrame([(1, "v1", "some words that are said", 1)], "query_id bigint, verse_id string, text string, rank int").coalesce(1)
    q = spark.createDataFrame([(1, "what"), (2, "")], "query_id bigint, text string")
    got = qa.answer(q, p.mapInPandas(read, p.schema), qa.OfflineClient()).collect()
    assert {r["query_id"]: r["status"] for r in got} == {1: "answered", 2: "refused"}
    assert (tmp_path / "reads").read_text() == "x"


@pytest.mark.parametrize("n", [4, 2])
def test_lexical_ranking_in_tasks_is_that_of_joins(spark, monkeypatch, n):
    import random

    rng = random.Random(n)
    words = ["that", "the", "sun", "moon", "a\x1cb", "𝒳𝒴𝒵𝒲", "𝒳sun", "\xa0hill", "ऋषिः", "rain"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(12)))
    docs = spark.createDataFrame([(f"d{i}", text() or None) for i in range(150)], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, text()) for i in range(6)] + [(9, None)], "query_id int, text string")
    monkeypatch.setattr(retrieve, "SCORE_ROWS", 7)
    monkeypatch.setattr(retrieve, "HELD_TOKENS", 40)
    rank = lambda: {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieve.bm25_topk(docs, asked, 5, n).collect()}
    quick = rank()
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", 0)
    joined = rank()
    assert quick.keys() == joined.keys() and all(quick[k][1] == pytest.approx(joined[k][1], abs=2e-6) for k in quick)


def test_tasks_rank_only_the_best_of_a_work(spark, monkeypatch):
    seen, keep = [], retrieve.top

    def top(score, *a):
        seen.append(score.count())
        return keep(score, *a)

    monkeypatch.setattr(retrieve, "top", top)
    docs = spark.createDataFrame([(i, f"sun {'moon ' * (i % 5)}", "ab"[i % 2]) for i in range(200)], "doc_id bigint, text string, work string").coalesce(2)
    asked = spark.createDataFrame([(1, "sunny moon", "b"), (2, "zzzz", "a"), (3, "moon", None)], "query_id bigint, text string, work string")
    got = retrieve.bm25_topk(docs, asked, 3, same_work=True, fill=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got][3:] == [(2, 0), (2, 2), (2, 4)] and all(r["doc_id"] % 2 for r in got[:3]) and len(got) == 6
    assert max(seen) <= 2 * 3 * 2


def test_a_hint_excludes_nothing(spark):
    side = lambda s: spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(s)], "query_id bigint, doc_id string, rank int")
    out = retrieve.soft_hint(side("FA"), side("HB"), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == ["F", "H", "A", "B"]  # the free ranking first in a tie
    assert [r["doc_id"] for r in retrieve.soft_hint(side("FA"), side("FA").limit(0), 4).orderBy("rank").collect()] == ["F", "A"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, "x" * (k * 10)) for k in range(40)], "id int, t string")
    sinks.sized(rows, str(tmp_path / "parts"), 1000)
    files = list((tmp_path / "parts").glob("part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) <= 1420
    assert readers.jsonl(spark, str(tmp_path / "parts"), "id int, t string").count() == 40
    assert sinks.report(spark.createDataFrame([("a", 1, 2.0), ("bb", 20, None)], "k string, n int, p double"), ["k"]) == "k    n    p\na    1  2.0\nbb  20    -"
    ids, matrix = readers.matrix(spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "unit_id bigint, embedding array<float>"))
    assert ids.tolist() == [1, 2] and matrix.tolist() == [[1, 0], [0, 1]]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    waits = []
    assert readers.with_retry(flaky, sleep=waits.append)() == "ok" and waits == [3.0, 6.0]


def test_a_map_is_written_and_read_by_many_tasks(spark, tmp_path):
    odd = F.concat(F.lit('"},\n{'), F.col("id").cast("string"))
    rows = spark.range(1000).repartition(3).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).withColumn("to", odd)
    for _ in range(2):  # the second replaces the first
        assert sinks.mapping(rows, str(tmp_path / "map"), "id") == 1001
    (file,) = (tmp_path / "map").glob("part-*")
    held = json.loads(file.read_text())
    assert list(held) == ["null", *map(str, range(1000))] and held["7"] == {"to": '"},\n{7'} and held["null"] == {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.json_map(spark, str(tmp_path / "map"), "struct<to:string>").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["key"]: r["value"]["to"] for r in got} == {k: v.get("to") for k, v in held.items()} and len(got) == 1001
    assert max(Counter(r["task"] for r in got).values()) < 500
    assert sinks.mapping(rows.limit(0), str(tmp_path / "none"), "id") == 0 and readers.json_map(spark, str(tmp_path / "none"), "string").count() == 0


@pytest.mark.parametrize("layout", [json.dumps, lambda m: json.dumps(m, indent=0), lambda m: json.dumps(m, indent=2).replace(": {", ":\n{"), lambda m: json.dumps(m).replace(', "3', ',\n"3')])
def test_a_map_is_read_in_any_layout(spark, tmp_path, layout):
    held = {"1-1": {"to": "}, {", "score": 0.5}, '2"{,': {"to": 'a\n"}', "score": 1.0}, "3": {"to": None, "score": 2.0}}
    (tmp_path / "map.json").write_text(layout(held))
    got = readers.json_map(spark, str(tmp_path / "map.json"), "struct<to:string,score:double>").collect()
    assert {r["key"]: r["value"].asDict() for r in got} == held and len(got) == 3
