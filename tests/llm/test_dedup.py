"""Dedup operators on null and repeated ids, and on columns named like their own, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bagminhash, exactdedup, linededup, packing, quality_rules, substring

from .test_llm import WS, bag, brute_classes, brute_lines, lower, similarity, words

pytest.importorskip("public_tokenizers")

PLAIN = "doc_id bigint, text string"


def graded(n, size=60, seed=3):
    """A text and copies of it with ever more words changed."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**9, size)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, size, k):
            w[at] = f"x{k}-{at}"
        out.append(" ".join(w))
    return out


# ------------------------------------------------------------ near dedup


def test_rows_of_one_id_are_told_apart_by_their_text(spark):
    a, near = graded(2, 200)
    other = "another text of its own with enough words to be compared with the rest of them here"
    df = spark.createDataFrame([(1, a), (4, near), (4, other), (4, other)], PLAIN)
    assert Counter(map(tuple, bagminhash.classes(df).collect())) == Counter({(1, 1, 2): 1, (4, 1, 2): 1, (4, 4, 2): 2})
    assert Counter(r["text"] for r in bagminhash.keep_one(df).collect()) == Counter({a: 1, other: 2})


def test_rows_without_an_id_are_compared(spark):
    texts = graded(3, 200) + ["a lonely text without any likeness to the others in this small table"]
    df = spark.createDataFrame([(None, t) for t in texts], PLAIN)
    assert Counter(map(tuple, bagminhash.classes(df).collect())) == Counter({(None, None, 3): 3, (None, None, 1): 1})
    left = {r["text"] for r in bagminhash.keep_one(df).collect()}
    assert len(left) == 2 and texts[3] in left
    mixed = df.unionByName(spark.createDataFrame([(9, texts[0])], PLAIN))
    # row 9 and its equal without an id are two documents of the class of 9, which stays
    assert Counter((r["doc_id"], r["text"]) for r in bagminhash.keep_one(mixed).collect()) == Counter([(9, texts[0]), (None, texts[3])])


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("agree", [0, bagminhash.AGREE])
def test_classes_equal_brute_force(spark, monkeypatch, block, agree):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    monkeypatch.setattr(bagminhash, "ROUNDS", 1)
    rows = [(k, t) for k, t in enumerate(graded(25, 80) + graded(25, 80, 4))] + [(None, t) for t in graded(5, 80)] + [(3, t) for t in graded(4, 30, 9)]
    got = bagminhash.classes(spark.createDataFrame(rows, PLAIN), agree=agree)
    assert Counter(map(tuple, got.collect())) == brute_classes(rows)


def test_recall_on_many_graded_copies(spark):
    """Every link that brute force finds among 400 texts of 20 families."""
    rows = [(20 * f + k, t) for f in range(20) for k, t in enumerate(graded(20, 400 + f, f))]
    bags = [bag(t) for _, t in rows]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(spark.createDataFrame(rows, PLAIN)).collect()}
    links = [(i, j) for i in range(len(rows)) for j in range(i) if i // 20 == j // 20 and similarity(bags[i], bags[j]) >= 0.8]
    assert len(links) > 300 and all(got[i] == got[j] for i, j in links)


# ------------------------------------------------------------ substring dedup


def brute_units(rows, kind, least):
    """What is left of each text when repeated lines or paragraphs go; rows equal in id and text are one."""
    units = defaultdict(list)
    for r, (i, t) in enumerate(rows):
        lines, at, block = (t or "").split("\n"), 0, []
        spans = []
        for k, line in enumerate(lines):
            end = at + len(line) + (k < len(lines) - 1)
            inked = bool(words(line))
            if kind == "line" and inked:
                spans.append((at, end))
            if kind == "paragraph":
                if inked:
                    block.append((at, end))
                if block and (not inked or k == len(lines) - 1):
                    spans.append((block[0][0], block[-1][1]))
                    block = []
            at = end
        for n, (a, b) in enumerate(spans):
            w = tuple(words(lower(t[a:b])))
            if len(w) >= least:
                units[w].append((i is None, i or 0, n, t, r, a, b))
    left = [list(t or "") for _, t in rows]
    for found in units.values():
        # only rows of different (id, text) have an order here; the fixtures use no id twice with one unit at one place
        found.sort(key=lambda x: x[:3])
        for z, i, n, t, r, a, b in found:
            if (z, i, n, t) != (*found[0][:3], found[0][3]):
                left[r][a:b] = [""] * (b - a)
    return Counter((i, None if t is None else "".join(x)) for (i, t), x in zip(rows, left, strict=True))


@pytest.mark.parametrize("kind", ["line", "paragraph"])
@pytest.mark.parametrize("least", [1, 4])
def test_repeated_lines_and_paragraphs_go(spark, kind, least):
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 40, k)) for k in rng.integers(0, 9, 60)]
    rows = []
    for i in range(60):
        picked = [lines[k] for k in rng.integers(0, 60, 12)]
        rows.append((i, "\n".join(x.upper() if k % 5 == 0 else f"  {x}\t" if k % 3 == 0 else x for k, x in enumerate(picked))))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, rows[0][1]), (63, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, PLAIN)
    got = substring.drop_repeats(df, kinds=(kind,), min_words=least).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == brute_units(rows, kind, least)
    for r in got:
        assert r["n_removed"] == len(r["removed"]) and all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:], strict=False))


def test_a_nine_word_line_in_six_documents_goes(spark):
    line = "one two three four five six seven eight nine"
    rows = [(i, f"text of document {i}\n{line}\nend of {i}") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in substring.drop_repeats(spark.createDataFrame(rows, PLAIN)).collect()}
    assert line in got[0] and got[5] == "text of document 5\nend of 5"


def test_repeats_of_rows_without_an_id(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(None, f"{passage}\nfirst"), (None, f"{passage}\nsecond"), (4, f"{passage}\nthird"), (4, f"{passage}\nfourth")]
    got = substring.drop_repeats(spark.createDataFrame(rows, PLAIN)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 1, 1, 1]
    assert [r["doc_id"] for r in got if not r["n_removed"]] == [4]


def test_kinds_are_checked(spark):
    with pytest.raises(ValueError):
        substring.drop_repeats(spark.createDataFrame([(1, "a")], PLAIN), kinds=("sentence",))


# ------------------------------------------------------------ lines


def test_a_line_of_one_document_counts_once(spark):
    rows = [(1, f"same\nrow {k}") for k in range(10)] + [(None, "same\nno id")] * 9
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.drop_frequent_lines(spark.createDataFrame(rows, PLAIN), min_docs=3).collect()) == brute_lines(rows, 3)
    assert linededup.drop_frequent_lines(spark.createDataFrame(rows, PLAIN), min_docs=2).where("n_dropped > 0").count() == 19


def test_many_lines_in_one_text(spark):
    rows = [(k, "\n".join([f"l{x}" for x in range(20_000)] + [f"own {k}"])) for k in range(3)]
    got = linededup.drop_frequent_lines(spark.createDataFrame(rows, PLAIN), min_docs=3).collect()
    assert all(r["text"] == f"own {r['doc_id']}" and r["n_dropped"] == 20_000 for r in got)


# ------------------------------------------------------------ columns of the caller

NAMES = ["d", "k", "z", "i", "t", "h", "g", "at", "row", "key", "node", "gone", "later", "stay", "lines", "found", "bands", "kept", "_gone", "_sd_later", "_ld_hot", "removed", "n_removed", "n_lines", "n_dropped", "class_id", "score", "label", "digest", "fresh", "a.b"]


@pytest.fixture(scope="module")
def wide(spark):
    texts = graded(3) + ["same line here\nand more of it", "same line here\nand other things", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], PLAIN)
    return df.select("doc_id", "text", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def whole(out, but=()):
    """Every extra column that came back says what it said."""
    for r in out.collect():
        assert all(r[n] == f"{n}-{r['doc_id']}" for n in out.columns if n in NAMES and n not in but)


@pytest.mark.parametrize(
    "run, own",
    [
        (lambda d: substring.drop_repeats(d, kinds=substring.KINDS), ("removed", "n_removed")),
        (substring.without_repeats, ()),
        (lambda d: linededup.drop_frequent_lines(d, min_docs=2), ("n_lines", "n_dropped")),
        (lambda d: linededup.without_frequent_lines(d, min_docs=2), ()),
        (bagminhash.keep_one, ()),
        (lambda d: quality_rules.keep_good(d, None, min_words=1), ()),
    ],
)
def test_columns_of_any_name_are_carried(wide, run, own):
    out = run(wide)
    assert set(out.columns) == set(wide.columns) | set(own) and out.count() >= 3
    if not own:
        assert out.columns == wide.columns and out.schema == wide.schema
    whole(out, own)


def test_columns_of_any_name_are_no_bother(wide):
    assert bagminhash.classes(wide).count() == wide.count()
    assert exactdedup.dedup_batch(wide, exactdedup.halves()).count() == wide.count()
    assert packing.pack(wide, __import__("public_tokenizers").path("byte_bpe_50k.json")).count() >= wide.count()


def test_pipeline_keeps_columns_of_any_name(spark, wide):
    import corpus_pipeline as p

    for name, stage in p.STAGES[1:4]:
        out = stage(spark, wide.withColumn("n_chars", F.lit(7)), "/root/testdata/sf0.001")
        assert out.columns == [*wide.columns, "n_chars"], name
        whole(out)
        assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None) or name == "near_dedup"


def test_scratch_goes_and_settings_stay(spark):
    import os

    import corpus_pipeline as p
    from corpusloom.llm._shared import BATCH, shared_root

    root, before = shared_root(spark).removeprefix("file://"), spark.conf.get(BATCH)
    had = set(os.listdir(root))
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and spark.conf.get(BATCH) == before
    assert len(set(os.listdir(root)) - had) == 1
