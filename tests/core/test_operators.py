"""Golden fixtures of the reference operators."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import align, cards, evaluate, parse, qa, retrieve, sequence
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ("सूत उवाच ।\nक ।\nख ॥ १ ॥", (None, 1, None, "क । ख", "सूत उवाच")),
        ("क ॥मंगल१॥", (None, 1, "-मंगल", "क", None)),
        ("क ॥६.१॥", (6, 1, None, "क", None)),
        ("क ॥ १,१५.१ ॥", (15, 1, None, "क", None)),
        ("क १ ।", (None, 1, None, "क", None)),
        ("क  १", (None, 1, None, "क", None)),
        ("क\nइति श्रीमहापुराणे\nख ॥ २ ॥", (None, 2, None, "ख", None)),
    ],
)
def test_marker_split(spark, lines, want):
    df = spark.createDataFrame([(1, lines)], "id int, t string")
    assert [(r["chapter"], r["n"], r["suffix"], r["text"], r["speaker"]) for r in parse.split_marked(df, "id", "t").collect()] == [want]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ("क\nयह है\nख ॥ २ ॥", ["ख"]),  # a gloss ends what waits
        ("क\nख,\nग ॥ २ ॥", ["ग"]),  # so does a line that ends in a comma
        ("क\nप्रथमोऽध्यायः\nग ॥ २ ॥", ["ग"]),
        ("क\n{{x}}\n[[y]]\nग ॥ २ ॥", ["क ग"]),  # markup does not
        ("क ॥ १ ॥ ख\nग १२\nघ ॥ ३ ॥", ["क", "ख ग", "घ"]),  # a bare number ends a line without a mark
        ("क ख ॥ १ ॥ २", ["क ख"]),
        ("॥ १ ॥", []),
    ],
)
def test_marker_split_lines(spark, lines, want):
    df = spark.createDataFrame([(1, lines)], "id int, t string")
    assert [r["text"] for r in parse.split_marked(df, "id", "t").orderBy("pos").collect()] == want


def test_chapter_split_by_line(spark):
    rows = [(1, "1(2)\nराम उवाच\nक ॥ १ ॥ ख ॥ २ ॥\n2(3)\nग ॥ १ ॥"), (2, "1(2)\nघ ॥ १ ॥\nङ ॥ ३.२ ॥")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r["chapter"]: (r["id"], [v["text"] for v in r["verses"]]) for r in parse.split_chapters(df, "id", "t", F.lit(None).cast("bigint"), r"^\s*(\d+)\(\d+\)\s*$").collect()}
    assert got == {1: (1, ["क", "ख"]), 2: (1, ["ग"]), 3: (2, ["ङ"])}


def test_table_split(spark):
    page = "<tr><td>व्यासः उवाच<td>1-2-0x</tr>\n<tr><td>क ।<td>1-2-1a</tr>\n<tr><td>ख ॥<td>1-2-1c<ref>n</ref></tr>\n<tr><td>ग<td>1-2-2a</tr>"
    got = parse.split_table(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h").orderBy("pos").collect()
    assert [(r["chapter"], r["n"], r["text"], r["speaker"]) for r in got] == [(2, 1, "क ख", "व्यासः उवाच"), (2, 2, "ग", "व्यासः उवाच")]


def test_marker_split_keeps_page_order(spark):
    df = spark.createDataFrame([(1, "क ॥ १ ॥ ख ॥ २ ॥\nग ॥ ३ ॥"), (2, None)], "id int, t string")
    assert [(r["pos"], r["n"], r["text"]) for r in parse.split_marked(df, "id", "t").orderBy("pos").collect()] == [(0, 1, "क"), (1, 2, "ख"), (2, 3, "ग")]


@pytest.mark.parametrize(
    ("numbers", "want"),
    [
        ([98, 99, 100, 1, 2, 3], [98, 99, 100, 101, 102, 103]),
        ([13, 14, 1, 16], [13, 14, 15, 16]),
        ([*range(1, 101), *range(1, 21)], list(range(1, 121))),
        ([*range(1, 13), *range(1, 13)], [*range(1, 13), *range(1, 13)]),
        ([13, 13, 15], [13, 13, 15]),
        ([], []),
    ],
)
def test_number_repair(spark, numbers, want):
    assert sequence.repaired(numbers) == want
    df = spark.createDataFrame([("c", k, n) for k, n in enumerate(numbers)], "k string, pos int, n int")
    assert [r["n"] for r in sequence.repair_numbers(df, ["k"], ["pos"], "n").orderBy("pos").collect()] == want


@pytest.mark.parametrize(("second", "kept"), [(12, 12), (18, 18)])
def test_restart_and_run_selection(spark, second, kept):
    rows = [("c", i, n) for i, n in enumerate([*range(1, 13), *range(1, second + 1)])]
    df = spark.createDataFrame(rows, "k string, pos int, n int")
    got = sequence.keep_run(df, ["k"], ["pos"], "n").orderBy("pos").collect()
    assert [r["n"] for r in got] == list(range(1, kept + 1)) and got[0]["pos"] == (0 if second == 12 else 12)


def test_islands_and_duplicates(spark):
    df = spark.createDataFrame([("c", 0, 5, "a"), ("c", 1, 5, "b"), ("c", 2, 6, "c")], "k string, pos int, n int, t string")
    got = sequence.merge_islands(df, ["k"], ["pos"], ["n"], "t").orderBy("island").collect()
    assert [(r["n"], r["t"]) for r in got] == [(2, "a b"), (1, "c")] or [r["t"] for r in got] == ["a b", "c"]
    rows = [(1, 0, "a"), (2, 1, "b"), (1, 2, "a"), (1, 3, "c"), (1, 4, "d")]
    out = sequence.suffix_duplicates(spark.createDataFrame(rows, "n int, pos int, t string"), ["n"], ["pos"], "t").orderBy("pos").collect()
    assert [(r["n"], r["suffix"]) for r in out] == [(1, ""), (2, ""), (1, "-r2"), (1, "-r3")]


def test_headings_and_budget(spark):
    df = spark.createDataFrame([("c", k, n) for k, n in enumerate([1, 2, 5, 3, 3, 4])], "k string, pos int, n int")
    assert [r["pos"] for r in sequence.accepted_headings(df, ["k"], ["pos"], "n").orderBy("pos").collect()] == [0, 1, 3, 5]
    rows = [("a", 1, 6.0), ("a", 2, 6.0), ("a", 3, 1.0), ("b", 4, 3.0), ("b", 5, 2.0)]
    out = cards.plan(spark.createDataFrame(rows, "work string, ch int, cost double"), 10.0, ["work", "ch"], "work", "cost")
    assert [r["ch"] for r in out.orderBy("ch").collect()] == [1, 4]


@pytest.mark.parametrize(("n", "anchored", "want"), [(30, [5], list(range(30))), (40, [10, 20], [0, 1, 9, 10, 11, 19, 20, 21]), (40, [10], list(range(40))), (200, [], list(range(120)))])
def test_context(spark, n, anchored, want):
    df = spark.createDataFrame([("c", i) for i in range(n)], "k string, pos int")
    out = sequence.select_context(df, ["k"], ["pos"], F.col("pos").isin(anchored) if anchored else F.lit(False))
    assert sorted(r["pos"] for r in out.collect()) == want


def test_scalars(spark):
    assert sorted(one(spark, "abcde fg", X.lexical_tokens)) == sorted(["abcd", "bcde", "cde ", "de f", "e fg", "abcde", "fg"])
    assert one(spark, "abc", X.lexical_tokens) == ["abc"] and one(spark, "abcd", X.lexical_tokens) == ["abcd", "abcd"]
    assert one(spark, "క్షీ😀x", lambda c: X.char_grams(c, 4)) == ["క్షీ", "్షీ😀", "షీ😀x"]
    assert sorted(one(spark, "క్షీ😀x\ny", lambda c: X.gram_bag(c, 4))) == sorted(one(spark, "క్షీ😀x\ny", lambda c: X.char_grams(c, 4)))
    for text in ("", "abc", "a b\u2003c 😀😀😀😀 d", "  x  "):
        assert one(spark, text, X.lexical_length) == len(one(spark, text, X.lexical_tokens))


def test_bm25_against_brute_force(spark, monkeypatch):
    import math
    from collections import Counter

    docs = [(1, "the sun and the moon"), (2, "the sun is hot"), (3, "rain on the hill"), (4, None), (5, "the sun is hot"), (6, "")]
    asked = [(1, "sun moon"), (2, "the the rain"), (3, None), (4, "zzzz")]
    bag = lambda t: Counter([(t or "")[i : i + 4] for i in range(len(t or "") - 3)] + (t or "").split())
    bags = {i: bag(t) for i, t in docs}
    dfs = Counter(t for b in bags.values() for t in b)
    avg = sum(b.total() for b in bags.values()) / len(docs)
    idf = {t: math.log(len(docs) - c + 0.5) - math.log(c + 0.5) for t, c in dfs.items()}
    mean = sum(idf.values()) / len(idf)
    want = {}
    for q, text in asked:
        for i, b in bags.items():
            hit = [(t, c) for t, c in bag(text).items() if t in b]
            if hit:
                want[q, i] = sum(c * (idf[t] if idf[t] >= 0 else 0.25 * mean) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * b.total() / avg)) for t, c in hit)
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    for bound in (10**6, 0):
        monkeypatch.setattr(retrieve, "BROADCAST_ROWS", bound)
        got = {(r["query_id"], r["doc_id"]): r for r in retrieve.bm25_topk(d, a, 10).collect()}
        assert {k: r["score"] for k, r in got.items()} == pytest.approx(want, abs=1e-5)
        assert got[2, 3]["rank"] == 1 and got[1, 2]["score"] == got[1, 5]["score"] and got[1, 2]["rank"] < got[1, 5]["rank"]
    assert one(spark, "१೦౨", X.number) == 102 and one(spark, "x", X.number) is None
    assert one(spark, "XLIV", X.roman) == 44 and one(spark, "MCMXC", X.roman) == 1990 and one(spark, "ABC", X.roman) is None
    assert one(spark, "एकाशीतितमोऽध्यायः", X.ordinal) == 81 and one(spark, "सप्तमोऽध्यायः", X.ordinal) == 7
    assert one(spark, "Ab1cdḹ", X.gram_set) == ["abc", "bcd"]
    assert one(spark, "कृष्ण उवाच १", X.iast) == "kṛṣṇa uvāca 1" and one(spark, "कृ।", X.telugu) == "కృ।"
    assert one(spark, "a {{t|{{u}}}}[[File:p|of [[q|r]]]] [[en:x]]b", X.clean_wikitext) == "a  b"
    assert one(spark, "{{Header|x}}== H ==\n[[a|b]]  c<i>d</i>\n\n\n\ne", X.clean_prose) == "b c d \n\ne"
    assert one(spark, "a {{t}}[[x|y]] '''b'''<ref>n</ref><br/>c", X.clean_wikitext) == "a y b\nc"
    assert one(spark, "é ", X.norm) == "é"


@pytest.mark.parametrize(("text", "quote", "ok"), [("abcd efgh. ijkl", "efgh ijkl", True), ("abcd efgh", "bcd", False), ("abcd efgh", "abcd  xfgh", False), ("caf\u00e9 au lait noir", "cafe\u0301 au lait", True)])
def test_quotes(spark, text, quote, ok):
    df = spark.createDataFrame([(text, quote)], "t string, q string")
    assert df.select(X.quoted_in(F.col("t"), F.col("q")).alias("x")).head()["x"] is ok


def test_a_mask_comes_before_the_cut(spark):
    """Documents of the hinted work beyond the best 240 of all works fill the list before any of another work."""
    import numpy as np

    rng = np.random.default_rng(3)
    vec, work, ask = np.round(rng.normal(size=(600, 8)), 3), rng.integers(0, 10, 600), np.round(rng.normal(size=(3, 8)), 3)
    units = spark.createDataFrame([(i, str(i), str(w), v.tolist()) for i, (w, v) in enumerate(zip(work, vec, strict=True))], "unit_id long, doc_id string, work string, embedding array<double>")
    queries = spark.createDataFrame([(q, str(q), v.tolist()) for q, v in enumerate(ask)], "query_id long, work string, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieve.dense_topk(units, queries, mask=True).collect()}
    for q in range(3):
        score = np.where(work == q, np.round(ask[q] @ vec.T, 6) + 0.0, -1.0)
        order = sorted(sorted(range(600), key=lambda i: (-score[i], i))[:240], key=lambda i: (-score[i], str(i)))
        assert [got[q, r + 1] for r in range(30)] == [(str(i), score[i]) for i in order[:30]]


@pytest.mark.parametrize(("dense", "lexical", "want"), [("AB", "BC", "BAC"), ("A", "C", "AC"), ("AB", "CD", "ACBD")])
def test_fusion_keeps_dense_first(spark, dense, lexical, want):
    side = lambda s: spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(s)], "query_id bigint, doc_id string, rank int")
    out = retrieve.rrf(side(dense), side(lexical), 10).orderBy("rank").collect()
    assert "".join(r["doc_id"] for r in out) == want


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(["x", "g1", "y", "g2"])], "query_id bigint, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "k", "g1"), (1, "k", "g2"), (2, "k", "z")], "query_id bigint, kind string, doc_id string")
    got = {r["query_id"]: r for r in evaluate.per_query(ranking, gold).collect()}
    assert (got[1]["hit1"], got[1]["hit5"], got[1]["rr"]) == (0, 1, 0.5) and got[1]["ndcg"] == pytest.approx(0.65092, abs=1e-5)
    assert (got[2]["hit10"], got[2]["rr"], got[2]["ndcg"]) == (0, 0, 0)


def grams(text):
    s = "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz")
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_chapters(new, old, window=10, least=0.5, alike=0.22):
    """The rule as it reads: (book, ch) to lists of gram sets on each side."""
    share = lambda n, o: sum(any(jac(g, h) >= alike for h in old[o]) for g in new[n]) / max(1, len(new[n]))
    held = {}
    for n in sorted(new):
        best, score = None, 0.0
        for d in range(-window, window + 1):
            o = (n[0], n[1] + d)
            if o in old and share(n, o) > score:
                best, score = o, share(n, o)
        if best and score >= least and (best not in held or held[best][1] < score):
            held[best] = (n, score)
    placed = {n for n, _ in held.values()}
    for n in sorted(new):
        free = sorted(((-share(n, o), o) for o in old if o not in held))
        if n not in placed and free and -free[0][0] >= least:
            held[free[0][1]] = (n, -free[0][0])
    return {n: (o, round(s, 6)) for o, (n, s) in held.items()}


@pytest.mark.parametrize("seed", range(3))
def test_chapter_map_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    text = {c: [" ".join(rng.choices(words, k=4)) for _ in range(4)] for c in range(1, 9)}
    vary = lambda t: t if rng.random() < 0.5 else t[:-4] + "zzzz"
    old = {("1", c): [grams(t) for t in v] for c, v in text.items()} | {("2", c): [grams(" ".join(rng.choices(words, k=4))) for _ in range(3)] for c in (1, 2)}
    new = {("1", c + rng.choice((0, 1, 2, 20))): [grams(vary(t)) for t in v] for c, v in text.items()}
    side = lambda d: spark.createDataFrame([("w", b, c, f"{b}.{c}.{k}", g) for (b, c), gs in d.items() for k, g in enumerate(gs)], "work string, book string, ch bigint, vid string, grams array<string>")
    got = {(r["new_book"], r["new_ch"]): ((r["old_book"], r["old_ch"]), round(r["score"], 6)) for r in align.chapter_map(side(new), side(old)).collect()}
    assert got == brute_chapters(new, old)


def test_copies_of_verses_are_one_pair_of_sets(spark, monkeypatch):
    made, keep = {}, align.stored

    def counted(df, label):
        out = keep(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(align, "stored", counted)
    lines = ["abcdefgh", "abcdefgx", "qrstuvwx", "mnopqrst"]
    new = {("1", c): [grams(lines[(c + k) % 3]) for k in range(40)] for c in range(1, 5)}
    old = {("1", c): [grams(lines[(c + k) % 2 if c % 2 else 3]) for k in range(40)] for c in range(1, 7)}
    side = lambda d: spark.createDataFrame([("w", b, c, f"{b}.{c}.{k}", g) for (b, c), gs in d.items() for k, g in enumerate(gs)], "work string, book string, ch bigint, vid string, grams array<string>")
    got = {(r["new_book"], r["new_ch"]): ((r["old_book"], r["old_ch"]), round(r["score"], 6)) for r in align.chapter_map(side(new), side(old)).collect()}
    assert got == brute_chapters(new, old)
    assert all(n <= 12 for n in made["sets"])


def brute_verses(new, old):
    """Verses by chapter (a list of (text, grams)): the rule as it reads."""
    from difflib import SequenceMatcher

    out = set()
    for c, ns in new.items():
        os_ = old.get(c, [])
        pairs = sorted(((jac(g, h), i, j) for i, (_, g) in enumerate(ns) for j, (_, h) in enumerate(os_) if set(g) & set(h)), reverse=True)
        used, first = set(), {}
        for s, i, j in pairs:
            if s >= 0.2 and i not in used and (j not in first or abs(first[j] - i) == 1):
                used.add(i)
                first.setdefault(j, i)
                out.add((c, i, c, j, "pair", None, None))
        for j, (t, _) in enumerate(os_):
            if j not in first and len(t) >= 6:
                best = None
                for i, (text, _) in enumerate(ns):
                    bl = [b for b in SequenceMatcher(None, text, t, autojunk=False).get_matching_blocks() if b.size >= 6]
                    cov = sum(b.size for b in bl) / len(t)
                    if bl and cov >= 0.25 and (best is None or cov > best[0]):
                        best = (cov, i, bl[0].a, bl[-1].a + bl[-1].size)
                if best:
                    out.add((c, best[1], c, j, "span", best[2], best[3]))
    placed_new, placed_old = {(r[0], r[1]) for r in out}, {(r[2], r[3]) for r in out}
    free = [(c, i, g) for c, ns in sorted(new.items()) for i, (_, g) in enumerate(ns) if (c, i) not in placed_new]
    for c, os_ in sorted(old.items()):
        for j, (_, h) in enumerate(os_):
            if (c, j) in placed_old or len(h) < 12 or not free:
                continue
            best = max(free, key=lambda x: (jac(x[2], h), [-ord(k) for k in x[0]], -x[1]))
            if jac(best[2], h) >= 0.4:
                out.add((best[0], best[1], c, j, "work", None, None))
                free.remove(best)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_verse_map_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80)]
    line = lambda k=6: " ".join(rng.choices(words, k=k))
    new, old = {}, {}
    for c in ("1-1", "1-2", "1-3"):
        lines = [line() for _ in range(5)]
        new[c] = [lines[0], lines[1] + " " + line(3) + " " + lines[2], lines[3], line(), line()]
        old[c] = [lines[0][:20] + line(2), lines[1][:25], lines[2], lines[3], lines[4], line(1)]
    old["1-1"][4] = new["1-2"][3][:-3] + "qqq"  # filed under another chapter
    new["9-9"] = [line()]
    shape = lambda d: {c: [(t, grams(t)) for t in v] for c, v in d.items()}
    side = lambda d: spark.createDataFrame([("w", c, k, f"{c}/{k}", t, g) for c, v in shape(d).items() for k, (t, g) in enumerate(v)], "work string, chapter string, pos bigint, vid string, text string, grams array<string>")
    a, b = side(new), side(old)
    mapped = align.verse_map(a, b).cache()
    assert {(r["chapter"], r["i"], r["old_chapter"], r["j"], r["how"], r["start"], r["end"]) for r in mapped.collect()} == brute_verses(shape(new), shape(old))
    n = {r["counter"]: r["n"] for r in align.verse_counters(a, b, mapped).collect()}
    assert n["new verses in chapters that the old edition lacks"] == 1 and n["new verses matched"] + n["new verses unmatched"] == 15
    assert n["old verses found elsewhere in the work"] >= 1 and n["old verses placed by span"] >= 1


@pytest.mark.parametrize("least", (1, 3, 6))
def test_places_are_those_of_the_blocks(least, monkeypatch):
    import random

    rng = random.Random(least)
    for k in range(400):
        monkeypatch.setattr(align, "MET_RUNS", 2_000_000 if k % 4 else 1)
        letters = "ab" if k % 2 else "abcdefgh"
        texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(5)]
        texts.append(texts[0])
        unit = "".join(rng.choice(texts)[(x := rng.randrange(30)) : x + rng.randrange(1, 25)] for _ in range(3)) + rng.choice("abc")
        met = [(b[0], -n, b[1], b[2]) for n, t in enumerate(texts) if (b := align._blocks(t, unit, least)) and b[0] >= 0.25] if len(unit) >= least else []
        want = max(met, default=None)
        assert align._Places(texts, least, 0.25).best(unit) == (want and (-want[1], want[2], want[3]))


def test_verses_move_as_texts_and_counters_read_none(spark, monkeypatch):
    written, keep = [], align.stored

    def kept(df, label):
        written.append(df)
        return keep(df, label)

    monkeypatch.setattr(align, "stored", kept)
    line = "abcdefghijklmnopqrstuvwxyz"
    rows = lambda d: spark.createDataFrame([("w", c, k, f"{c}/{k}", t) for c, v in d.items() for k, t in enumerate(v)], "work string, chapter string, pos bigint, vid string, text string")
    new, old = rows({"1": [line, "zzyyxxwwvvuu", "short"], "2": [line[::-1], "qqq"], None: [line]}), rows({"1": [line[:20], line[8:]], "2": [], "3": [line[::-1]], None: [line]})
    mapped = align.verse_map(new, old)
    got = {(r["chapter"], r["i"], r["vid"], r["old_chapter"], r["j"], r["old_vid"], r["how"], r["start"]) for r in mapped.collect()}
    assert got == {("1", 0, "1/0", "1", 0, "1/0", "pair", None), ("1", 0, "1/0", "1", 1, "1/1", "span", 8), ("2", 0, "2/0", "3", 0, "3/0", "work", None)}
    assert all(f.dataType.typeName() != "array" for d in written for f in d.schema.fields)
    counters = align.verse_counters(new, old, mapped)
    n = {r["counter"]: r["n"] for r in counters.collect()}
    assert n == {
        "new verses in chapters that the old edition lacks": 2,
        "new verses matched": 1,
        "new verses unmatched": 3,
        "old verses matched": 2,
        "old verses without a new one": 1,
        "old verses placed by span": 1,
        "old verses found elsewhere in the work": 1,
    }


def test_takers_take_the_most_alike_in_order(spark, monkeypatch):
    import random

    rng = random.Random(7)
    monkeypatch.setattr(align, "TAKERS", 5)
    monkeypatch.setattr(align, "DENSE_VALUES", 1)
    side = lambda n: [(w, f"c{rng.randrange(3)}", k, sorted(rng.sample("abcdefghij", rng.randrange(0, 8)))) for w in "vw" for k in range(n)]
    old, new = side(40), side(90) + [("w", "c9", k, ["a", "b", "c"]) for k in range(30)]
    df = lambda rows: spark.createDataFrame(rows, "work string, chapter string, pos bigint, grams array<string>")
    want, used = set(), set()
    for w, c, j, h in sorted(old):
        free = [((-jac(g, h), d, i), (w, d, i)) for x, d, i, g in new if x == w and (w, d, i) not in used and set(g) & set(h) and jac(g, h) >= 0.4]
        if free:
            taken = min(free)[1]
            used.add(taken)
            want.add((w, c, j, *taken[1:]))
    got = align.take_alike(df(old), df(new), 0.4).collect()
    assert {(r["work"], r["old_chapter"], r["j"], r["chapter"], r["i"]) for r in got} == want and len(got) == len(want)


def test_no_blocks_cover_more_than_the_runs_they_are_made_of():
    import random

    rng = random.Random(3)
    for _ in range(300):
        t, u = ("".join(rng.choices("ab", k=rng.randrange(6, 60))) for _ in range(2))
        found = align._blocks(t, u, 6)
        assert (found or (0,))[0] <= align._covered(frozenset(t[k : k + 6] for k in range(len(t) - 5)), u, 6) <= 1


def test_records_are_cut_at_spans(spark):
    rec = spark.createDataFrame([("c", 0, "lead text that is long | first part second part"), ("c", 1, "whole")], "chapter string, i bigint, text string")
    rows = [("c", 0, "own", "pair", None, None), ("c", 0, "a", "span", 25, 35), ("c", 0, "b", "span", 36, 47)]
    mapped = spark.createDataFrame(rows, "chapter string, i bigint, old_vid string, how string, start bigint, end bigint")
    got = [(r["i"], r["part"], r["target"], r["text"]) for r in align.cut_records(rec, mapped).orderBy("i", "part").collect()]
    assert got == [(0, 0, "own", "lead text that is long |"), (0, 1, "a", "first part"), (0, 2, "b", "second part"), (1, 0, None, "whole")]


def test_jaccard_pairs_lose_nothing(spark):
    import itertools
    import random

    rng = random.Random(4)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 8))} for i in range(40)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "lid int, grams array<string>")
    got = {(r["lid"], r["rid"]) for r in align.jaccard_pairs(df, df.withColumnRenamed("lid", "rid"), 0.5).collect()}
    assert got == {(a, b) for a, b in itertools.product(sets, sets) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}


def test_answers(spark):
    class Twice(qa.OfflineClient):
        def answer(self, question, passages, attempt):
            quote = passages[0]["text"] if attempt else "never said this at all"
            return "a", [{"verse_id": passages[0]["verse_id"], "quote": quote}], True

    q = spark.createDataFrame([(1, "what"), (2, "")], "query_id bigint, text string")
    p = spark.createDataFrame([(1, "v1", "some words that are said", 1)], "query_id bigint, verse_id string, text string, rank int")
    got = {r["query_id"]: r for r in qa.answer(q, p, Twice()).collect()}
    assert (got[1]["status"], got[1]["attempts"]) == ("answered", 2) and got[2]["status"] == "refused"


def test_validate_and_repair(spark):
    schema = "adhyaya_id string, n_verses int, verse_ids array<string>, card struct<title_te:string,summary_te:string,questions_te:array<string>,entities:array<string>,anchors:array<struct<topic_te:string,verse_ids:array<string>>>>"
    card = ("శీ", "స", ["q"] * 8, ["e"] * 5, [("t", ["p-1-1-1"]), ("t", ["bad 2"]), ("t", ["p-1-1-3", "zz"])])
    df = spark.createDataFrame([("p-1-1", 9, ["p-1-1-1", "p-1-1-2", "p-1-1-3"], card)], schema)
    assert df.select(cards.card_errors().alias("e")).head()["e"] == ["bad_anchor"]
    out = cards.repair(df).head()
    assert out["action"] == "repaired" and [a["verse_ids"] for a in out["card"]["anchors"]] == [["p-1-1-1"], ["p-1-1-2"], ["p-1-1-3"]]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    (tmp_path / "w.part2.jsonl").write_text('{"id": "c"}\n')
    assert readers.jsonl_parts(spark, str(tmp_path), "w", "id string").count() == 3
    (tmp_path / "map.json").write_text('{"1-1": {"to": "1-2", "score": 0.5}}')
    assert readers.json_map(spark, str(tmp_path / "map.json"), "struct<to:string,score:double>").head()["key"] == "1-1"
    (tmp_path / "page.txt").write_text('{"title": "T"}\nbody\nmore')
    assert tuple(readers.pages(spark, str(tmp_path / "page.txt"), "title string").head()) == ("T", "body\nmore")
    (tmp_path / "m.txt").write_text("head # Text one # Text two")
    assert readers.text_after(spark, str(tmp_path / "m.txt"), "# Text").head()["text"] == " one # Text two"
    (tmp_path / "g.txt").write_text("﻿x\r\n*** START OF BOOK ***\nbody\n*** END OF BOOK")
    assert readers.text_between(spark, str(tmp_path / "g.txt")).head()["text"].strip() == "body"
    df = spark.range(3)
    assert sinks.jsonl(df, str(tmp_path / "out")) == 3
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "cache"), ["id"])
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3
    pages = {("p", ""): (["a", "b"], "t"), ("p", "t"): (["c"], None)}
    assert readers.listed(spark, lambda p, t, n: pages[(p, t)], ["p"]).count() == 3


def test_stream_upserts_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = incremental.rows_of(spark, str(tmp_path / "in"), "id bigint")
        incremental.upsert_new(stream, str(tmp_path / "out"), ["id"], str(tmp_path / f"check{k}")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_catalog_has_sql_for_most():
    from corpusloom.plans import catalog

    assert len(catalog.queries()) >= 40 and len(catalog.oracle_sql()) >= 33 and set(catalog.oracle_sql()) <= set(catalog.queries())


def test_chapters_are_mapped_by_small_plans(spark, monkeypatch):
    exchanges, keep = [], align.stored

    def counted(df, label):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return keep(df, label)

    monkeypatch.setattr(align, "stored", counted)
    side = lambda *vs: spark.createDataFrame([("w", "1", c, v, grams(t)) for c, v, t in vs], "work string, book string, ch bigint, vid string, grams array<string>")
    # a verse's id may come twice: its rows count for the size, its matches once
    new = side((1, "a", "abcdefgh"), (1, "a", "mnopqrst"), (30, "b", "qqwweerr"), (31, "c", ""))
    old = side((1, "x", "abcdefgh"), (2, "y", "mnopqrst"), (3, "z", "qqwweerr"), (31, "c", ""))
    got = align.chapter_map(new, old)
    exchanges.append(got._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert {(r["new_ch"], r["old_ch"], r["score"], r["pass"]) for r in got.collect()} == {(1, 1, 0.5, "band"), (30, 3, 1.0, "work")}
    assert max(exchanges) <= 14


@pytest.mark.parametrize("masked", (False, True))
def test_kept_scores_are_the_best_of_all(masked, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    best, named = np.full((4, 6), -np.inf), np.full((4, 6), np.iinfo(np.int64).max)
    sorts, sort = [], np.lexsort
    monkeypatch.setattr(retrieve.np, "lexsort", lambda keys, **k: sorts.append(keys[0].size) or sort(keys, **k))
    rows, names = [], rng.permutation(6_000)
    for low in range(0, 6_000, 1_000):
        score = np.round(rng.normal(size=(4, 1_000)), 2)
        score[0, 3], score[1] = np.nan, np.where(rng.random(1_000) < 0.002, score[1], -1.0 if masked else -np.inf)
        rows.append(score)
        best, named = retrieve._kept(best, named, score, names[low : low + 1_000])
    score = np.concatenate(rows, axis=1)
    for k in range(4):
        want = sorted(((-s, n) for s, n in zip(score[k].tolist(), names.tolist(), strict=True) if np.isfinite(s)))[:6]
        assert [(-s, n) for s, n in zip(best[k].tolist(), named[k].tolist(), strict=True) if np.isfinite(s)] == want
    assert max(sorts[1:], default=0) < 2_000


def test_tallies_add_up():
    import numpy as np

    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, n).astype(np.uint64) for n in (0, 1, 40, 300)]
    tally = retrieve._tallied(parts[0])
    for p in parts[1:]:
        tally = retrieve._added(tally, retrieve._tallied(p))
    assert [x.tolist() for x in tally] == [x.tolist() for x in np.unique(np.concatenate(parts), return_counts=True)]
