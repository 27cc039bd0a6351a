"""Operators against brute force on small fixtures, and the edge cases that each must define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _arrow, bagminhash, bpe, exactdedup, graph, langid, linededup, packing, pfor, quality_model, quality_rules, queries, substring

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"
WS = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(f"[^{WS}]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    long = " ".join(f"wort{i % 977} and{i}" for i in range(60_000)) + "\nend."
    same = "one two three four five six seven eight nine ten. " * 3
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Hello there, é world", "fr", "a", 5), (3, long, "en", "a", 1), (4, same, "en", "b", 1), (4, same, "en", "b", 1), (5, same + " ", None, "b", 1), (6, " \t\n\n ", "de", None, 1), (7, "123 456", "de", None, 1), (None, None, None, None, None), (8, "<|endoftext|> ‚quote’ 😀\r\nx\x1cy", "en", "a", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def hf():
    return tokenizers.Tokenizer.from_file(queries.vocabulary())


# ------------------------------------------------------------ words


@pytest.mark.parametrize("texts_", [["a b", "", " c\n\nd ", "é\x0bf", "g"], ["", ""], [], ["x" * 70_000 + " y"]])
def test_words_are_runs_of_ink(texts_):
    buf, off = _arrow.flat(pa.array(texts_, pa.string()))
    w = _arrow.Words(buf, off)
    got = [bytes(buf[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts_ for x in words(t)]
    assert w.count.tolist() == [len(words(t)) for t in texts_]


def test_segment_hash_depends_on_bytes_alone():
    buf = np.frombuffer(b"abcabcabd", np.uint8)
    h = _arrow.segment_hash(buf, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


# ------------------------------------------------------------ BPE


def test_forced_boundaries_give_the_ids_of_whole_texts(texts, odd):
    sample = [t or "" for t in texts.values()] + [r["text"] or "" for r in odd.collect()]
    rng = np.random.default_rng(3)
    bits = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "qz", "zx", "Q", "7", "!", "é", " ", "　", "中", "😀", "́", "\x1c", "<|endoftext|>", "RE"]
    sample += ["".join(rng.choice(bits, 15)) for _ in range(3000)]
    codec = bpe.codec(queries.vocabulary())
    want = [e.ids for e in hf().encode_batch(sample, add_special_tokens=False)]
    got = [ids[off[i] : off[i + 1]].tolist() for a, b, ids, off in codec.encode(pa.array(sample)) for i in range(b - a)]
    assert got == want
    assert [codec.decode(x) for x in want[-300:]] == [hf().decode(x, skip_special_tokens=False) for x in want[-300:]]


def test_no_cut_lies_inside_a_token():
    codec = bpe.codec(queries.vocabulary())
    assert not any(len(codec.cuts(np.frombuffer(p, np.uint8))) for p in codec.piece)


def test_round_trip_query(odd):
    tok, want = hf(), Counter()
    for r in odd.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(odd, queries.vocabulary()).collect()) == want


def test_encode_then_decode(spark, docs, texts):
    back = bpe.decode(bpe.encode(docs, queries.vocabulary()), queries.vocabulary())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: v or "" for k, v in texts.items()}


# ------------------------------------------------------------ packing


def pieces_are_whole(rows, want, capacity=1024):
    """Each id in exactly one piece, sequences gapless; returns the share of padding."""
    seq = defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    used = []
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        used.append(at)
    got = Counter()
    for r in rows:
        got[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert got == Counter({k: n * k[1] for k, n in want.items()})
    pad = sum(0 if u & (u - 1) == 0 else capacity - u for u in used)
    return pad / max(1, sum(used))


def test_packing(docs, texts):
    tok = hf()
    ids = {k: [*tok.encode(v or "", add_special_tokens=False).ids, 0] for k, v in texts.items()}
    rows = packing.pack(docs, queries.vocabulary()).collect()
    assert pieces_are_whole(rows, Counter((k, len(v)) for k, v in ids.items())) < 0.02
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]


def test_packing_of_odd_rows(odd):
    tok = hf()
    want = Counter((r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    pieces_are_whole(packing.pack(odd, queries.vocabulary()).collect(), want)
    assert packing.pack(odd.limit(0), queries.vocabulary()).count() == 0


def test_exact_classes_hold_a_fixed_count():
    packer = packing.HarmonicPacker(64, 8)
    out = [p for n in (32, 32, 16, 16, 16, 16, 5) for p in packer.add("d", np.arange(n, dtype=np.uint32))]
    assert Counter(p[4] for p in out) == {0: 2, 1: 4}
    assert [len(p[2]) for p in packer.close()] == [4, 1]
    with pytest.raises(ValueError):
        packing.HarmonicPacker(1000)


# ------------------------------------------------------------ token files


@pytest.mark.parametrize("n", [1, 255, 256, 257, 300_000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32 - 1])
def test_blocks_round_trip(tmp_path, n, top):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, top, n), rng.integers(0, max(1, top // 1000), n)).astype(np.uint32)
    lengths = [n // 3, 0, n - n // 3]
    with (tmp_path / "x").open("wb") as f:
        w = pfor.Writer(f)
        w.add([7, None, 9], np.array(lengths), ids)
        assert w.close() == n
    with pa.OSFile(str(tmp_path / "x")) as f:
        r = pfor.Reader(f)
        assert r.docs == [7, None, 9] and r.lengths.tolist() == lengths
        assert np.array_equal(np.concatenate(list(r.frames())), ids)
        at = n // 2
        assert np.array_equal(r.ids(at, 200), ids[at : at + 200])


def test_token_files(docs, odd):
    tok = hf()
    for table in (docs, odd):
        rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in table.collect())
        at, want = 0, []
        for known, doc, _, text in rows:
            ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
            want.append((doc if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, pfor.write_and_read(table, queries.vocabulary()).collect()), key=lambda r: r[1]) == want
    assert pfor.write_and_read(odd.limit(0), queries.vocabulary()).count() == 0


def test_files_of_failed_attempts_go(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = pfor.write_files(docs, queries.vocabulary(), folder).cache()
    want = sorted(r["uri"].rpartition("/")[2] for r in manifest.collect())
    (tmp_path / "ids" / "shard-0000000-99999.pfor").write_bytes(b"half")
    assert pfor.sweep(manifest, folder) == 1
    assert sorted(p.name for p in (tmp_path / "ids").iterdir() if p.suffix == ".pfor") == want


# ------------------------------------------------------------ line dedup


def brute_lines(rows, least, min_key=1):
    key = lambda x: lower(x.strip(WS))
    # rows of one id are one document; rows without an id are one for each distinct text
    own = {((i, None) if i is not None else (None, t), key(x)) for i, t in rows for x in (t or "").split("\n")}
    seen = Counter(k for _, k in own if len(k) >= min_key)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if len(key(x)) < min_key or seen[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return Counter(out)


def test_line_dedup(docs, odd, spark):
    more = spark.createDataFrame([(100 + i, f"\x0b Éa {'Été' if i % 2 else 'été'}\nSame LINE \nrow {i}" if i % 3 else "same line\n\nÉA Été", "x", "y", 1) for i in range(12)], SCHEMA)
    for table in (docs, odd.unionByName(more)):
        for least, key in ((2, 1), (4, 5)):
            got = linededup.drop_frequent_lines(table, min_docs=least, min_key=key)
            assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()) == brute_lines([(r["doc_id"], r["text"]) for r in table.collect()], least, key)


def test_line_dedup_carries_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", 9, "k", 3), (2, "a", 9, "k", 4)], "doc_id bigint, text string, n_lines int, k string, d int")
    got = {r["doc_id"]: r for r in linededup.drop_frequent_lines(df, min_docs=2).collect()}
    assert got[1]["text"] == "b" and got[1]["d"] == 3 and got[1]["k"] == "k" and got[1]["n_lines"] == 2
    assert linededup.drop_frequent_lines(df.limit(0)).count() == 0


def test_line_dedup_runs_no_python(docs):
    plan = linededup.drop_frequent_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------ exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in WS)].append((-len(t or ""), i is None, i or 0, i))
    return Counter((i, min(g)[3], len(g), min(g)[3] == i, hashlib.sha256(s.encode()).hexdigest()) for s, g in groups.items() for _, _, _, i in g)


def test_exact_dedup(docs, odd):
    for table in (docs, odd, odd.limit(0)):
        want = brute_exact([(r["doc_id"], r["text"]) for r in table.collect()])
        for incoming in (exactdedup.halves(), F.lit(True), F.lit(False)):
            assert Counter(map(tuple, exactdedup.dedup_batch(table, incoming).collect())) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = exactdedup.BinaryFuse8.build(keys)
    assert f.contains(keys).all()
    other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.012
    assert len(f.table) < max(64, 1.6 * n)


# ------------------------------------------------------------ near dedup


def bag(text):
    w = words(lower(text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows, threshold=0.8):
    """Rows are told apart by id and text: equal ids alone link nothing."""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and similarity(bags[i], bags[j]) >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    return Counter((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)


def test_near_duplicates(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, bagminhash.classes(docs).collect())) == brute_classes(rows)
    one = bagminhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c, _ in brute_classes(rows)})


@pytest.mark.parametrize("block", [4, 1024])
def test_a_group_of_graded_copies(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, i // 6):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    got = bagminhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, got.collect())) == brute_classes(rows)


def test_near_duplicates_of_odd_rows(odd):
    got = Counter(map(tuple, bagminhash.classes(odd).collect()))
    assert got[(4, 4, 3)] == 2 and got[(5, 4, 3)] == 1  # the repeated row and its copy
    assert got[(1, 1, 1)] == got[(2, 2, 1)] == got[(6, 6, 1)] == 1  # nothing to compare
    assert sum(got.values()) == odd.count() and bagminhash.classes(odd.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    a, b = {1: 5, 2: 3, 3: 1, 4: 40}, {1: 2, 2: 3, 4: 25, 5: 4}
    doc = np.array([0] * 4 + [1] * 4)
    h = _arrow.mix(np.array([*a, *b], np.uint64))
    w = np.array([*a.values(), *b.values()])
    sig = bagminhash.signatures(doc, h, w, 3, components=4000)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    assert abs((sig[0] == sig[1]).mean() - want) < 0.035
    assert np.isinf(sig[2]).all() and np.isfinite(sig[:2]).all()


def test_components(spark):
    edges = [(f"a{i:03}", f"a{i + 1:03}") for i in range(40)] + [("b0", f"b{i}") for i in range(1, 30)] + [("c", "d"), ("d", "c"), ("e", "e")]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {v for k, v in got.items() if k[0] == "a"} == {"a000"} and {v for k, v in got.items() if k[0] == "b"} == {"b0"} and got["d"] == "c"


# ------------------------------------------------------------ substring dedup


def windows(texts_, n=50):
    seen = defaultdict(set)
    for i, t in texts_.items():
        w = words(lower(t or ""))
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i for v in seen.values() if len(v) > 1 for i in v - {min(v)}}


def test_repeats_go_and_offsets_hold(docs, texts):
    rows = substring.drop_repeats(docs.select("doc_id", "text"), **queries.REPEATS).collect()
    for r in rows:
        t, at, out = texts[r["doc_id"]], 0, []
        for s in r["removed"]:
            out.append(t[at : s["start"]])
            at = s["end"]
        assert r["text"] == (None if t is None else "".join(out) + t[at:]) and r["n_removed"] == len(r["removed"])
    assert windows(texts) <= {r["doc_id"] for r in rows if r["n_removed"]}
    assert len(windows({r["doc_id"]: r["text"] for r in rows})) <= len(windows(texts)) // 10


def test_a_planted_passage(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(" ".join(f"w{x}" for x in rng.integers(0, 10**9, 9)) + "." for _ in range(n))
    passage = prose(7)
    rows = [(i, f"{prose(4)} {passage if i % 2 else ''} {prose(3)}\nShort shared line of six words.\n{prose(2)}") for i in range(8)]
    got = {r["doc_id"]: r for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), **queries.REPEATS).collect()}
    assert passage in got[1]["text"]  # the earliest stays
    assert all(passage[:80] not in got[i]["text"] and got[i]["n_removed"] == 1 for i in (3, 5, 7))
    assert all(got[i]["n_removed"] == 0 and got[i]["text"] == rows[i][1] for i in (0, 2, 4, 6))


def test_a_passage_spliced_into_sentences(spark):
    """55 words around one short sentence, in the middle of other sentences."""
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passages = [f"{some(20)}. {some(15)}. {some(20)}" for _ in range(20)]
    rows = [(2 * k + i, f"{some(30)}. {some(12)} {p} {some(12)}. {some(30)}.") for k, p in enumerate(passages) for i in range(2)]
    got = {r["doc_id"]: r for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), **queries.REPEATS).collect()}
    gone = [len(set(words(p)) - set(words(got[2 * k + 1]["text"]))) for k, p in enumerate(passages)]
    assert all(got[2 * k]["text"] == rows[2 * k][1] for k in range(20))
    assert min(gone) >= 20 and np.mean(gone) > 38
    assert all(set(words(rows[2 * k + 1][1])) - set(words(p)) <= set(words(got[2 * k + 1]["text"])) for k, p in enumerate(passages))


def test_passages_of_51_words_without_a_sentence_end(spark):
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passages = [some(51) for _ in range(1500)]
    rows = [(2 * k + i, f"{some(30)}. {some(12)} {p} {some(12)}. {some(30)}.") for k, p in enumerate(passages) for i in range(2)]
    got = {r["doc_id"]: r for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), **queries.REPEATS).collect()}
    for k, p in enumerate(passages):
        assert got[2 * k]["text"] == rows[2 * k][1]
        kept, whole = words(got[2 * k + 1]["text"]), words(rows[2 * k + 1][1])
        assert len(whole) - len(kept) >= 51 - 2 * substring.REACH - 1 >= 20
        assert set(whole) - set(words(p)) <= set(kept)


def test_a_passage_with_lines_of_one_word(spark):
    """Lines of 12 words with one-word lines between, a word a line, and a script without spaces; columns of figures stay."""
    rng = np.random.default_rng(7)
    some = lambda n, by=" ": by.join(f"w{x}" for x in rng.integers(0, 10**9, n))
    han = lambda n: "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA6, n))
    thai = lambda n: "".join(chr(x) for x in rng.integers(0xE01, 0xE2F, n))
    passages = ["\n".join(f"{some(12)}\n{h}" for h in ("ANNA:", "*", "----", "IV", "BEN:")), some(30, "\n"), han(120), thai(160)]
    formulas = ["\n".join(["ANNA:", some(8), "*", some(8), "--"]), some(19, "\n"), han(39), thai(79)]
    rows = [(10 * k + i, f"{some(30)}.\n{p}\n{some(30)}.") for k, p in enumerate(passages + formulas) for i in range(3)]
    rows += [(10 * k + 3, "\n".join(str(x) for x in rng.integers(0, 10, 25))) for k in range(20)]
    got = {r["doc_id"]: r for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), **queries.REPEATS).collect()}
    for i, text in rows:
        k, later = divmod(i, 10)
        gone = k < len(passages) and later in (1, 2)
        assert got[i]["n_removed"] == gone
        edge = {1: "\n".join(passages[1].split()[: substring.AROUND - 1]) + "\n"}.get(k, "")
        left, right = (text.split(passages[k])[0], text.split(passages[k])[1][1:]) if gone else (text, "")
        assert got[i]["text"].startswith(left) and got[i]["text"].endswith(right)
        assert len(got[i]["text"]) <= len(left + edge + right) + 12 * gone * (k > 1)


def test_substring_dedup_of_odd_rows(odd):
    got = Counter((r["doc_id"], r["n_removed"] > 0) for r in substring.drop_repeats(odd, **queries.REPEATS).collect())
    assert got[(1, False)] == 1 and got[(5, True)] == 1 and sum(got.values()) == odd.count()
    assert substring.drop_repeats(odd.limit(0), **queries.REPEATS).count() == 0


# ------------------------------------------------------------ quality


def brute_stats(text):
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_statistics(docs, odd):
    for table in (docs, odd):
        got = quality_rules.judge(table, None).collect()
        want = Counter((r["doc_id"], *brute_stats(r["text"])) for r in table.collect())
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert all(r["kept"] != r["base_failed"] for r in got)


def test_trees_separate_and_are_monotone(docs, labels):
    trees = quality_rules.fit(docs, labels)
    rows = quality_rules.judge(docs, trees).join(labels, "doc_id").toPandas()
    assert ((rows["score"] >= 0.3) == (rows["quality"] == 1)).mean() > 0.97
    kept = quality_rules.keep_good(docs, trees)
    assert kept.columns == docs.columns and kept.count() == quality_rules.judge(docs, trees).where("kept").count()
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality_rules.FEATURES)))
    y = ((x[:, 2] + 0.3 * rng.random(300)) < 0.6).astype(float)
    sign = np.array([quality_rules.MONOTONE[f] for f in quality_rules.FEATURES])
    fitted = quality_rules.Booster(trees=20).fit(x, y, sign)
    line = np.repeat(x[:20], 50, axis=0)
    line[:, 2] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(fitted.margin(line).reshape(20, 50), axis=1) <= 1e-12).all()


def test_quality_without_labels(docs, labels, odd, spark):
    assert quality_rules.fit(docs, labels.limit(0)) is None and quality_rules.fit(docs, labels.where("quality = 1")) is None
    assert quality_rules.judge(odd.limit(0), None).count() == 0 and quality_rules.keep_good(odd.limit(0), None).count() == 0
    vectors = quality_model.word_vectors(odd)
    assert quality_model.fit(docs, labels.limit(0), vectors) == 0.5
    assert quality_model.score(odd, 0.5, vectors).count() == odd.count()
    assert quality_model.word_vectors(odd.limit(0)).count == 0


def brute_vectors(texts_, least):
    """Random indexing by dictionaries: key to the vector of its neighbours, as the method reads."""
    h = lambda w: int(_arrow.segment_hash(np.frombuffer(lower(w).encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) | 1 << 32
    shape = lambda w: int(np.bitwise_or.reduce(quality_model._SHAPE[np.frombuffer(w.encode(), np.uint8)])) & 63
    index = lambda x: quality_model.index(np.array([x], np.uint64))[:, 0].tolist()
    docs_ = [words(t) for t in texts_]
    count = Counter(h(w) for d in docs_ for w in d)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda w: signed(h(w)) if count[h(w)] >= least else 64 + h(w) % quality_model.RARE
    total = defaultdict(lambda: np.zeros(quality_model.DIMS))

    def learn(who, near, turn):
        for k, d in enumerate(index(near)):
            total[who][(d + turn) % quality_model.DIMS] += 1 if k < 2 else -1

    for d in docs_:
        for i, w in enumerate(d):
            learn(key(w), shape(w), 2)
            learn(shape(w), h(w), 3)
            if i + 1 < len(d):
                learn(key(w), h(d[i + 1]), 1)
                learn(key(d[i + 1]), h(w), 0)
                learn(shape(w), shape(d[i + 1]), 1)
                learn(shape(d[i + 1]), shape(w), 0)
    damped = {k: np.sign(v) * np.log1p(np.abs(v)) for k, v in total.items()}
    mean = np.mean(list(damped.values()), axis=0)
    return {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-9) for k, v in damped.items()}, key, shape


@pytest.mark.parametrize("few", [10**6, 3])
def test_word_vectors_and_features_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(quality_model, "WORDS", few)
    monkeypatch.setattr(quality_model, "GROUP_BYTES", 200)
    rng = np.random.default_rng(1)
    texts_ = [" ".join(f"{'Wx'[k % 2]}{x}{',' if x % 3 else ''}" for k, x in enumerate(rng.integers(0, 25, n))) for n in (0, 1, 2, 30, 80, 50)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    want, key, shape = brute_vectors(texts_, 5)
    vectors = quality_model.word_vectors(df, least=5)
    got = {r["key"]: np.frombuffer(r["v"], np.float16) for r in vectors.table.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=2e-3) for k in want)
    assert (vectors.local is None) == (few == 3)
    labels_ = spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id bigint, quality int, toxic int")
    model = quality_model.fit(df, labels_, vectors)
    for r in quality_model.score(df, model, vectors).collect():
        w = words(texts_[r["doc_id"]])
        x = np.zeros(3 * quality_model.DIMS + 1)
        x[-1] = np.log1p(len(w))
        if w:
            v = [got[key(a)].astype(float) for a in w]
            x[:32] = np.mean(v, axis=0)
            x[32:64] = np.mean([got[shape(a)].astype(float) for a in w], axis=0)
            x[64:96] = sum((a * b for a, b in zip(v, v[1:], strict=False)), np.zeros(32)) / max(1, len(w) - 1)
        z = [min(6, max(-6, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        hidden = [np.tanh(sum(z[i] * model.w1[i, j] for i in range(len(z))) + model.b1[j]) for j in range(len(model.b1))]
        logit = sum(a * b for a, b in zip(hidden, model.w2, strict=True)) + model.b2
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit / model.temperature)), abs=2e-3)


def test_index_vectors_have_four_dimensions():
    d = quality_model.index(np.arange(5000, dtype=np.uint64))
    assert all(len(set(c)) == 4 for c in d.T) and set(d.reshape(-1)) == set(range(quality_model.DIMS))


def walk(trees, x):
    """The margin of one document, node by node."""
    out = trees.base
    for root in trees.roots:
        node = root
        while trees.left[node] != node:
            node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        out += trees.value[node]
    return out


def test_flat_trees_equal_a_walk(docs, labels, texts):
    trees = quality_rules.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs, trees).collect()}
    for i, t in list(texts.items())[:80]:
        buf, off = _arrow.flat(pa.array([t], pa.string()))
        x = quality_rules.features(quality_rules.statistics(buf, off))[0]
        score = 1 / (1 + np.exp(-walk(trees, x)))
        assert rows[i]["score"] == pytest.approx(score, abs=1e-9)
        assert rows[i]["kept"] == (not brute_stats(t)[5] and score >= 0.3)


def test_quality_rules_held_out(spark):
    """Without the labels of a fifth of the documents, the trees tell theirs."""
    from corpusloom.llm._shared import fold

    d, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_rules.fit(d, marks.where(fold("doc_id", 5) != 0))
    held = quality_rules.judge(d, trees).join(marks.where(fold("doc_id", 5) == 0), "doc_id").toPandas()
    assert len(held) >= 50 and ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.95


def test_repeated_ids_learn_the_same(spark):
    from corpusloom.llm._labels import labelled

    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, None)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    runs = {tuple(sorted((r["doc_id"], r["text"] or "") for r in labelled(df.repartition(k), marks, 10).collect())) for k in (1, 3, 5)}
    assert len(runs) == 1


def test_quality_model_held_out(spark):
    out = queries.op9_quality_model(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = out[out["held_out"]].merge(labels, on="doc_id")
    assert ((held["predicted"] == 1) == (held["quality"] == 1)).mean() > 0.95
    assert out["score"].between(0, 1).all() and out["held_out"].mean() < 0.3


# ------------------------------------------------------------ language


def test_language_held_out(spark):
    out = queries.op1_ppm_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    held = out[out["held_out"]].merge(docs[docs["lang"].notna()], on="doc_id")
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert (out["held_out"] == (out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1)).all()


def test_code_lengths_are_those_of_method_c():
    train = {"a": b"abracadabra banana", "b": b"hocus pocus \xc3\xa9t\xc3\xa9"}
    grams = Counter()
    for lang, t in train.items():
        s = b"\0\0\0" + t
        for i in range(3, len(s)):
            grams[(lang, int.from_bytes(s[i - 3 : i + 1], "big"))] += 1
    keys = list(grams)
    m = langid.compile_trees(["a", "b"], np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.int64), np.array([grams[k] for k in keys], float))

    def bits(lang, text):
        s, total = b"\0\0\0" + train[lang], 0.0
        t = b"\0\0\0" + text
        for i in range(3, len(t)):
            for k in range(3, -2, -1):
                if k < 0:
                    total += 8
                    break
                ctx = t[i - k : i]
                after = Counter(s[j] for j in range(3, len(s)) if s[j - k : j] == ctx)
                n, q = sum(after.values()), len(after)
                if not n:
                    continue
                if after[t[i]]:
                    total += np.log2((n + q) / after[t[i]])
                    break
                total += np.log2((n + q) / q)
        return total

    tests = [b"abra", b"pocus hocus", b"\xff zebra", b"", b"t\xc3\xa9"]
    got = langid.code_lengths(m, np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)]))
    assert np.allclose(got, [[bits("a", t), bits("b", t)] for t in tests], atol=1e-3)


def test_groups_of_languages_say_the_same(spark, docs, monkeypatch):
    """However languages are dealt, and a text is sliced, the label is that of the shortest code of brute force."""
    whole = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs, F.lit(True), per_lang=20)).collect()}
    monkeypatch.setattr(langid, "GRAMS", 1500)
    monkeypatch.setattr(langid, "SLICE", 1)
    trees = langid.fit(docs, F.lit(True), per_lang=20)
    assert trees.groups == 4
    models = [trees.model(g) for g in range(4)]
    for r in langid.identify(docs, trees).collect():
        one = whole[r["doc_id"]]
        assert r["lang_pred"] == one["lang_pred"] and r["score"] == pytest.approx(one["score"], abs=1e-6) and r["bits_per_byte"] == pytest.approx(one["bits_per_byte"], rel=1e-5)
    text = np.frombuffer(docs.where("doc_id = 3").head()["text"].encode(), np.uint8)
    bits = {m.langs[0]: langid.code_lengths(m, text, np.array([0, len(text)]))[0, 0] for m in models}
    assert min(bits, key=bits.get) == whole[3]["lang_pred"]


def test_language_of_odd_rows(spark, odd):
    got = langid.identify(odd, langid.fit(odd, F.lit(True))).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 6, 7) or (r["doc_id"] is None and r["score"] == 0)) for r in got)
    assert langid.fit(odd.limit(0), F.lit(True)) is None
    none = langid.identify(odd, None).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in none)


# ------------------------------------------------------------ pipeline


def test_pipeline_equals_its_stages(spark, docs, texts):
    import corpus_pipeline as p

    at = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        at = out.cache()
    rows = p.run(spark, SF).collect()
    tok = hf()
    want = Counter((r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in at.collect())
    pieces_are_whole(rows, want)


def test_pipeline_stages_against_brute_force(spark, docs, texts, labels):
    import corpus_pipeline as p

    kept = {r["doc_id"]: r["text"] for r in p.drop_poor(spark, docs, SF).collect()}
    assert not any(brute_stats(t)[5] for t in kept.values())
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(bad & set(kept)) <= 0.03 * len(bad)
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect() if not brute_stats(texts[r["doc_id"]])[5]}
    assert len(clean & set(kept)) >= 0.98 * len(clean)
    frame = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in kept.items()], SCHEMA)
    lines = {(r["doc_id"], r["text"], r["n_chars"]) for r in p.drop_lines(spark, frame, SF).collect()}
    assert lines == {(i, t, len(t)) for i, _, _, t in brute_lines(list(kept.items()), 10)}
    near = {r["doc_id"] for r in p.drop_near_copies(spark, frame, SF).collect()}
    assert near == {c for _, c, _ in brute_classes(list(kept.items()))}


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    rows = [tuple(r) for r in odd.collect()]
    ids = lambda out: Counter(r["doc_id"] for r in out.collect())
    got = {name: stage(spark, odd, SF) for name, stage in p.STAGES}
    assert set(ids(got["quality_rules"])) <= {r[0] for r in rows if not brute_stats(r[1])[5]}
    for name in ("line_dedup", "substring_dedup"):
        assert ids(got[name]) == Counter(r[0] for r in rows), name
    assert Counter(tuple(r) for r in got["line_dedup"].collect()) == Counter((i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in rows)
    near = Counter(tuple(r) for r in got["near_dedup"].collect())
    assert near == Counter(r for r in rows if r[0] != 5)  # 5 is 4 with a space at its end; the repeated row of 4 stays with it
    want = Counter((i, len(hf().encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    pieces_are_whole(got["packing"].collect(), want)
    for name, stage in p.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 11))
