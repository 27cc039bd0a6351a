"""Queries of building, selecting, projecting and writing a corpus, each with SQL that gives the same rows.

Orders are chapters (customers their books, order status their work), lineitems verses, parts titles,
and documents cards: first line the title, second the summary, the rest questions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, cards, evaluate, parse, qa, records, retrieve, select, sequence
from ..sources import readers, sinks
from ..sources.tables import stored
from ..streaming import incremental
from .registry import query, table


def _chapters(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("adhyaya_id"), F.col("o_orderstatus").alias("work"), (F.col("o_custkey") % 12).alias("book_no"), F.col("o_orderkey").alias("adhyaya_no"), F.col("o_totalprice").alias("price"))


_CHAPTERS = "WITH c AS (SELECT o_orderkey::VARCHAR AS adhyaya_id, o_orderstatus AS work, o_custkey % 12 AS book_no, o_orderkey AS adhyaya_no, o_totalprice AS price FROM orders) "
_KEY = "SELECT adhyaya_id, work, book_no FROM c "


def _key(df):
    return df.select("adhyaya_id", "work", "book_no")


# ---------------------------------------------------------------- selection


@query(_CHAPTERS + _KEY + "WHERE book_no = 3")
def chapter_selection(spark, sf_dir):
    return _key(select.chapters(_chapters(spark, sf_dir), book=3))


@query(_CHAPTERS + _KEY + "WHERE work = 'O' OR (work = 'F' AND book_no IN (2, 10))")
def work_spec(spark, sf_dir):
    return _key(select.of_works(_chapters(spark, sf_dir), ["O", "F:2,10"]))


@query(_CHAPTERS + _KEY + "WHERE adhyaya_no % 3 <> 0 AND adhyaya_id NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R')")
def only_new_chapters(spark, sf_dir):
    c = _chapters(spark, sf_dir).withColumn("adhyaya_no", F.concat(F.col("adhyaya_no").cast("string"), F.when(F.col("adhyaya_no") % 3 == 0, "w").otherwise("")))
    had = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("adhyaya_id")).distinct()
    return _key(select.only_new(c, had))


@query(_CHAPTERS + _KEY + "WHERE (work, book_no) NOT IN (SELECT c_mktsegment[1:1], c_nationkey FROM customer)")
def unclaimed_chapters(spark, sf_dir):
    claimed = table(spark, sf_dir, "customer").select(F.substring("c_mktsegment", 1, 1).alias("work"), F.col("c_nationkey").cast("bigint").alias("book_no"))
    return _key(select.unclaimed(_chapters(spark, sf_dir), claimed, ["work", "book_no"]))


@query(_CHAPTERS + _KEY + "WHERE adhyaya_id IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_quantity = 50)")
def mapped_chapters(spark, sf_dir):
    mapped = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").cast("string").alias("adhyaya_id"))
    return _key(select.mapped_only(_chapters(spark, sf_dir), mapped, ["adhyaya_id"]))


@query("SELECT doc_id FROM documents WHERE length(text) > 200")
def long_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(select.long_enough(F.col("text"))).select("doc_id")


@query("SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag IN ('A', 'R')) AS works FROM lineitem GROUP BY 1")
def valid_routes(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda x: x["l_returnflag"])
    named = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rows.alias("w"))
    return named.select("l_orderkey", F.nullif(F.array_join(qa.routable(F.col("w"), ["A", "R"]), ","), F.lit("")).alias("works"))


@query(_CHAPTERS + "SELECT adhyaya_id, row_number() OVER (PARTITION BY work ORDER BY book_no::VARCHAR, adhyaya_no) AS k FROM c")
def book_order(spark, sf_dir):
    """Books in order as text: 1, 10, 11, 2."""
    w = Window.partitionBy("work").orderBy(F.col("book_no").cast("string"), "adhyaya_no")
    return select.in_book_order(_chapters(spark, sf_dir)).select("adhyaya_id", F.row_number().over(w).cast("bigint").alias("k"))


# ---------------------------------------------------------------- lookups

_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem"


def _verse_key():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def _manifest(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").withColumn("id", _verse_key())
    return parse.manifest(v, ["l_orderkey"], ["l_linenumber", "id"], "id", "l_returnflag")


@query("""
WITH v AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linenumber, l_quantity FROM lineitem),
     d AS (SELECT id, max(l_quantity) AS q, count(*) AS n, min(l_orderkey) AS o, min(l_linenumber) AS l FROM v GROUP BY 1)
SELECT id, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, id) - 1 AS pos, q FROM v JOIN d USING (id)""")
def manifest_verses(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").withColumn("id", _verse_key()).groupBy("id").agg(F.max("l_quantity").alias("q"))
    out = select.verses_of(_manifest(spark, sf_dir).select("l_orderkey", "verse_ids"), v)
    return out.select("id", "l_orderkey", F.col("pos").cast("bigint").alias("pos"), "q")


@query("""
SELECT o_orderkey AS adhyaya_id, o_orderpriority AS review, n AS n_verses FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def card_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("adhyaya_id"), F.col("o_orderpriority").alias("review"))
    return select.with_manifest(c, _manifest(spark, sf_dir).withColumnRenamed("l_orderkey", "adhyaya_id")).select("adhyaya_id", "review", "n_verses")


@query("""
SELECT o_orderkey::VARCHAR AS adhyaya_id, CASE WHEN o_custkey % 12 IN (3, 5) THEN md5(text) END AS english FROM orders LEFT JOIN documents ON doc_id = o_orderkey""")
def chapter_translation(spark, sf_dir):
    english = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("adhyaya_id"), F.col("text").alias("text_en"))
    return select.with_translation(_chapters(spark, sf_dir), english, ["3", "5"]).select("adhyaya_id", F.md5(F.col("text_en").cast("binary")).alias("english"))


# ---------------------------------------------------------------- ids and scalars


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'x-y' AS prefix, (l_suppkey % 9) || '.1' AS book, l_orderkey || CASE WHEN l_partkey % 4 = 0 THEN 'w' ELSE '' END AS chapter, l_linenumber::VARCHAR AS verse, CASE WHEN l_linestatus = 'F' THEN '-r2' ELSE '' END AS suffix FROM lineitem""")
def verse_id_parse(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem")
    book = F.concat((F.col("l_suppkey") % 9).cast("string"), F.lit(".1"))
    chapter = F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_partkey") % 4 == 0, "w").otherwise(""))
    made = records.verse_id(F.lit("x-y"), book, chapter, F.col("l_linenumber"), F.when(F.col("l_linestatus") == "F", "-r2"))
    return v.select("l_orderkey", "l_linenumber", "l_partkey", parse.parse_verse_id(made).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.*")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 7) || '.1' WHEN 1 THEN (p_partkey % 7)::VARCHAR END AS book, p_size AS chapter, (p_partkey % 90)::INT AS verse FROM part""")
def ref_parse(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.concat(F.col("p_size").cast("string"), F.lit("."), F.lpad((k % 90).cast("string"), 3, "0"), F.lit("ab"))
    book = (k % 7).cast("string")
    ref = F.when(k % 3 == 0, F.concat(book, F.lit(".1,"), tail)).when(k % 3 == 1, F.concat(book, F.lit(","), tail)).otherwise(tail)
    return table(spark, sf_dir, "part").select("p_partkey", parse.parse_ref(ref).alias("r")).select("p_partkey", "r.*")


def _roman(n: int) -> str:
    signs = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out = ""
    for value, sign in signs:
        out, n = out + sign * (n // value), n % value
    return out


# Sanskrit chapter titles and their numbers; words in Devanagari, IAST and Telugu script.
_TITLES = [("प्रथमोऽध्यायः", 1), ("द्वितीयोऽध्यायः", 2), ("सप्तमोऽध्यायः", 7), ("एकादशोऽध्यायः", 11), ("अष्टादशोऽध्यायः", 18), ("विंशतितमोऽध्यायः", 20), ("एकविंशोऽध्याय", None), ("पञ्चचत्वारिंशत्तमोऽध्यायः", 45), ("एकाशीतितमोऽध्यायः", 81), ("शततमोऽध्यायः", 100)]
_WORDS = [("कृष्ण", "kṛṣṇa", "కృష్ణ"), ("राम", "rāma", "రామ"), ("अग्निः", "agniḥ", "అగ్నిః"), ("शिवं", "śivaṃ", "శివం"), ("ऐरावत १०८", "airāvata 108", "ఐరావత ౧౦౮"), ("भूमिः।", "bhūmiḥ|", "భూమిః।"), ("धर्मक्षेत्रे", "dharmakṣetre", "ధర్మక్షేత్రే"), ("ज्ञानम्", "jñānam", "జ్ఞానమ్"), ("औषधम्॥", "auṣadham||", "ఔషధమ్॥"), ("ऋषिः", "ṛṣiḥ", "ఋషిః")]


def _pick(k: F.Column, values: list) -> F.Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values)).cast("int"))


def _sql_pick(k: str, values: list) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{k} % {len(values)} + 1]"


_ROMANS = [_roman(n) for n in range(1, 120)]


@query(f"""
SELECT p_partkey, p_partkey % 119 + 1 AS roman, (p_partkey % 1000)::BIGINT AS number, coalesce({_sql_pick('p_partkey', [v for _, v in _TITLES])}::INT, -1) AS ordinal FROM part""")
def scalar_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    digits = F.translate((k % 1000).cast("string"), "0123456789", X.INDIC_DIGITS[20:30])
    return table(spark, sf_dir, "part").select("p_partkey", X.roman(_pick(k, _ROMANS)).cast("bigint").alias("roman"), X.number(F.concat(F.lit(" "), digits)).alias("number"), F.coalesce(X.ordinal(_pick(k, [t for t, _ in _TITLES])), F.lit(-1)).alias("ordinal"))


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', [w[1] for w in _WORDS])} AS iast, {_sql_pick('p_partkey', [w[2] for w in _WORDS])} AS telugu FROM part")
def transliterate(spark, sf_dir):
    word = _pick(F.col("p_partkey"), [w[0] for w in _WORDS])
    return table(spark, sf_dir, "part").select("p_partkey", X.iast(word).alias("iast"), X.telugu(word).alias("telugu"))


@query("""
SELECT doc_id, md5(nfc_normalize(coalesce(text, '')) || 'b, seen' || chr(10) || 'y z') AS wiki, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(t, '') || ' b seen yz', '<[^>]+>', ' ', 'g'), '\\n[ \\t]*[=*#|][^\\n]*', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS prose
FROM (SELECT *, regexp_replace(text, '[=*#|<>\\n]', ' ', 'g') AS t FROM documents)""")
def clean_wiki(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wiki = F.concat(F.lit("{{Header|title={{t}}|x\n}}"), F.coalesce("text", F.lit("")), F.lit("[[a|b]]<ref name=x/>, '''seen'''<br/><!-- n\no -->y<ref>w</ref>&nbsp;z[[File:p.png|of [[q|r]]]][[en:s]]"))
    prose = F.concat(F.lit("{{Header|a}}"), F.coalesce(F.regexp_replace("text", "[=*#|<>\n]", " "), F.lit("")), F.lit("<i> </i>[[a|b]] ''seen'' y<ref>n</ref>z\n== Head ==\n"))
    return d.select("doc_id", F.md5(X.clean_wikitext(wiki).cast("binary")).alias("wiki"), F.md5(X.clean_prose(prose).cast("binary")).alias("prose"))


@query("""
SELECT item_id, md5(text[1:60]) AS cut, url_encode(text[1:60]) AS url, regexp_replace(regexp_replace(text, '\\(\\d+\\)', '', 'g'), ' {2,}', ' ', 'g') AS plain, text[1:20] AS part,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(item_id), '%Y-%m-%dT%H:%M:%S') AS made, regexp_matches(text, '[A-Za-z]') AS latin FROM benchmark""")
def scalar_text(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    noted = F.concat(F.substring("text", 1, 30), F.lit("(12)"), F.substr("text", F.lit(31)))
    grown = F.concat(F.lit('{"answer_te": "'), F.substring("text", 1, 20))
    made = F.timestamp_seconds(F.col("item_id") + 1704067200)
    return b.select("item_id", F.md5(X.truncated(F.col("text"), 60).cast("binary")).alias("cut"), X.url_title(F.substring("text", 1, 60)).alias("url"), X.strip_notes(noted).alias("plain"), X.partial_json(grown, "answer_te").alias("part"), X.stamp(made).alias("made"), X.has_latin(F.col("text")).alias("latin"))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 119 + 1 ELSE -1 END AS book, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS chapter FROM part""")
def title_parse(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, F.concat(F.lit("Work/Book "), _pick(k, _ROMANS), F.lit(": Name/Section "), F.col("p_size").cast("string"))).otherwise(F.lit("Work/Index"))
    found = X.title_numbers(title, r"^Work/Book ([IVXLCDM]+): [^/]+/Section (\d+)$", read=lambda c: F.coalesce(X.roman(c).cast("bigint"), X.number(c)))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("t")).select("p_partkey", F.coalesce("t.book", F.lit(-1)).alias("book"), F.coalesce(F.col("t.chapter").cast("int"), F.lit(-1)).alias("chapter"))


@query("""
SELECT l_orderkey, count(*) AS n, 3500 + 70 * count(*) AS tokens_in, round(0.5 * ((3500 + 70 * count(*)) * 3.0 + 4200 * 15.0) / 1e6, 6) AS usd FROM lineitem GROUP BY 1""")
def plan_costs(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    i, o = X.estimate_tokens(F.col("n"))
    return n.select("l_orderkey", "n", i.alias("tokens_in"), F.round(X.cost({"i": i, "o": o}, {"i": F.lit(3.0), "o": F.lit(15.0)}, batch=True), 6).alias("usd"))


# ---------------------------------------------------------------- parsers


@query("""
WITH l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
SELECT doc_id, k - 1 AS pos, 'T_' || k || '.1' AS ref, md5(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) AS body FROM l WHERE k < n""")
def ref_split(spark, sf_dir):
    """Lines whose ends are numbered references: // T_1.1 // for the first, and so on."""
    lines = F.split(F.replace("text", F.lit("/"), F.lit("∕")), "\n", -1)
    marked = F.array_join(F.transform(lines, lambda x, i: F.concat(x, F.when(i < F.size(lines) - 1, F.concat(F.lit("//T_"), (i + 1).cast("string"), F.lit(".1//"))).otherwise(""))), "")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", marked.alias("t"))
    out = parse.split_refs(d, "doc_id", "t", r"//(T_\d+\.\d+)//")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "ref", F.md5(F.replace("text", F.lit("∕"), F.lit("/")).cast("binary")).alias("body"))


@query("""
SELECT l_suppkey, l_orderkey AS chapter, l_linenumber AS n, string_agg('line ' || l_partkey, ' ' ORDER BY l_partkey, l_extendedprice) AS text, first(said ORDER BY l_partkey, l_extendedprice) AS speaker
FROM (SELECT *, last_value(CASE WHEN l_returnflag = 'R' THEN 'Supplier of ' || l_orderkey END IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS said FROM lineitem)
GROUP BY 1, 2, 3""")
def table_split(spark, sf_dir):
    """Pages of table rows, one a supplier: a speaker's row before each returned line."""
    w = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    cell = lambda body, half: F.concat(F.lit("<tr><td>"), body, F.lit(" ॥<td>7-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(half + "</tr>"))
    row = F.concat(F.when(F.col("l_returnflag") == "R", cell(F.concat(F.lit("Supplier of "), F.col("l_orderkey").cast("string")), "x")).otherwise(""), cell(F.concat(F.lit("line "), F.col("l_partkey").cast("string")), "a"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*w, row.alias("r")))), lambda x: x["r"]), "\n").alias("html"))
    return parse.split_table(pages, "l_suppkey", "html").select("l_suppkey", "chapter", "n", "text", "speaker")


@query("""
WITH p AS (SELECT c_nationkey AS chapter, c_custkey AS page, trunc(c_acctbal)::BIGINT % 40 AS n FROM customer WHERE c_acctbal > 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY n DESC, page) AS k FROM p WHERE n > 0)
SELECT chapter, page, n AS n_verses FROM r WHERE k = 1""")
def chapter_split(spark, sf_dir):
    """Pages of two lines of verses without a chapter in their marks, below the heading that has it."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("page"), "c_nationkey", (F.col("c_acctbal").cast("bigint") % 40).alias("n"))
    verse = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("a line ॥ "), i.cast("string"), F.lit(" ॥")))
    text = F.concat(F.col("c_nationkey").cast("string"), F.lit("(9)\n"), F.when(F.col("n") > 0, F.array_join(verse, "\n")).otherwise(""))
    out = parse.split_chapters(c.select("page", text.alias("t")), "page", "t", F.lit(None).cast("bigint"), r"^\s*(\d+)\(\d+\)\s*$")
    return out.select(F.col("chapter").cast("int").alias("chapter"), "page", "n_verses")


@query("""
SELECT source, lang, arg_max(doc_id, (length(coalesce(text, '')), -doc_id)) AS doc_id FROM documents GROUP BY 1, 2""")
def longest_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return parse.longest(d, ["source", "lang"], "text", "doc_id").select("source", "lang", "doc_id")


@query("""
SELECT source, arg_min(doc_id, (doc_id % 3, -n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1""")
def best_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).alias("rank"), "n_chars", "doc_id")
    return parse.best_page(d, ["source"], "rank", "n_chars", "doc_id").select("source", "doc_id")


@query("""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
     h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-Z][a-z]+ [a-z]+ [a-z]+\\.') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM l WHERE trim(line, E' \\t\\r') <> '')
SELECT doc_id, pos, md5(h) AS heading FROM h WHERE NOT regexp_matches(line, '^[A-Z][a-z]+ [a-z]+ [a-z]+\\.')""")
def heading_carry(spark, sf_dir):
    lines = parse.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = parse.own_headings(lines, ["doc_id"], r"^[A-Z][a-z]+ [a-z]+ [a-z]+\.")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("heading").cast("binary")).alias("heading"))


@query("""
WITH RECURSIVE s AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
 r AS (SELECT *, (l_linenumber = 1)::INT AS last, l_linenumber = 1 AS ok FROM s WHERE k = 1
       UNION ALL
       SELECT s.*, CASE WHEN s.l_linenumber = r.last + 1 THEN r.last + 1 ELSE r.last END, s.l_linenumber = r.last + 1 FROM r JOIN s ON s.l_suppkey = r.l_suppkey AND s.k = r.k + 1)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r WHERE ok""")
def monotone_headings(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sequence.accepted_headings(v, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_linenumber").drop("l_extendedprice")


@query("""
WITH a AS (SELECT l_suppkey, l_linenumber AS n, lag(l_linenumber) OVER w AS prev, lead(l_linenumber) OVER w AS nxt, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
     b AS (SELECT *, sum(CASE WHEN n <= 3 AND prev >= 10 AND nxt <= n + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY k) AS run FROM a)
SELECT l_suppkey, count(*) AS n FROM b WHERE run = 0 GROUP BY 1""")
def run_selection(spark, sf_dir):
    """Line numbers end at 7, so that no restart is one and the first run is all."""
    out = sequence.keep_run(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_linenumber")
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity::INT // 10 AS target, row_number() OVER w AS k, lag(l_quantity::INT // 10) OVER w AS prev FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
     i AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM target OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY k) AS isl FROM c)
SELECT l_suppkey, isl::BIGINT AS island, min(target) AS target, string_agg(l_partkey::VARCHAR, ' ' ORDER BY k) AS parts FROM i GROUP BY 1, 2""")
def same_target_merge(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.floor(F.round("l_quantity") / 10).cast("int").alias("target"), F.col("l_partkey").cast("string").alias("parts"))
    return sequence.merge_islands(v, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["target"], "parts").select("l_suppkey", "island", "target", "parts")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_custkey || CASE WHEN k = 1 THEN '' WHEN k = 2 THEN '-w' ELSE '-w' || (k - 1) END AS id, CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN '-w' ELSE '-w' || (k - 1) END AS suffix FROM r""")
def ownership_parking(spark, sf_dir):
    from .build import parked

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("id"), (F.col("o_orderstatus") == "F").alias("mapped"), F.col("o_orderkey").alias("order"), F.lit(None).cast("string").alias("suffix"))
    return parked(o).select("o_orderkey", "id", "suffix")


@query("""
WITH m AS (SELECT o_orderkey, o_custkey % 50 AS to_ FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 400 < 200 ), u AS (SELECT min(o_orderkey) AS o_orderkey, to_ FROM m GROUP BY to_)
SELECT o.o_orderkey, CASE WHEN u.to_ IS NOT NULL THEN u.to_::VARCHAR WHEN o.o_orderkey IN (SELECT to_ FROM u) THEN o.o_orderkey || 'w' ELSE o.o_orderkey::VARCHAR END AS chapter FROM orders o LEFT JOIN u USING (o_orderkey)""")
def chapter_parking(spark, sf_dir):
    from .build import renumbered

    o = table(spark, sf_dir, "orders")
    to = o.where("o_orderkey % 4 = 0 and o_orderkey % 400 < 200").groupBy((F.col("o_custkey") % 50).alias("old_ch")).agg(F.min("o_orderkey").alias("new_ch")).select(F.lit("1").alias("new_book"), "new_ch", F.lit("1").alias("old_book"), "old_ch")
    pages = o.select(F.lit("1").alias("book"), F.col("o_orderkey").alias("chapter"), "o_orderkey")
    return renumbered(pages, to).select("o_orderkey", "chapter")


# ---------------------------------------------------------------- records

_LONG = records.Work("bhp", "Work", "వర్క్", "స్కంధము")
_DOTTED = records.Work("vip", "Other", "ఇతర", dotted=True)


def _verses(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem")
    return v.select((F.col("l_suppkey") % 9).alias("book"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("-r"), F.col("l_partkey").cast("string"))).alias("suffix"), _pick(F.col("l_partkey"), [w[0] for w in _WORDS]).alias("text"), F.when(F.col("l_returnflag") == "R", F.lit("राम")).alias("speaker"), F.col("l_shipdate").cast("string").alias("url"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("order"))


_RECORD = f"""
WITH v AS (SELECT l_suppkey % 9 AS b, l_orderkey AS c, l_linenumber AS n, CASE WHEN l_linestatus = 'F' THEN '-r' || l_partkey ELSE '' END AS s, {_sql_pick('l_partkey', [w[1] for w in _WORDS])} AS sloka_iast, {_sql_pick('l_partkey', [w[2] for w in _WORDS])} AS sloka_te_script,
                  CASE WHEN l_returnflag = 'R' THEN 'rāma' END AS speaker_iast, l_linenumber, l_partkey, l_extendedprice FROM lineitem)
"""


@query(_RECORD + """
SELECT 'bhp-' || b || '-' || c || '-' || n || s AS id, 'వర్క్, స్కంధము ' || b || ', అధ్యాయము ' || c || ', శ్లోకము ' || n || s AS citation_te, 'Work ' || b || '.' || c || '.' || n || s AS citation_en, 'స్కంధము ' || b AS book_te, sloka_iast, sloka_te_script, speaker_iast, 'bhp_' || b || '.' || c || '.' || n || s AS source_ref, 24 AS n_columns FROM v""")
def verse_records_long(spark, sf_dir):
    out = records.verse_records(_verses(spark, sf_dir).drop("order"), _LONG)
    return out.select("id", "citation_te", "citation_en", "book_te", "sloka_iast", "sloka_te_script", "speaker_iast", "source_ref", F.lit(len(out.columns)).alias("n_columns"))


@query(_RECORD + "SELECT 'vip-' || b || '-' || c || '-' || n || s AS id, 'ఇతర ' || b || '.' || c || '.' || n || s AS citation_te, 'Other ' || b || '.' || c || '.' || n || s AS citation_en, nullif(s, '') AS verse_suffix FROM v")
def verse_records_dotted(spark, sf_dir):
    return records.verse_records(_verses(spark, sf_dir), _DOTTED).select("id", "citation_te", "citation_en", "verse_suffix")


@query(_RECORD + """
SELECT 'bhp-' || b || '-' || c AS adhyaya_id, count(*)::INT AS n_verses, 'వర్క్, స్కంధము ' || b || ', అధ్యాయము ' || c AS citation_te, string_agg('bhp-' || b || '-' || c || '-' || n || s, ' ' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS ids, coalesce(max(speaker_iast), '') AS speakers FROM v GROUP BY b, c""")
def record_manifests(spark, sf_dir):
    out = records.manifests(records.verse_records(_verses(spark, sf_dir), _LONG), _LONG, ["order"])
    return out.select("adhyaya_id", "n_verses", "citation_te", F.array_join("verse_ids", " ").alias("ids"), F.array_join("speakers", " ").alias("speakers"))


def _cards(spark, sf_dir) -> DataFrame:
    ls = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    at = lambda k: F.get(ls, F.lit(k))
    none = F.array().cast("array<string>")
    card = F.struct(at(0).alias("title_te"), at(1).alias("summary_te"), F.lit("m").alias("moral_te"), none.alias("key_events_te"), F.slice(ls, 3, 3).alias("questions_te"), F.array(F.col("source")).alias("themes_te"), F.array(F.lit("v"), F.lit("w")).alias("vratas_tithis_te"), F.transform(F.array(F.coalesce("lang", F.lit("x"))), lambda x: F.struct(x.alias("name_te"))).alias("entities"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", card.alias("card"))


_CARD = """
WITH c AS (SELECT doc_id, source, coalesce(lang, 'x') AS lang, coalesce(ls[1], '') AS title, coalesce(ls[2], '') AS summary, array_to_string(ls[3:5], ' ') AS qs, ls[3:5] AS questions FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
"""


@query(_CARD + """SELECT doc_id, md5(regexp_replace(nfc_normalize(title || ' ' || summary || ' m  ' || qs || ' ' || source || ' v w ' || lang), '^\\s+|\\s+$', '', 'g')) AS serving, md5(title || ' ' || summary || ' m  ' || qs || ' ' || source || ' ' || lang) AS evaluation,
 md5(regexp_replace(nfc_normalize(title || ' ' || summary || ' ' || qs), '^\\s+|\\s+$', '', 'g')) AS rerank FROM c""")
def card_texts(spark, sf_dir):
    c, digest = F.col("card"), lambda x: F.md5(x.cast("binary"))
    return _cards(spark, sf_dir).select("doc_id", digest(records.card_text(c)).alias("serving"), digest(records.card_text(c, evaluation=True)).alias("evaluation"), digest(records.rerank_text(c)).alias("rerank"))


@query(_CARD + """SELECT doc_id, unit, md5(t) AS text_md5 FROM (SELECT doc_id, 'title_te' AS unit, title AS t FROM c UNION ALL SELECT doc_id, 'summary_te', summary FROM c UNION ALL SELECT doc_id, 'question', unnest(questions) FROM c) WHERE regexp_replace(t, '\\s+', '', 'g') <> ''""")
def card_units(spark, sf_dir):
    out = retrieve.units(_cards(spark, sf_dir).select("doc_id", "card.*"), ["title_te", "summary_te"], "questions_te")
    return out.select("doc_id", "unit", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _selected(spark, sf_dir) -> DataFrame:
    """Customers ask; their orders are the chapters found, lines of returned goods the verses selected."""
    o = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    o = qa.to_read(o.select(F.col("o_custkey").alias("query_id"), "o_orderkey", "rank", F.col("o_orderpriority").alias("title_te")))
    w = Window.partitionBy("l_orderkey")
    v = table(spark, sf_dir, "lineitem").withColumn("n_verses", F.count(F.lit(1)).over(w)).withColumn("pos", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_extendedprice")))
    v = v.where("l_returnflag != 'N'")
    return o.join(v, F.col("o_orderkey") == F.col("l_orderkey")).select("query_id", "rank", "pos", "n_verses", "title_te", _verse_key().alias("id"), F.col("o_orderkey").cast("string").alias("adhyaya_id"), F.lit("w").alias("work"), F.concat(F.lit("c "), F.col("l_orderkey").cast("string")).alias("citation_te"), F.concat(F.lit("t "), F.col("l_partkey").cast("string")).alias("sloka_te_script"), F.lit("i").alias("sloka_iast"), F.when(F.col("l_returnflag") == "R", "S").alias("speaker_te"), F.lit("u").alias("source_url"))


_SELECTED = """
WITH o AS (SELECT o_custkey AS query_id, o_orderkey, o_orderpriority AS title_te, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
     l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n_verses, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem),
     v AS (SELECT query_id, rank, pos, n_verses, title_te, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, o_orderkey::VARCHAR AS adhyaya_id, 'c ' || l_orderkey AS citation_te, 't ' || l_partkey AS sloka_te, CASE WHEN l_returnflag = 'R' THEN 'S' END AS speaker_te
           FROM o JOIN l ON l_orderkey = o_orderkey WHERE rank <= 3 AND l_returnflag <> 'N')
"""


@query(_SELECTED + "SELECT query_id, id, adhyaya_id, citation_te, sloka_te, speaker_te, title_te AS chapter_title_te, count(*) OVER (PARTITION BY query_id, adhyaya_id) < n_verses AS chapter_truncated FROM v")
def passage_projection(spark, sf_dir):
    return records.passages(_selected(spark, sf_dir)).select("query_id", "id", "adhyaya_id", "citation_te", "sloka_te", "speaker_te", "chapter_title_te", "chapter_truncated")


@query(_SELECTED + """, b AS (SELECT query_id, string_agg(CASE WHEN p IS DISTINCT FROM adhyaya_id THEN '## ' || adhyaya_id || chr(10) ELSE '' END || '[' || id || ']' || coalesce(' (' || speaker_te || ')', '') || chr(10) || sloka_te, chr(10) ORDER BY rank, pos) AS t
 FROM (SELECT *, lag(adhyaya_id) OVER (PARTITION BY query_id ORDER BY rank, pos) AS p FROM v) GROUP BY 1) SELECT query_id, md5(t) AS prompt FROM b""")
def prompt_render(spark, sf_dir):
    p = records.passages(_selected(spark, sf_dir)).select("query_id", (F.col("rank") * 1000 + F.col("pos")).alias("rank"), F.col("adhyaya_id").alias("chapter"), F.col("id").alias("verse_id"), F.col("speaker_te").alias("speaker"), F.col("sloka_te").alias("text"))
    return qa.prompt(p).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query(_SELECTED + """, c AS (SELECT query_id, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY rank) AS chapters FROM o WHERE rank <= 4 GROUP BY 1), p AS (SELECT query_id, string_agg(id, ' ' ORDER BY rank, pos) AS passages FROM v GROUP BY 1)
SELECT c_custkey AS query_id, trim(c_name) AS query_te, coalesce(chapters, '') AS chapters, coalesce(passages, '') AS passages FROM customer LEFT JOIN c ON c.query_id = c_custkey LEFT JOIN p ON p.query_id = c_custkey""")
def search_response(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where(F.col("rank") <= retrieve.clamped(0))
    o = o.select(F.col("o_custkey").alias("query_id"), "rank", F.col("o_orderkey").cast("string").alias("adhyaya_id"), F.col("o_orderpriority").alias("title_te"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("text"))
    out = records.search_response(asked, o, records.passages(_selected(spark, sf_dir)), ["adhyaya_id", "title_te"], ["id", "adhyaya_id", "sloka_te", "speaker_te"])
    ids = lambda c, k: F.array_join(F.transform(c, lambda x: x[k]), " ").alias(c)
    return out.select("query_id", "query_te", ids("chapters", "adhyaya_id"), ids("passages", "id"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
     j AS (SELECT o_custkey, '[' || string_agg('{"adhyaya_id":"' || o_orderkey || '","work":"' || o_orderstatus || '","score":' || rank || '}', ',' ORDER BY rank) || ']' AS ranked FROM r WHERE rank <= 20 GROUP BY 1)
SELECT c_custkey AS query_id, '{"question_norm":"' || c_name || '","route":"story","works":["a"],"query":"' || c_name || '","ranked":' || coalesce(ranked, '[]') || '}' AS json FROM customer LEFT JOIN j ON o_custkey = c_custkey""")
def ranked_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("rank <= 20")
    o = o.select(F.col("o_custkey").alias("query_id"), "rank", F.col("o_orderkey").cast("string").alias("adhyaya_id"), F.col("o_orderstatus").alias("work"), F.col("rank").alias("score"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("question_norm"), F.lit("story").alias("route"), F.array(F.lit("a")).alias("works"), F.col("c_name").alias("query"))
    return records.ranked_json(asked, o, ["adhyaya_id", "work", "score"])


@query(_RECORD + """
SELECT '{"adhyaya_id":"bhp-' || b || '-' || c || '","work":"Work","work_te":"వర్క్","book_no":"' || b || '","adhyaya_no":"' || c || '","n_verses":' || count(*) || ',"citation_te":"వర్క్, స్కంధము ' || b || ', అధ్యాయము ' || c || '"}' || chr(10) || 'speakers: ' || coalesce(max(speaker_iast), 'none marked') AS header FROM v GROUP BY b, c""")
def chapter_header(spark, sf_dir):
    out = records.manifests(records.verse_records(_verses(spark, sf_dir), _LONG), _LONG, ["order"])
    return records.header(out).select("header")


@query(_SELECTED + """, c AS (SELECT query_id, string_agg('**' || citation_te || '**  ' || chr(10) || sloka_te || '  ' || chr(10) || '_m_', chr(10) || chr(10) ORDER BY rank, pos) AS t, count(*) AS n FROM v GROUP BY 1),
 h AS (SELECT query_id, string_agg('- ' || o_orderkey || ' — ' || title_te, chr(10) ORDER BY rank) AS chapters FROM o GROUP BY 1)
SELECT query_id, 'a' AS answer, md5(t || chr(10) || chr(10) || '---' || chr(10) || 'route: story · works: all · citations verified ' || n || ', dropped 0') AS citations, md5(chapters) AS chapters FROM c JOIN h USING (query_id)""")
def ui_render(spark, sf_dir):
    cites = F.array_sort(F.collect_list(F.struct("rank", "pos", "citation_te", F.col("sloka_te_script").alias("sloka_te"), F.lit("m").alias("tatparyam_te"))))
    c = _selected(spark, sf_dir).groupBy("query_id").agg(cites.alias("citations"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("citation_te"), F.col("o_orderpriority").alias("title_te")))).alias("cards"))
    out = records.rendered(c.join(o, "query_id").select("*", F.lit("a").alias("answer"), F.lit("story").alias("route"), F.array().cast("array<string>").alias("works"), F.size("citations").alias("n_ok"), F.lit(0).alias("n_failed")))
    return out.select("query_id", "answer", F.md5(F.col("citations").cast("binary")).alias("citations"), F.md5(F.col("chapters").cast("binary")).alias("chapters"))


# ---------------------------------------------------------------- alignment


@query("""
WITH p AS (SELECT p_partkey, p_brand AS book, p_size AS ch, p_partkey % 2 AS side, regexp_replace(lower(p_name || p_type), '[^a-z]', '', 'g') AS s FROM part),
     g AS (SELECT book, ch, side, p_partkey, list_distinct(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3))) AS g FROM p),
     n AS (SELECT book, ch, count(*) AS n FROM g WHERE side = 1 GROUP BY 1, 2),
     m AS (SELECT DISTINCT a.book, a.ch AS new_ch, b.ch AS old_ch, a.p_partkey FROM g a JOIN g b ON a.book = b.book AND abs(a.ch - b.ch) <= 10 AND a.side = 1 AND b.side = 0 AND len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.22 - 1e-12),
     s AS (SELECT m.book, new_ch, old_ch, count(*) / any_value(n) AS score FROM m JOIN n ON n.book = m.book AND n.ch = m.new_ch GROUP BY 1, 2, 3),
     b AS (SELECT *, row_number() OVER (PARTITION BY book, new_ch ORDER BY score DESC, old_ch) AS k FROM s),
     h AS (SELECT *, row_number() OVER (PARTITION BY book, old_ch ORDER BY score DESC, new_ch) AS h FROM b WHERE k = 1 AND score >= 0.5)
SELECT book, new_ch, old_ch, round(score, 6) AS score FROM h WHERE h = 1""")
def chapter_alignment(spark, sf_dir):
    """Brands are works, sizes chapters; odd parts the new edition: what is claimed in the band."""
    return _aligned(spark, sf_dir).where("pass = 'band'").select(F.col("work").alias("book"), "new_ch", "old_ch", F.round("score", 6).alias("score"))


def _aligned(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    v = p.select(F.col("p_brand").alias("work"), F.lit("1").alias("book"), F.col("p_size").alias("ch"), F.col("p_partkey").alias("vid"), X.gram_set(F.concat("p_name", "p_type"), 3, "a-z").alias("grams"))
    return align.chapter_map(v.where("vid % 2 = 1"), v.where("vid % 2 = 0"))


@query()
def chapter_alignment_leftovers(spark, sf_dir):
    """With the pass over what the band left; tested against brute force."""
    return _aligned(spark, sf_dir)


def _editions(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).cast("string").alias("work"), F.concat(F.lit("1-"), F.col("conv_id").cast("string")).alias("chapter"), F.col("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    pos = F.row_number().over(Window.partitionBy("chapter").orderBy("turn", "role", "text")) - 1
    side = lambda d: d.select("work", "chapter", pos.cast("bigint").alias("pos"), F.concat_ws("/", "chapter", F.col("turn").cast("string"), "role").alias("vid"), "text")
    return side(t.where("turn % 2 = 0")), side(t.where("turn % 2 = 1"))


@query()
def verse_alignment(spark, sf_dir):
    """Even turns against odd ones, with spans and the pass over the work; tested against brute force."""
    return align.verse_map(*_editions(spark, sf_dir))


@query("""
WITH e AS (SELECT conv_id, count(*) FILTER (WHERE turn % 2 = 0) AS a, count(*) FILTER (WHERE turn % 2 = 1) AS b FROM conversations GROUP BY 1)
SELECT 'new verses in chapters that the old edition lacks' AS counter, coalesce(sum(a) FILTER (WHERE b = 0), 0)::BIGINT AS n FROM e
UNION ALL SELECT 'new verses matched and unmatched', coalesce(sum(a) FILTER (WHERE b > 0), 0)::BIGINT FROM e
UNION ALL SELECT 'old verses with and without a new one', coalesce(sum(b) FILTER (WHERE a > 0), 0)::BIGINT FROM e""")
def verse_counters(spark, sf_dir):
    """The counters that must add up, whatever matched."""
    new, old = _editions(spark, sf_dir)
    out = align.verse_counters(new, old, stored(align.verse_map(new, old), "verses"))
    c = F.col("counter")
    name = F.when(c.isin("new verses matched", "new verses unmatched"), "new verses matched and unmatched").when(c.isin("old verses matched", "old verses without a new one"), "old verses with and without a new one").when(c == "new verses in chapters that the old edition lacks", c)
    return out.select(name.alias("counter"), "n").where("counter is not null").groupBy("counter").agg(F.sum("n").alias("n"))


@query("""
WITH a AS (SELECT l_orderkey AS k, count(*) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT k, x, y, abs(x - y) AS gap FROM a JOIN b USING (k) WHERE abs(x - y) > 2 ORDER BY gap DESC, k LIMIT 12""")
def reconcile_furthest(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return align.furthest(align.reconciled(n.where("l_linestatus = 'F'"), n.where("l_linestatus = 'O'"), "k"), "k")


@query("""
WITH v AS (SELECT o_orderkey AS chapter, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT chapter, count(*) FILTER (WHERE hit) / count(*) AS share FROM v GROUP BY 1 HAVING count(*) FILTER (WHERE hit) > 0""")
def similarity_fraction(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("vid"), F.col("l_orderkey").alias("chapter"), "l_returnflag")
    return align.matched_share(v.select("vid", "chapter"), v.where("l_returnflag = 'R'").select("vid", F.lit(1).alias("other"))).select("chapter", "share")


@query()
def span_place(spark, sf_dir):
    """The benchmark passage inside the document of its own number, cut out of its middle; tested against brute force."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chapter"), F.lit(0).cast("bigint").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    third = (F.length("text") / 3).cast("int")
    return align.place_spans(b, b.select("chapter", F.col("i").alias("j"), F.substr("text", third + 1, third).alias("text")))


# ---------------------------------------------------------------- generation and evaluation


@query("""
WITH j AS (SELECT item_id, text, (text IS NULL OR text = '') AS refused FROM benchmark), w AS (SELECT item_id, refused, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM j)
SELECT count(*) AS n, sum(refused::INT)::BIGINT AS refusals, avg(CASE WHEN NOT refused THEN 1.0 END)::DOUBLE AS faithfulness, avg(CASE WHEN refused THEN 1 ELSE 5 END)::DOUBLE AS correctness FROM w""")
def judge_answers(spark, sf_dir):
    """Every passage judged against itself by the offline judge: all of it is found."""
    text = F.coalesce("text", F.lit(""))
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("question"), text.alias("answer"), text.alias("evidence"), text.alias("reference"), (text == "").alias("refused"))
    got = evaluate.judge(a, evaluate.OfflineJudge()).select("*", F.lit(3).alias("n_cit"), F.lit(1).alias("n_dropped"), F.array(F.lit("a")).alias("gold"), F.array(F.lit("a")).alias("top3"))
    return evaluate.judged(got).select("n", "refusals", "faithfulness", "correctness")


@query("""
SELECT count(*) AS n, sum((l_returnflag = 'N')::INT)::BIGINT AS refusals, avg(CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 END) AS faithfulness, avg(CASE WHEN l_returnflag <> 'N' THEN (l_discount * 10 >= 0.9)::INT END) AS faithful_share,
 avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE l_linenumber END) AS correctness, avg((CASE WHEN l_returnflag = 'N' THEN 1 ELSE l_linenumber END >= 4)::INT) AS correct_share FROM lineitem""")
def generation_stats(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "N").alias("refused"), F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10).alias("faithfulness"), F.col("l_linenumber").alias("correctness"), F.lit(1).alias("n_cit"), F.lit(0).alias("n_dropped"), F.array(F.lit(1)).alias("gold"), F.array(F.lit(1)).alias("top3"))
    return evaluate.judged(v).select("n", "refusals", "faithfulness", "faithful_share", "correctness", "correct_share")


@query("""
SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL AND quality = 1) AS ok, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND quality = 0) AS fail, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)""")
def validation_summary(spark, sf_dir):
    c = table(spark, sf_dir, "labels").select("doc_id", cards.errors(("quality", F.col("quality") == 0)).alias("errors"))
    return cards.validation_summary(c, table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
SELECT p_partkey, array_to_string(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '')[1:3], ' ') AS title, len(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> ''))::BIGINT AS words, len(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> ''))::BIGINT AS input_tokens FROM part""")
def card_generation(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("request_id"), F.concat_ws(" ", "p_name", "p_type").alias("prompt"))
    got = cards.generate(asked, cards.OfflineCards(), (3.0, 15.0))
    body = F.from_json("body", "title_te string, n_words bigint")
    return got.select(F.col("request_id").cast("bigint").alias("p_partkey"), body["title_te"].alias("title"), body["n_words"].alias("words"), "input_tokens")


@query("""
WITH r AS (SELECT o_orderstatus AS work, o_orderkey::VARCHAR || '.1' AS chapter, row_number() OVER (ORDER BY o_orderstatus, o_orderkey::VARCHAR || '.1') AS k FROM orders)
SELECT replace(work || '__' || chapter, '.', '_') AS request_id, (k - 1) // 500 AS batch, 'waiting' AS status FROM r WHERE NOT (work = 'O' AND chapter < '2')""")
def batch_submit(spark, sf_dir):
    """Requests in chunks of 500, without those that wait already; a failed one goes again."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("work"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".1")).alias("chapter"))
    waits = o.where("work = 'O' and chapter < '2'").select(X.request_id(F.col("work"), F.col("chapter")).alias("request_id"), F.lit("waiting").alias("status"))
    failed = o.where("work = 'F'").select(X.request_id(F.col("work"), F.col("chapter")).alias("request_id"), F.lit("failed").alias("status"))
    return cards.submit(o, waits.unionByName(failed), "m", ["work", "chapter"]).select("request_id", "batch", "status")


@query("""
SELECT o_orderkey::VARCHAR AS request_id, CASE WHEN o_orderkey % 4 = 3 THEN 'waiting' WHEN o_orderkey % 4 = 2 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'unparsable' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS title FROM orders""")
def batch_collect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ledger = o.select(F.col("o_orderkey").cast("string").alias("request_id"), F.lit("waiting").alias("status"))
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("title_te")))).when(k == 1, F.lit("{not json"))
    results = o.where(k != 3).select(F.col("o_orderkey").cast("string").alias("request_id"), body.alias("body"), F.when(k == 2, "refused").alias("error"))
    got = stored(cards.collect(results, ledger, "title_te string"), "collected")
    return cards.settled(ledger, got).join(got.select("request_id", F.when(F.col("status") == "ok", F.col("card.title_te")).alias("title")), "request_id")


# ---------------------------------------------------------------- sources, sinks, streams


def _folder(spark) -> str:
    """A folder for one query's files, beside the stored tables."""
    return f"{spark.conf.get('spark.checkpoint.dir', 'file:///tmp').rstrip('/')}/corpusloom-files-{uuid.uuid4().hex}"


_DOCS = "SELECT doc_id, md5(text) AS text_md5, lang FROM documents"


def _digested(df):
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@query(_DOCS)
def jsonl_scan(spark, sf_dir):
    path, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    n = sinks.jsonl(d, path)
    return _digested(readers.jsonl(spark, path, d.schema)).where(F.lit(n) >= 0)


@query(_DOCS)
def sized_parts(spark, sf_dir):
    """Written in parts of bounded bytes, read back as one table."""
    path, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sinks.sized(d, path, 1 << 20)
    return _digested(readers.jsonl(spark, path, d.schema))


@query("SELECT 'w' || (doc_id % 3) AS work, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def json_files_scan(spark, sf_dir):
    """One JSON document a file, in a folder for each work."""
    root, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    for k in range(3):
        d.where(F.col("doc_id") % 3 == k).groupBy().agg(F.collect_list(F.struct("doc_id", "lang")).alias("rows")).write.json(f"{root}/w{k}")
    found = readers.json_files(spark, root, "rows array<struct<doc_id:bigint,lang:string>>")
    return found.select(F.col("_work").alias("work"), F.explode("rows").alias("r")).groupBy("work").agg(F.count(F.lit(1)).alias("n"), F.sum("r.doc_id").alias("ids"))


@query("SELECT doc_id, source AS title, md5(coalesce(text, '')) AS body_md5 FROM documents")
def page_scan(spark, sf_dir):
    """Pages as files of a JSON header line and the text; each row is a file's content."""
    path, d = _folder(spark), table(spark, sf_dir, "documents")
    head = F.to_json(F.struct("doc_id", F.col("source").alias("title")))
    page = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")))
    d.select(page.alias("value")).write.option("lineSep", "\x1e").text(path)
    rows = spark.read.option("lineSep", "\x1e").text(path)
    return readers.with_header(rows, "value", "doc_id bigint, title string").select("doc_id", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT doc_id, md5(coalesce(text, '') || '# Text again') AS after_md5, md5(coalesce(text, '')) AS between_md5 FROM documents")
def marked_scan(spark, sf_dir):
    """What follows the first marker, and what lies between two."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    a = readers.after(F.concat(F.lit("head # Text"), text, F.lit("# Text again")), "# Text")
    b = readers.between(F.concat(F.lit("﻿x\r\n*** START OF BOOK\n"), text, F.lit("*** END OF BOOK")))
    return d.select("doc_id", F.md5(a.cast("binary")).alias("after_md5"), F.md5(b.cast("binary")).alias("between_md5"))


@query("SELECT o_orderkey AS key, o_orderpriority AS to_, o_totalprice AS score FROM orders")
def map_round_trip(spark, sf_dir):
    """A map written as one JSON object and read as a table."""
    path = _folder(spark)
    sinks.mapping(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("to"), F.col("o_totalprice").alias("score")), path, "o_orderkey")
    out = readers.json_map(spark, path, "struct<to:string,score:double>")
    return out.select(F.nullif("key", F.lit("null")).cast("bigint").alias("key"), F.col("value.to").alias("to_"), "value.score")


@query("SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag = 'N' GROUP BY 1, 2")
def keyed_write(spark, sf_dir):
    """Partitions that are written again replace their own key only."""
    path, v = _folder(spark), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    sinks.keyed(v, path, "l_linestatus")
    sinks.keyed(v.where("l_linestatus = 'O' and l_returnflag = 'N'"), path, "l_linestatus")
    return spark.read.parquet(path).groupBy("l_orderkey", "l_linestatus").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem")
def append_cache(spark, sf_dir):
    """Keys that come again add nothing."""
    path, v = _folder(spark), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    sinks.append_new(v.where("l_returnflag != 'N'"), path, ["l_orderkey", "l_returnflag"])
    sinks.append_new(v, path, ["l_orderkey", "l_returnflag"])
    return spark.read.parquet(path)


@query("SELECT o_orderkey::VARCHAR AS request_id, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'waiting' END AS status FROM orders")
def ledger_save(spark, sf_dir):
    """A ledger replaced by its settled self."""
    path, o = _folder(spark), table(spark, sf_dir, "orders")
    ledger = sinks.replaced(o.select(F.col("o_orderkey").cast("string").alias("request_id"), F.lit("waiting").alias("status")), path)
    done = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("request_id"), F.lit("ok").alias("status"))
    return sinks.replaced(cards.settled(ledger, done), path)


@query("SELECT true AS fresh, false AS changed, false AS absent, (SELECT count(*) FROM embeddings) AS units")
def index_write(spark, sf_dir):
    """An index is current for its own documents alone."""
    path, d = _folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("work"), F.lit("title").alias("unit"), "embedding")
    sinks.index(path, vec, d, retrieve.lexical_statistics(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")))
    said = [sinks.current(path, d), sinks.current(path, d.where("doc_id != 1")), sinks.current(path + "-none", d)]
    return readers.vectors(spark, f"{path}/units").agg(*[F.lit(x).alias(n) for x, n in zip(said, ("fresh", "changed", "absent"), strict=True)], F.count(F.lit(1)).alias("units"))


@query("SELECT DISTINCT substr(sha1(nfc_normalize(o_orderpriority)), 1, 16) AS slug, o_orderpriority AS title, 'https://x/' || url_encode(replace(o_orderpriority, ' ', '_')) AS url, 'text of ' || o_orderpriority AS body FROM orders")
def page_cache(spark, sf_dir):
    """Pages fetched once, though asked for twice."""
    path, o = _folder(spark), table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("title"))
    readers.fetch_pages(o.where("title < '3'"), path, "text of {}".format, "https://x/")
    return readers.fetch_pages(o, path, "text of {}".format, "https://x/")


@query("SELECT count(*) AS files, true AS whole FROM (SELECT 1)")
def file_snapshot(spark, sf_dir):
    """A manifest of what a run read: each file with its digest."""
    path, to = _folder(spark), _folder(spark)
    table(spark, sf_dir, "region").coalesce(1).write.option("compression", "none").parquet(path)
    got = readers.snapshot(spark, path, to).where("path like '%.parquet'")
    return got.agg(F.count(F.lit(1)).alias("files"), F.min(F.length("sha256") == 64).alias("whole"))


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed(spark, sf_dir):
    out = incremental.events_by_window(table(spark, sf_dir, "events"), "ts", "event_type")
    return out.select(F.col("window.start").alias("began"), "event_type", "n")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf_dir):
    """Files that arrive as a stream, each key stored once."""
    source, path, check = _folder(spark), _folder(spark), _folder(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    e.repartition(3).write.parquet(source)
    incremental.upsert_new(incremental.rows_of(spark, source, e.schema, files=1), path, ["user_id", "event_type"], check).awaitTermination()
    return spark.read.parquet(path)
