"""Queries over the shared tables, each with SQL that gives the same rows.

The driver's tables play the corpus: documents are chapters, their lines verses;
embeddings are retrieval units; benchmark items and every hundredth embedding are
questions; lineitem is an ordered verse list of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, cards, evaluate, parse, qa, retrieve, sequence
from ..sources import readers
from .registry import oracle_sql, queries, query, table

__all__ = ["oracle_sql", "queries"]

_t = table


# ---------------------------------------------------------------- aggregation and sets


@query("""
SELECT l_orderkey AS chapter, count(*) AS n_verses,
       string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS verse_ids,
       array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS speakers
FROM lineitem GROUP BY l_orderkey""")
def manifest_rollup(spark, sf_dir):
    out = parse.manifest(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", "l_returnflag")
    return out.select(F.col("l_orderkey").alias("chapter"), "n_verses", F.array_join(F.transform("verse_ids", lambda v: v.cast("string")), ",").alias("verse_ids"), F.array_join("speakers", ",").alias("speakers"))


@query("""
WITH h AS (SELECT o_orderstatus, (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))::INT AS hit FROM orders)
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS work, count(*) AS n, sum(hit)::BIGINT AS covered,
       round(100.0 * sum(hit) / count(*), 4)::DOUBLE AS percent
FROM h GROUP BY ROLLUP (o_orderstatus)""")
def coverage_rollup(spark, sf_dir):
    new = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return align.coverage(_t(spark, sf_dir, "orders"), new, "o_orderstatus", "o_orderkey")


@query("""
WITH a AS (SELECT l_orderkey k, count(*) n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
     b AS (SELECT l_orderkey k, count(*) n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.n = b.n THEN 'same' WHEN abs(a.n - b.n) <= 2 THEN 'close' ELSE 'far' END AS bucket,
       count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def reconcile_counts(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return align.reconcile(n.where("l_linestatus = 'F'"), n.where("l_linestatus = 'O'"), "k")


@query("""
SELECT doc_id, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id)""")
def not_generated_anti(spark, sf_dir):
    pending = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return cards.to_do(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), pending, "doc_id")


@query("""
WITH base AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE lang = 'en' AND text IS NOT NULL GROUP BY text),
     extra AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT md5(text) AS k, doc_id FROM base UNION ALL SELECT md5(text), doc_id FROM extra WHERE text NOT IN (SELECT text FROM base)""")
def overlay_first_wins(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("k"), "doc_id", "lang")
    base = docs.where("lang = 'en'").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return readers.overlay(base, docs.select("k", "doc_id"), "k", "doc_id")


@query("""
SELECT source, count(DISTINCT lang) AS n_langs, count(*) AS n_docs, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents GROUP BY source""")
def distinct_sets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_langs"), F.count(F.lit(1)).alias("n_docs"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query("""
SELECT source, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS median FROM documents GROUP BY source""")
def upper_median(spark, sf_dir):
    return evaluate.upper_median(_t(spark, sf_dir, "documents"), ["source"], "n_chars")


@query("""
SELECT l_linestatus AS model, l_returnflag AS effort, count(*) AS n, sum(l_quantity)::BIGINT AS input_tokens, sum(l_linenumber)::BIGINT AS output_tokens,
       round(sum((l_quantity * p.a + l_linenumber * p.b) / 1e6 * 0.5), 4) AS usd
FROM lineitem JOIN (VALUES ('F', 3.0, 15.0), ('O', 1.0, 5.0)) p(m, a, b) ON p.m = l_linestatus GROUP BY 1, 2""")
def cost_rollup(spark, sf_dir):
    prices = spark.createDataFrame([("F", 3.0, 15.0), ("O", 1.0, 5.0)], "model string, input_price double, output_price double")
    usage = _t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("effort"), F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").cast("bigint").alias("output_tokens"))
    return cards.usage_totals(usage, prices, ["model", "effort"], batch=True)


@query("""
SELECT o_orderpriority AS priority, CASE WHEN d = 0 THEN 'same' WHEN abs(d) > 3 THEN 'book' ELSE d::VARCHAR END AS shift, count(*) AS n
FROM (SELECT o_orderpriority, (o_orderkey % 11)::INT - (o_custkey % 11)::INT AS d FROM orders) GROUP BY 1, 2""")
def shift_histogram(spark, sf_dir):
    d = (F.col("o_orderkey") % 11 - F.col("o_custkey") % 11).cast("int")
    shift = F.when(d == 0, "same").when(F.abs(d) > 3, "book").otherwise(d.cast("string"))
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), shift.alias("shift")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- text functions and parsing


@query("""
SELECT doc_id, CASE WHEN a > b THEN 'native' WHEN b > a THEN 'latin' ELSE 'mixed' END AS script
FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^à-ÿ]', '', 'g')) a, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) b FROM documents)""")
def script_classify(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.script(F.coalesce("text", F.lit("")), "[à-ÿ]").alias("script"))


def _html_sql() -> str:
    e = "html"
    for p, by in ((r"(?s)<script[^>]*>.*?</script>", " "), (r"(?s)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"[ \t\n\r]+", " ")):
        e = f"regexp_replace({e}, '{p}', '{by}', 'g')"
    return f"SELECT page_id, trim({e}, ' ') AS text FROM pages"


@query(_html_sql())
def clean_html_pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("text"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, md5(line) AS line_md5, length(line) AS n FROM l WHERE trim(line, E' \\t\\r') <> '' AND NOT regexp_matches(line, '[#*$%&|<>]{3}')""")
def split_lines_posexplode(spark, sf_dir):
    out = parse.lines(_t(spark, sf_dir, "documents"), "doc_id", "text", "[#*$%&|<>]{3}")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line_md5"), F.length("line").alias("n"))


@query("""
WITH g AS (SELECT item_id, unnest(list_concat(list_transform(generate_series(1, length(text) - 3), lambda i: substr(text, i, 4)),
                                              list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS token FROM benchmark)
SELECT item_id, token, count(*) AS tf FROM g GROUP BY 1, 2""")
def char_ngrams_tokens(spark, sf_dir):
    return retrieve.postings(_t(spark, sf_dir, "benchmark"), "item_id", X.lexical_tokens(F.col("text"), 4))


@query("""
SELECT item_id, substr(sha1(text), 1, 16) AS slug, replace(replace('w__' || item_id || '.1', '.', '_'), ' ', '') AS request,
       regexp_replace(nfc_normalize(text), '[\\s।॥|.,;:!?-]+', '', 'g') AS squashed FROM benchmark""")
def scalar_functions(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark")
    return b.select("item_id", X.slug(F.col("text")).alias("slug"), X.request_id(F.lit("w"), F.concat(F.col("item_id").cast("string"), F.lit(".1"))).alias("request"), X.squash(F.col("text")).alias("squashed"))


@query("""
SELECT doc_id, len(p) AS n, list_sum(list_transform(p, lambda x: length(x))) + 0 AS kept, length(text) AS total
FROM (SELECT doc_id, text, list_filter([text[1:length(text) // 3], text[length(text) // 3 + 1:2 * (length(text) // 3)], text[2 * (length(text) // 3) + 1:]], lambda x: length(x) > 12) AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""")
def span_split(spark, sf_dir):
    third = F.floor(F.length("text") / 3).cast("int")
    d = _t(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("cuts", F.array(third, 2 * third))
    p = F.filter(align.split_at(F.col("text"), F.col("cuts")), lambda x: F.length(x["piece"]) > 12)
    kept = F.when(F.size("p") > 0, F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x["piece"])))
    return d.select("doc_id", "text", p.alias("p")).select("doc_id", F.size("p").alias("n"), kept.alias("kept"), F.length("text").alias("total"))


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\u200c\u200d]', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS norm_md5 FROM documents""")
def normalise_nfc(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(X.norm(F.col("text"), joiners=True).cast("binary")).alias("norm_md5"))


_DIGIT = "[०-९0-9]"
_MARK = rf"(?:[।॥]\s*{_DIGIT}+(?:\s*[.,\-]\s*{_DIGIT}+){{0,2}}\s*[।॥]*|\s{_DIGIT}+(?:\s*[.,\-]\s*{_DIGIT}+){{0,2}}\s*[।॥]+)"
_BARE = rf"\s(?:{_DIGIT}+,)?(?:{_DIGIT}+[.\-]){{0,2}}{_DIGIT}+\s*$"


@query(f"""
WITH l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS ln FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), ' ॥ ७ ॥' || chr(10)), chr(10)) AS ls FROM documents)),
     t AS (SELECT doc_id, ln, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l),
     k AS (SELECT *, regexp_matches(line, ',$') AS reset FROM t WHERE line <> '' AND NOT regexp_matches(line, '^(?:\\{{\\{{|\\}}\\}}|\\||\\[\\[|<|\\(|$|''$|=)')),
     m AS (SELECT *, CASE WHEN NOT regexp_matches(line, '{_MARK}') AND regexp_matches(line, '{_BARE}') THEN '{_BARE}' ELSE '{_MARK}' END AS pat FROM k),
     p AS (SELECT doc_id, ln, reset, CASE WHEN reset THEN [''] WHEN pat = '{_BARE}' THEN string_split_regex(line, '{_BARE}') ELSE string_split_regex(line, '{_MARK}') END AS bodies,
                  CASE WHEN reset THEN [] WHEN pat = '{_BARE}' THEN regexp_extract_all(line, '{_BARE}') ELSE regexp_extract_all(line, '{_MARK}') END AS marks FROM m),
     c AS (SELECT doc_id, ln, reset, unnest(bodies) AS body, unnest(list_resize(marks, len(bodies), NULL)) AS mark, generate_subscripts(bodies, 1) AS piece FROM p),
     w AS (SELECT *, coalesce(sum((mark IS NOT NULL OR reset)::INT) OVER (PARTITION BY doc_id ORDER BY ln, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wait FROM c),
     g AS (SELECT doc_id, wait, max(mark) AS mark, max(ln) FILTER (WHERE mark IS NOT NULL) AS ln,
                  string_agg(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY ln, piece) FILTER (WHERE regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> '') AS body FROM w GROUP BY 1, 2),
     v AS (SELECT doc_id, wait, ln, regexp_replace(trim(body, ' ।॥'), '\\s+', ' ', 'g') AS text, list_transform(regexp_extract_all(mark, '{_DIGIT}+'), lambda x: translate(x, '०१२३४५६७८९', '0123456789')::BIGINT) AS ns FROM g WHERE mark IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, wait) - 1 AS pos, CASE WHEN len(ns) > 1 THEN ns[-2] ELSE -1 END AS chapter, ns[-1] AS n, md5(text) AS text_md5 FROM v WHERE text <> ''""")
def marker_split(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ॥ ७ ॥\n").alias("text"))
    return parse.split_marked(d, "doc_id", "text").select("doc_id", "pos", F.coalesce("chapter", F.lit(-1)).alias("chapter"), "n", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS ps FROM pages)
SELECT page_id, unnest(ps) AS body, unnest(generate_series(0, len(ps) - 1)) AS pos FROM m""")
def paragraph_split(spark, sf_dir):
    ps = F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.posexplode(ps).alias("pos", "body")).select("page_id", "body", F.col("pos").cast("bigint").alias("pos"))


# ---------------------------------------------------------------- sequences


@query("""
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM c)
SELECT user_id, island, event_type, min(event_id) AS event_id, string_agg(event_id::VARCHAR, ' ' ORDER BY ts, event_id) AS ids, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def islands_merge(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").cast("string").alias("ids"))
    return sequence.merge_islands(e, ["user_id"], ["ts", "event_id"], ["event_type"], "ids").select("user_id", "island", "event_type", "event_id", "ids", "n")


@query("""
WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_linenumber AS n,
                  lag(l_linenumber) OVER w AS prev, lead(l_linenumber) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
     b AS (SELECT *, CASE WHEN n <= 3 AND prev >= 5 AND nxt <= n + 2 THEN 1 ELSE 0 END AS s FROM a),
     c AS (SELECT l_suppkey, sum(s) AS starts, count(*) AS n FROM b GROUP BY 1)
SELECT l_suppkey, starts::BIGINT AS last_run, n FROM c""")
def restart_runs(spark, sf_dir):
    out = sequence.runs(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_linenumber", low=3, high=5)
    return out.groupBy("l_suppkey").agg(F.max("run").alias("last_run"), F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE s AS (SELECT conv_id, turn, turn % 100 AS n, lead(turn % 100) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
 r AS (SELECT conv_id, k, turn, n FROM s WHERE k = 1
       UNION ALL
       SELECT s.conv_id, s.k, s.turn, CASE WHEN (s.n < r.n + 1 AND r.n + 1 >= 100 AND (r.n + 1 - s.n) % 100 = 0) OR (s.n < r.n AND s.nxt = r.n + 2) THEN r.n + 1 ELSE s.n END
       FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)
SELECT conv_id, turn, n FROM r""")
def number_repair(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("turn") % 100).alias("n"))
    return sequence.repair_numbers(turns, ["conv_id"], ["turn", "role", "text"], "n").select("conv_id", "turn", "n")


@query("""
WITH f AS (SELECT source || ':' || coalesce(lang, '') AS k, doc_id, coalesce(text, '') AS text, first_value(coalesce(text, '')) OVER (PARTITION BY source, lang ORDER BY doc_id) AS f,
                  row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents),
     g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM f WHERE rn = 1 OR text <> f)
SELECT k, doc_id, CASE WHEN r = 1 THEN '' ELSE '-r' || r END AS suffix FROM g""")
def dup_suffix(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit(":"), F.coalesce("lang", F.lit(""))).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sequence.suffix_duplicates(d, ["k"], ["doc_id"], "text").select("k", "doc_id", "suffix")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS speaker FROM conversations""")
def carry_forward(spark, sf_dir):
    said = F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary")))
    return sequence.carry_forward(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], said, "speaker").select("conv_id", "turn", "speaker")


@query("""
WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, (l_quantity = 50)::INT AS a, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem
           WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
     b AS (SELECT *, (max(a) OVER (PARTITION BY l_suppkey ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 OR k <= 2) AS i FROM a),
     c AS (SELECT *, sum(i::INT) OVER (PARTITION BY l_suppkey) AS kept FROM b),
     d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS c FROM c WHERE n <= 30 OR CASE WHEN kept < 8 THEN k <= 120 ELSE i END)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM d WHERE c <= 120""")
def context_window_select(spark, sf_dir):
    out = sequence.select_context(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], F.col("l_quantity") == 50)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 50000""")
def budget_prefix(spark, sf_dir):
    return sequence.budget_prefix(_t(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 50000).select("source", "doc_id", "running")


@query("""
WITH RECURSIVE s AS (SELECT p_brand AS work, p_partkey AS chapter, p_retailprice AS cost, row_number() OVER (ORDER BY p_brand, p_partkey) AS k FROM part),
 r AS (SELECT k, work, chapter, cost, cost <= 100000.0 AS ok, CASE WHEN cost <= 100000.0 THEN cost ELSE 0.0 END AS spent, cost > 100000.0 AS shut FROM s WHERE k = 1
       UNION ALL
       SELECT s.k, s.work, s.chapter, s.cost, f.ok, r.spent + CASE WHEN f.ok THEN s.cost ELSE 0.0 END, NOT f.ok
       FROM r JOIN s ON s.k = r.k + 1, LATERAL (SELECT NOT (r.shut AND r.work = s.work) AND r.spent + s.cost <= 100000.0 AS ok) f)
SELECT work, chapter, cost FROM r WHERE ok""")
def budget_plan(spark, sf_dir):
    chapters = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("work"), F.col("p_partkey").alias("chapter"), F.col("p_retailprice").alias("cost"))
    return cards.plan(chapters, 100_000.0, ["work", "chapter"], "work", "cost").select("work", "chapter", "cost")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, source FROM documents) SELECT source, doc_id, (k - 1) // 500 AS chunk FROM r""")
def chunked(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _t(spark, sf_dir, "documents").select("source", "doc_id", sequence.chunk(k, 500).alias("chunk"))


# ---------------------------------------------------------------- retrieval

_TOKENS = "list_concat(CASE WHEN length(text) >= 4 THEN list_transform(generate_series(1, length(text) - 3), lambda i: substr(text, i, 4)) ELSE [] END, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))"
_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS toks FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
     len_ AS (SELECT doc_id, len(toks) AS dl FROM d), w AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len_),
     tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM d) GROUP BY 1, 2),
     raw AS (SELECT token, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM tf GROUP BY 1), w),
     idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
     q AS (SELECT item_id AS query_id, token, count(*) AS qf FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)) GROUP BY 1, 2),
     s AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
           FROM q JOIN tf USING (token) JOIN idf USING (token) JOIN len_ USING (doc_id), w GROUP BY 1, 2)
"""


@query(_BM25 + """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    q = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieve.bm25_topk(_t(spark, sf_dir, "documents"), q, 5)


@query(f"""
WITH d AS (SELECT item_id, {_TOKENS} AS toks FROM benchmark), tf AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(toks) AS token FROM d))
SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5), 6) AS idf FROM tf GROUP BY token""")
def bm25_stats(spark, sf_dir):
    docs = _t(spark, sf_dir, "benchmark")
    df = retrieve.postings(docs, "item_id", X.lexical_tokens(F.col("text"))).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5), 6).alias("idf"))


def _units(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("work"), "embedding")


def _asked(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("work"), "embedding")


_SIM = """
WITH q AS (SELECT vec_id AS query_id, label AS qwork, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
     s AS (SELECT query_id, qwork, vec_id, label, round(list_inner_product(e::DOUBLE[], embedding::DOUBLE[]), 6) + 0 AS score FROM q, embeddings),
     dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM s),
     hint AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM s WHERE label = qwork)
"""


@query(_SIM + "SELECT query_id, vec_id::VARCHAR AS doc_id, score, rank FROM dense WHERE rank <= 30")
def dense_topk(spark, sf_dir):
    return retrieve.dense_topk(_units(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


@query(_SIM + "SELECT query_id, vec_id::VARCHAR AS doc_id, score, rank FROM hint WHERE rank <= 30")
def dense_topk_filtered(spark, sf_dir):
    return retrieve.dense_topk(_units(spark, sf_dir), _asked(spark, sf_dir), same_work=True).select("query_id", "doc_id", "score", "rank")


_MASKED = _SIM + """, m AS (SELECT query_id, vec_id, CASE WHEN label = qwork THEN score ELSE -1.0 END AS score FROM s),
     c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM m),
     masked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM c WHERE r <= 240)
"""


@query(_MASKED + "SELECT query_id, vec_id::VARCHAR AS doc_id, score, rank FROM masked WHERE rank <= 30")
def dense_topk_masked(spark, sf_dir):
    return retrieve.dense_topk(_units(spark, sf_dir), _asked(spark, sf_dir), mask=True).select("query_id", "doc_id", "score", "rank")


@query(_SIM + "SELECT query_id, label::VARCHAR AS doc_id, max(score) AS score, arg_min(vec_id, (-score, vec_id)) AS unit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 240 GROUP BY 1, 2")
def max_over_units(spark, sf_dir):
    units = _units(spark, sf_dir).withColumn("doc_id", F.col("work"))
    return retrieve.dense_topk(units, _asked(spark, sf_dir), pool=1000).select("query_id", "doc_id", "score", "unit_id")


@query(_SIM + """, l AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM
   (SELECT query_id, vec_id, round(list_inner_product(e[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]), 6) + 0 AS score FROM q, embeddings)),
 r AS (SELECT query_id, vec_id, max(a) AS a, max(b) AS b FROM (SELECT query_id, vec_id, rank AS a, NULL AS b FROM dense WHERE rank <= 30 UNION ALL SELECT query_id, vec_id, NULL, rank FROM l WHERE rank <= 30) GROUP BY 1, 2),
 f AS (SELECT query_id, vec_id, round(coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0), 9) AS score, coalesce(a, 30 + b) AS tie FROM r)
SELECT query_id, vec_id::VARCHAR AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, vec_id::VARCHAR) AS rank FROM f) WHERE rank <= 6""")
def rrf_fusion(spark, sf_dir):
    units, asked = _units(spark, sf_dir), _asked(spark, sf_dir)
    half = lambda d: d.withColumn("embedding", F.slice("embedding", 1, 32))
    return retrieve.rrf(retrieve.dense_topk(units, asked), retrieve.dense_topk(half(units), half(asked)), 6)


@query(_MASKED + """, r AS (SELECT query_id, vec_id, max(a) AS a, max(b) AS b FROM (SELECT query_id, vec_id, rank AS a, NULL AS b FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, NULL, rank FROM masked WHERE rank <= 20) GROUP BY 1, 2),
 f AS (SELECT query_id, vec_id, round(coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0), 9) AS score, coalesce(a, 20 + b) AS tie FROM r)
SELECT query_id, vec_id::VARCHAR AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, vec_id::VARCHAR) AS rank FROM f) WHERE rank <= 6""")
def soft_hint_fusion(spark, sf_dir):
    units, asked = _units(spark, sf_dir), _asked(spark, sf_dir)
    return retrieve.soft_hint(retrieve.dense_topk(units, asked, pool=20), retrieve.dense_topk(units, asked, pool=20, mask=True), 6)


def _grams(df: DataFrame, id_: str, name: str) -> DataFrame:
    return df.select(F.col(id_).alias(name), F.array_distinct(X.char_grams(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), 3)).alias("grams"))


@query("""
WITH p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name || p_type), '[^a-z]', '', 'g') AS s FROM part), v AS (SELECT DISTINCT s FROM p),
     g AS (SELECT s, list_distinct(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3))) AS g FROM v),
     j AS (SELECT a.s AS l, b.s AS r, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS t FROM g a, g b)
SELECT l, r, round(i / (t - i), 6) AS score FROM j WHERE i / (t - i) >= 0.5 - 1e-12""")
def jaccard_semi_join(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.regexp_replace(F.lower(F.concat("p_name", "p_type")), "[^a-z]", "").alias("text")).distinct()
    out = align.jaccard_pairs(_grams(names, "text", "lid"), _grams(names, "text", "rid"), 0.5)
    return out.select(F.col("lid").alias("l"), F.col("rid").alias("r"), F.round("score", 6).alias("score"))


@query("""
WITH d AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, coalesce(text, '') AS text FROM documents),
     v AS (SELECT DISTINCT book, (r - 1) // 2 AS ch, r % 2 AS side, md5(l) AS k FROM (SELECT book, r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE trim(l, E' \\t\\r') <> ''),
     n AS (SELECT book, ch, count(*) AS n FROM v WHERE side = 1 GROUP BY 1, 2),
     h AS (SELECT a.book, a.ch AS new_ch, b.ch AS old_ch, count(*) AS hits FROM v a JOIN v b ON a.book = b.book AND a.k = b.k AND abs(a.ch - b.ch) <= 10 WHERE a.side = 1 AND b.side = 0 GROUP BY 1, 2, 3),
     s AS (SELECT h.book, new_ch, old_ch, round(hits / n, 6) AS score FROM h JOIN n ON n.book = h.book AND n.ch = new_ch)
SELECT book, new_ch, old_ch, score FROM (SELECT *, row_number() OVER (PARTITION BY book, new_ch ORDER BY score DESC, old_ch) AS k FROM s WHERE score >= 0.1) WHERE k = 1""")
def band_align(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    v = parse.lines(d.withColumn("id", F.struct("source", "r")), "id", "text").select(F.col("id.source").alias("book"), F.floor((F.col("id.r") - 1) / 2).alias("ch"), (F.col("id.r") % 2).alias("side"), F.md5(F.col("line").cast("binary")).alias("key"))
    return align.band_align(v.where("side = 1"), v.where("side = 0"), 10, 0.1)


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^a-zāīūṛṝḷṃḥśṣñṅṭḍṇ]', '', 'g') AS s FROM conversations),
 g AS (SELECT conv_id, turn, list_distinct(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3))) AS g FROM t),
 j AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, len(list_intersect(a.g, b.g)) AS inter, len(a.g) + len(b.g) AS total FROM g a JOIN g b ON a.conv_id = b.conv_id WHERE a.turn % 2 = 0 AND b.turn % 2 = 1),
 p AS (SELECT conv_id, i, j, inter / (total - inter) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY inter / (total - inter) DESC, i DESC, j DESC) AS k FROM j WHERE total > 0 AND inter / (total - inter) >= 0.2 - 1e-12),
 r AS (SELECT conv_id, 1::BIGINT AS k, i, j, score, true AS ok, [i] AS used, MAP {j: i} AS held FROM p WHERE k = 1
       UNION ALL
       SELECT p.conv_id, p.k, p.i, p.j, p.score, f.ok, CASE WHEN f.ok THEN list_append(r.used, p.i) ELSE r.used END, CASE WHEN f.ok AND NOT list_contains(map_keys(r.held), p.j) THEN map_concat(r.held, MAP {p.j: p.i}) ELSE r.held END
       FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1,
       LATERAL (SELECT NOT list_contains(r.used, p.i) AND (NOT list_contains(map_keys(r.held), p.j) OR abs(r.held[p.j] - p.i) = 1) AS ok) f)
SELECT conv_id AS chapter, i, j, score FROM r WHERE ok""")
def verse_align_greedy(spark, sf_dir):
    t = _t(spark, sf_dir, "conversations")
    side = lambda parity, name: t.where(F.col("turn") % 2 == parity).select(F.col("turn").alias(name), "conv_id", X.gram_set(F.col("text")).alias("grams"))
    pairs = align.jaccard_pairs(side(0, "lid"), side(1, "rid"), 0.2, ["conv_id"]).select(F.col("conv_id").alias("chapter"), F.col("lid").alias("i"), F.col("rid").alias("j"), "score")
    return align.match_greedily(pairs)


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS quote, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
     s AS (SELECT c.doc_id, c.pos, regexp_replace(nfc_normalize(quote), '[\\s।॥|.,;:!?-]+', '', 'g') AS q, regexp_replace(nfc_normalize(coalesce(d.text, '')), '[\\s।॥|.,;:!?-]+', '', 'g') AS p, d.doc_id AS given FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id + c.pos % 2)
SELECT doc_id, pos, CASE WHEN given IS NULL THEN 'not in retrieved chapters' WHEN length(q) >= 8 AND contains(p, q) THEN 'verified' ELSE 'not verbatim' END AS status FROM s""")
def verbatim_verify(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    c = d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "quote")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "quote")
    cited = c.select("doc_id", "pos", "quote", (F.col("doc_id") + F.col("pos") % 2).alias("given"))
    passages = d.select(F.col("doc_id").alias("given"), F.coalesce("text", F.lit("")).alias("text"))
    return qa.checked(cited, passages, ["doc_id", "pos"]).select("doc_id", "pos", "status")


@query(_SIM + """, gold AS (SELECT query_id, qwork AS kind, vec_id FROM s WHERE label = qwork AND vec_id <> query_id),
 r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dense WHERE rank <= 30 AND vec_id <> query_id),
 n AS (SELECT query_id, kind, count(DISTINCT vec_id) AS n FROM gold GROUP BY 1, 2),
 h AS (SELECT query_id, min(rank) AS f, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS c FROM r JOIN gold USING (query_id, vec_id) GROUP BY 1),
 p AS (SELECT n.query_id, kind, CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS h1, CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS h5, CASE WHEN f <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS h10, coalesce(c, 0) / n AS rec, coalesce(1 / f, 0) AS rr,
       coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))) AS ndcg FROM n LEFT JOIN h USING (query_id))
SELECT CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind::VARCHAR END AS kind, count(*) AS n, round(avg(h1), 6) AS hit_at_1, round(avg(h5), 6) AS hit_at_5, round(avg(h10), 6) AS hit_at_10, round(avg(rec), 6) AS recall_at_10, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_10
FROM p GROUP BY ROLLUP (kind)""")
def eval_metrics(spark, sf_dir):
    units, asked = _units(spark, sf_dir), _asked(spark, sf_dir)
    ranking = retrieve.dense_topk(units, asked).where(F.col("doc_id") != F.col("query_id").cast("string"))
    ranking = ranking.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gold = asked.select("query_id", F.col("work").alias("kind")).join(units.select("doc_id", F.col("work").alias("kind")), "kind").where(F.col("doc_id") != F.col("query_id").cast("string"))
    return evaluate.summary(evaluate.per_query(ranking, gold))


@query("""
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 25""")
def stratified_sample(spark, sf_dir):
    return evaluate.stratified(_t(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 25)


_HYBRID = _BM25 + """,
 asked AS (SELECT b.item_id AS query_id, e.label::VARCHAR AS work, e.embedding AS e FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
 cand AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT query_id, doc_id FROM asked, documents) LEFT JOIN s USING (query_id, doc_id) {where}),
 lex AS (SELECT query_id, doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cand),
 sims AS (SELECT query_id, vec_id, {score} AS score FROM asked, embeddings WHERE e IS NOT NULL),
 unit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sims),
 den AS (SELECT query_id, vec_id::VARCHAR AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM unit WHERE r <= 240),
 r AS (SELECT query_id, id, max(a) AS a, max(b) AS b FROM (SELECT query_id, id, rank AS a, NULL AS b FROM den WHERE rank <= 30 UNION ALL SELECT query_id, id, NULL, rank FROM lex WHERE rank <= 30) GROUP BY 1, 2),
 f AS (SELECT query_id, id, round(coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0), 9) AS score, coalesce(a, 30 + b) AS tie FROM r)
SELECT query_id, id AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, id) AS rank FROM f) WHERE rank <= 6"""
_INNER = "round(list_inner_product(e::DOUBLE[], embedding::DOUBLE[]), 6) + 0"


def _hybrid(spark, sf_dir, same_work):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10).cast("string").alias("work"))
    vec = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("work"), "embedding")
    asked = _t(spark, sf_dir, "benchmark").join(vec, "item_id", "left").select(F.col("item_id").alias("query_id"), "text", "work", "embedding")
    return retrieve.hybrid_search(docs, _units(spark, sf_dir), asked, same_work=same_work)


@query(_HYBRID.replace("{where}", "").replace("{score}", _INNER))
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, False)


@query(_HYBRID.replace("{where}", "JOIN asked USING (query_id) WHERE (doc_id % 10)::VARCHAR = work").replace("{score}", f"CASE WHEN label::VARCHAR = work THEN {_INNER} ELSE -1.0 END"))
def hybrid_search_in_work(spark, sf_dir):
    """Both lists of the query's work: the dense one masked before the cut, the lexical one strict."""
    return _hybrid(spark, sf_dir, True)


# ---------------------------------------------------------------- records and answers


@query("""
SELECT d.doc_id, list_aggregate(list_filter([CASE WHEN length(text) < 200 OR text IS NULL THEN 'short' END, CASE WHEN l.quality IS NULL OR l.quality = 0 THEN 'quality' END, CASE WHEN regexp_matches(text, '[#*$%&|<>]{3}') OR text IS NULL THEN 'symbols' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS errors
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def validate_rules(spark, sf_dir):
    met = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    e = cards.errors(("short", F.length("text") < 200), ("quality", F.col("quality") == 0), ("symbols", F.rlike("text", F.lit("[#*$%&|<>]{3}"))))
    return met.select("doc_id", F.when(F.size(e) > 0, F.array_join(e, ",")).alias("errors"))


@query("""
WITH v AS (SELECT l_orderkey AS k, list(l_linenumber) AS ok FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey AS k, l_linenumber + (l_partkey % 3 = 0)::INT AS n FROM lineitem)
SELECT a.k AS chapter, count(*) FILTER (WHERE list_contains(ok, n)) AS valid, count(*) FILTER (WHERE NOT list_contains(ok, n)) AS dropped FROM a JOIN v ON a.k = v.k GROUP BY 1""")
def repair_ids(spark, sf_dir):
    own = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    anchor = F.concat(F.lit("x-"), (F.col("l_linenumber") + (F.col("l_partkey") % 3 == 0).cast("int")).cast("string"))
    got = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(own).alias("ids"), F.collect_list(anchor).alias("anchors"))
    fixed = F.transform("anchors", lambda v: cards.repair_anchor(v, F.col("l_orderkey").cast("string"), F.col("ids")))
    ok = F.size(F.array_compact(fixed)).cast("bigint")
    return got.select(F.col("l_orderkey").alias("chapter"), ok.alias("valid"), (F.size("anchors") - ok).cast("bigint").alias("dropped"))


@query("""
SELECT DISTINCT sha1(text) AS key FROM documents WHERE text IS NOT NULL AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)""")
def embedding_cache_antijoin(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    cache = d.where("lang = 'en' and text is not null").select(F.sha1(F.col("text").cast("binary")).alias("key"))
    return retrieve.embedding_misses(d, cache).select("key")


@query(_BM25 + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
 quoted AS (SELECT query_id, length(regexp_replace(nfc_normalize(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')[1:6], ' ')), '[\\s।॥|.,;:!?-]+', '', 'g')) >= 8 AS ok
            FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3),
 n AS (SELECT query_id, count(*) AS given, count(*) FILTER (WHERE ok) AS good FROM quoted GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'out_of_scope' ELSE 'story' END AS route,
       CASE WHEN trim(coalesce(text, '')) <> '' AND good > 0 THEN 'answered' ELSE 'refused' END AS status,
       CASE WHEN trim(coalesce(text, '')) <> '' THEN coalesce(good, 0) ELSE 0 END::INT AS n_verified,
       CASE WHEN trim(coalesce(text, '')) = '' OR given IS NULL THEN 0 WHEN good = given THEN 1 ELSE 2 END AS attempts
FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id""")
def qa_answers(spark, sf_dir):
    ranking = bm25_topk(spark, sf_dir).where("rank <= 3")
    d = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    passages = ranking.join(d, "doc_id").select("query_id", F.col("doc_id").cast("string").alias("verse_id"), "text", "rank")
    out = qa.answer(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), passages, qa.OfflineClient())
    return out.select("query_id", "route", "status", F.size("verified").alias("n_verified"), "attempts")


from . import catalog_corpus  # noqa: E402, F401  (registers its queries)
