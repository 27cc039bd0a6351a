"""The operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, exactdedup, langid, linededup, packing, pfor, quality_model, quality_rules, substring
from ._shared import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, fold("doc_id", 3) != 1, per_lang=2000))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: Shorter lines are shared by clean documents (on sf0.01 one of two has such a line), and are left to line dedup.
REPEATS = {"kinds": ("line", "paragraph", "phrase"), "min_words": 20, "min_run": 20}


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), **REPEATS)
    return out.select("doc_id", "n_removed", "removed", "text")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup by whole lines of any length, which SQL can say."""
    out = substring.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), kinds=("line",), min_words=1)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", gone.alias("n_points"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=0)


def op4_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.write_and_read(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_key=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup_batch(table(spark, sf_dir, "documents"), exactdedup.halves())


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = quality_model.word_vectors(docs)
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), vectors, fold("doc_id", 5) != 0, max_labels=20_000)
    out = quality_model.score(docs, model, vectors)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"), max_labels=20_000)
    return quality_rules.judge(docs, trees)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()} | {"repeated_lines": repeated_lines}


_OP7 = """
WITH lines AS (
  SELECT doc_id, pos, l, translate(trim(l, E' \\t\\n\\x0b\\f\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), hot AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, h.k IS NOT NULL AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP8 = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s FROM documents
), g AS (
  SELECT s, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM n GROUP BY s
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.s AS text_sha256 FROM n JOIN g USING (s)
"""


_LINES = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, pos, len(ls) AS n, l,
         trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k
  FROM (SELECT doc_id, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM split)
), ranked AS (
  SELECT *, l || CASE WHEN pos < n THEN chr(10) ELSE '' END AS whole,
         k <> '' AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS gone FROM lines
), kept AS (
  SELECT doc_id, coalesce(sum(length(whole)) FILTER (WHERE gone), 0)::BIGINT AS n_points,
         sha256(coalesce(string_agg(whole, '' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_points, 0) AS n_points, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": _OP7, "op8_exact_dedup": _OP8, "repeated_lines": _LINES}
