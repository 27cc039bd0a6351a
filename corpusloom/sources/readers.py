"""Readers of corpus files as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def jsonl(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    """JSON lines of one or several parts; blank lines are skipped, the schema is given, not inferred."""
    return spark.read.schema(schema).json(paths)


def jsonl_parts(spark: SparkSession, folder: str, work: str, schema) -> DataFrame:
    """``<work>.jsonl`` and ``<work>.part*.jsonl`` as one table."""
    return spark.read.schema(schema).option("pathGlobFilter", f"{work}{{,.part*}}.jsonl").json(folder)


def json_files(spark: SparkSession, folder: str, schema) -> DataFrame:
    """One JSON document a file, below folders named by work; adds ``_work`` and ``_path``."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("_work"), path.alias("_path"))


def overlay(base: DataFrame, extra: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` and those rows of ``extra`` whose key it lacks, the first by ``order`` of each key."""
    first = extra.groupBy(key).agg(F.min_by(F.struct(*extra.columns), order).alias("r")).select("r.*")
    return base.unionByName(first.join(base.select(key), key, "left_anti").select(base.columns))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of files that each hold one JSON object; ``value`` is the DDL type of its values.

    Where each line has whole entries, as ``sinks.mapping`` writes them, lines are parsed by themselves, by many tasks.
    Any line that breaks inside an entry fails to parse; then a file is one row, and has to fit in a task.
    """
    kind = f"map<string,{value}>"
    lines, space = spark.read.text(path), " \t"
    inner = F.rtrim(F.ltrim("value", F.lit("{" + space)), F.lit("," + space))
    entries = F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), kind)  # the parser stops at the first end
    if lines.agg(F.bool_and(entries.isNotNull())).head()[0]:
        return lines.select(F.explode(entries))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)))


def with_header(rows: DataFrame, value: str, header: str) -> DataFrame:
    """The fields of a JSON header in the first line of ``value``, and the rest as ``body``."""
    parts = F.split(value, "\n", 2)
    return rows.select(F.from_json(F.get(parts, 0), header).alias("h"), F.coalesce(F.get(parts, 1), F.lit("")).alias("body")).select("h.*", "body")


def pages(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Files whose first line is a JSON header: its fields and ``body``."""
    return with_header(spark.read.text(path, wholetext=True), "value", header)


def after(text: Column, marker: str) -> Column:
    """What follows the first ``marker``, or the whole text without one."""
    return F.when(F.contains(text, F.lit(marker)), F.substr(text, F.instr(text, marker) + len(marker))).otherwise(text)


def between(text: Column, start: str = r"\*\*\* START OF[^\n]*\n", end: str = r"\*\*\* END OF") -> Column:
    """The body between two marks, without byte-order mark and carriage returns."""
    return F.regexp_extract(F.translate(text, "\r\ufeff", ""), f"(?s){start}(.*?)(?:{end}|$)", 1)


def text_after(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """(path, text) of files: what follows the first ``marker``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), after(F.col("value"), marker).alias("text"))


def text_between(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files: the body between two marks."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), between(F.col("value")).alias("text"))


def not_cached(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key is not in the cache."""
    return wanted.join(cached.select(key), key, "left_anti")


PAGE = "slug string, title string, url string, body string"


def fetch_pages(titles: DataFrame, cache: str, fetch, base_url: str = "") -> DataFrame:
    """Pages of all ``titles`` (title) from a cache of ``PAGE`` rows, which first gains those that it lacks.

    ``fetch(title) -> text`` is the only outside contact, and is tried again after failures. A page is known by
    the first 16 hex digits of its title's SHA-1, so that a run that stopped half way goes on where it was.
    """
    spark = titles.sparkSession
    named = titles.select("title").distinct().withColumn("slug", X.slug(X.norm(F.col("title"), joiners=True)))
    call = with_retry(fetch)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(body=[call(t) for t in pdf["title"]])

    try:
        missing = not_cached(named, spark.read.schema(PAGE).parquet(cache), "slug")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = named
    got = missing.withColumn("url", F.concat(F.lit(base_url), X.url_title(F.replace("title", F.lit(" "), F.lit("_"))))).select("slug", "title", "url").mapInPandas(run, PAGE)
    got.write.mode("append").parquet(cache)
    return spark.read.schema(PAGE).parquet(cache).join(named.select("slug"), "slug", "left_semi")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def snapshot(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """(path, length, sha256) of every file below ``folder``, stored at ``to``: what a run was made from."""
    file_digests(spark, folder).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


VECTORS = T.StructType([T.StructField("unit_id", T.LongType()), T.StructField("doc_id", T.StringType()), T.StructField("work", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """An index's unit vectors with their metadata."""
    return spark.read.schema(VECTORS).parquet(path)


def matrix(units: DataFrame, limit: int = 2_000_000):
    """(ids, float32 matrix) of an index that fits the driver, by unit; more than ``limit`` units are refused."""
    import numpy as np

    if (n := units.count()) > limit:
        raise ValueError(f"{n} units are too many for one matrix; use retrieve.dense_topk")
    held = units.select("unit_id", "embedding").orderBy("unit_id").toPandas()
    return held["unit_id"].to_numpy(np.int64), np.array(held["embedding"].tolist(), np.float32).reshape(len(held), -1)


def listed(spark: SparkSession, fetch, prefixes: list[str], page: int = 500) -> DataFrame:
    """(prefix, title) from a paged listing: ``fetch(prefix, token, page) -> (titles, next token)``.

    One task a prefix follows its tokens; ``fetch`` is the only outside contact.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for prefix in pdf["prefix"]:
                token: str | None = ""
                while token is not None:
                    titles, token = fetch(prefix, token, page)
                    yield pd.DataFrame({"prefix": [prefix] * len(titles), "title": titles})

    names = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    return names.repartition(max(1, len(prefixes))).mapInPandas(run, "prefix string, title string")


def with_retry(call, tries: int = 5, pause: float = 3.0, sleep=None):
    """``call`` tried again after failures, with pauses of one, two, ... times ``pause``."""
    import time

    def wrapped(*args):
        for k in range(tries):
            try:
                return call(*args)
            except OSError:
                if k == tries - 1:
                    raise
                (sleep or time.sleep)(pause * (k + 1))

    return wrapped
