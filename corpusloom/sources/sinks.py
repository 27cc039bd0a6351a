"""Writers of corpus tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def jsonl(df: DataFrame, path: str) -> int:
    """Overwrite ``path`` with JSON lines; the number of rows, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def sized(df: DataFrame, path: str, limit: int = 90 << 20) -> None:
    """JSON lines in files of about ``limit`` bytes at most; parts of an earlier write go.

    Rows are measured as they will be written, and dealt to files by the running size of their partition; a row
    longer than the limit is a file of its own.
    """
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    part = lines.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).withColumn("_b", F.octet_length("value") + 1)
    part = stored(part, "lines")  # so that the numbering is that of the rows written
    w = Window.partitionBy("_p").orderBy("_i")
    file = F.floor((F.sum("_b").over(w) - F.col("_b")) / limit)
    dealt = part.withColumn("_f", file)
    files = stored(dealt.select("_p", "_f").distinct().withColumn("_id", (F.row_number().over(Window.orderBy("_p", "_f")) - 1).cast("int")), "files")  # a row a file
    numbered = dealt.join(F.broadcast(files), ["_p", "_f"]).repartitionById(max(1, files.count()), "_id")
    numbered.sortWithinPartitions("_i").select("value").write.mode("overwrite").text(path)


def keyed(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions that ``df`` has rows for; a failed job leaves the old ones."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """A small table written beside ``path`` and then renamed over it, so that a reader sees the old one or the new one.

    For ledgers and maps, which are made from what is at ``path`` now.
    """
    spark = df.sparkSession
    trial = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(trial)
    fs, old, new = _places(spark, path, trial)
    _renamed(fs, new, old)
    return spark.read.schema(df.schema).parquet(path)


def _places(spark, *paths: str):
    """The file system of the first path, and the paths as Hadoop's."""
    sc = spark.sparkContext
    places = [sc._jvm.org.apache.hadoop.fs.Path(x) for x in paths]
    return places[0].getFileSystem(sc._jsc.hadoopConfiguration()), *places


def _renamed(fs, new, old) -> None:
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not rename {new} to {old}")


def mapping(df: DataFrame, path: str, key: str) -> int:
    """One JSON object of ``key`` to the other columns, in order of the key, in the one file of a folder; the number of its entries.

    Tasks sort and write ranges of keys, whose files are then appended to one another as bytes: no task and no row holds
    the map. A line has 64 entries, so that readers can split the file. A null key is "null", as Python writes it.
    """
    from pyspark.sql import Observation

    spark, seen = df.sparkSession, Observation()
    value = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    name = F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"))), r'^\{"k":(.*)\}$', 1)  # quoted as JSON does
    pairs = df.repartitionByRange(F.col(key)).select(F.col(key).alias("_key"), F.concat(name, F.lit(":"), value).alias("e"))
    begins = F.when(F.monotonically_increasing_id() % 64 == 0, "\n").otherwise("")
    rows = pairs.sortWithinPartitions("_key", "e").select(F.concat(begins, "e").alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    trial = f"{path}.{uuid.uuid4().hex}"
    rows.write.option("lineSep", ",").option("compression", "none").text(f"{trial}/parts")
    fs, old, new, parts, whole = _places(spark, path, trial, f"{trial}/parts", f"{trial}/part-00000.txt")
    files = sorted(((x.getPath().getName(), x.getLen(), x.getPath()) for x in fs.listStatus(parts) if x.getLen()), key=lambda x: x[0])
    out = fs.create(whole)
    try:
        out.write(b"{")
        for k, (_, n, file) in enumerate(files):
            part = fs.open(file)
            try:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, n - (k == len(files) - 1))  # the last entry has no comma
            finally:
                part.close()
            fs.delete(file, False)
        out.write(b"}\n")
    finally:
        out.close()
    fs.delete(parts, True)
    _renamed(fs, new, old)
    return seen.get["n"]


def index(path: str, units: DataFrame, docs: DataFrame, statistics: DataFrame) -> None:
    """An index as tables: units with vectors, cards, lexical statistics, and last the digest by which it is known to be current."""
    units.write.mode("overwrite").parquet(f"{path}/units")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    statistics.write.mode("overwrite").parquet(f"{path}/statistics")
    fingerprint(docs).write.mode("overwrite").parquet(f"{path}/fingerprint")


def fingerprint(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(n, digest): the number of ids and a sum of their hashes, whatever their order."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def current(path: str, docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether the index at ``path`` was made of exactly these documents."""
    from pyspark.errors import AnalysisException

    try:
        there = docs.sparkSession.read.parquet(f"{path}/fingerprint").head()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return there == fingerprint(docs, key).head()


def report(df: DataFrame, order: list[str]) -> str:
    """A small result as an aligned table, to print; numbers to the right."""
    rows = [tuple("-" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for v in r) for r in df.orderBy(*order).limit(1000).collect()]
    right = [f.dataType.typeName() in ("integer", "long", "double", "float", "decimal") for f in df.schema.fields]
    wide = [max(map(len, c)) for c in zip(df.columns, *rows, strict=True)]
    return "\n".join("  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(row, wide, right, strict=True)).rstrip() for row in [tuple(df.columns), *rows])


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys are not yet stored, each once.

    It looks, then appends: one writer at a time. Of two at once, both may add a key; readers that
    must not see that take ``dropDuplicates(keys)``.
    """
    from pyspark.errors import AnalysisException

    fresh = df.dropDuplicates(keys)
    try:
        fresh = fresh.join(df.sparkSession.read.parquet(path).select(keys), keys, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)
