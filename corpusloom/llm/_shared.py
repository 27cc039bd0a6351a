"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where driver and executors are one process, a temporary folder if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


#: Folders that hold tables which a result may still read.
_HELD: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_held() -> None:
    for spark, path in _HELD:
        with suppress(Exception):  # the session may have ended: then its folders are left to the cluster
            _delete(spark, path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside are deleted at the end: what was made of them must have been stored by then."""
    first = len(_HELD)
    try:
        yield
    finally:
        for _, path in _HELD[first:]:
            _delete(spark, path)
        del _HELD[first:]


class Scratch:
    """Intermediate tables written as Parquet, so that a lost executor costs no recomputation.

    A result reads them when it is run, so they are kept until ``released`` ends or the driver does.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/corpusloom-{label}-{uuid.uuid4().hex}"
        _HELD.append((spark, self.path))

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write ``df`` and return it reread: the lineage is cut at stored files.

        ``batch`` bounds the rows of an Arrow batch while ``df`` is made, for rows
        that are large; the session's own bound is put back.
        """
        target, conf = f"{self.path}/{name}", self.spark.conf
        before = conf.get(BATCH)
        if batch is not None:
            conf.set(BATCH, min(batch, int(before)) if int(before) > 0 else batch)
        try:
            df.write.mode("overwrite").parquet(target)
        finally:
            conf.set(BATCH, before)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        _delete(self.spark, f"{self.path}/{name}")


def own_key(id_col: str, text_col: str) -> Column:
    """What tells one document from another: its id and two hashes of its text. Rows equal in both are one document."""
    text = F.col(f"`{text_col}`")
    return F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(0x5EED), text).alias("g"))


def packed(docs: DataFrame, *without: str) -> Column:
    """All columns of ``docs`` but ``without`` in one struct, which no other column's name can clash with."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in without])


def fold(doc_id: str, n: int):
    """crc32 of the id's decimal text modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)
