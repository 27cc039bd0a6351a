"""Tables stored on the way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_HELD: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and reread, so that plans that share it, or retries, make it no second time.

    Without ``spark.checkpoint.dir`` it stays a plan. Tables are deleted when the driver ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df
    path = f"{root.rstrip('/')}/corpusloom-{label}-{uuid.uuid4().hex}"
    _HELD.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_held() -> None:
    for spark, path in _HELD:
        with suppress(Exception):  # a session that has ended leaves its folders to the cluster
            sc = spark.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
