"""Incremental work with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import sinks


def rows_of(spark: SparkSession, folder: str, schema, files: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def upsert_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str, transform=None) -> StreamingQuery:
    """Each micro-batch, transformed as a whole, appended where its keys are new: a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        sinks.append_new(transform(batch) if transform else batch, target, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_by_window(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind; rows later than ``late`` are left out."""
    from pyspark.sql import functions as F

    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"))
