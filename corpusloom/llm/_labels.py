"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, limit: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, text, label): at most ``limit`` labelled documents, the first by a hash of the id.

    ``learn`` restricts the rows of ``labels`` that may be seen. Several labels of
    one id are averaged; rows without an id or a label of 0 or 1 are left out. Of several texts of one id
    that with the least hash is taken. The sample's ids are broadcast: ``limit`` bounds them.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if learn is not None:
        rows = rows.where(learn)
    one = rows.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")
