"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Edges that one task works through at once (some 300 bytes each there).
SMALL = 300_000


def _at_once(edges: DataFrame) -> DataFrame:
    """The components of at most ``SMALL`` edges, in the memory of one task."""

    def run(batches):
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        names = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([root(x) for x in names], kind)], ["node", "comp"])

    name = edges.schema["u"].dataType.simpleString()
    kind = pa.binary() if name == "binary" else pa.string()
    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {name}, comp {name}")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) of every node in ``edges`` (u, v); comp is the least node of its component.

    Each round a node takes the least label among its neighbours', and then the
    label of its label, so that distances halve. The minima are combined before
    the shuffle, which keeps a node of many edges cheap. Rounds are written to
    the shared folder, and the driver sees only whether a label changed. Edges
    counted as ``SMALL`` or fewer spare the rounds: one task joins them.
    """
    scratch = Scratch(edges.sparkSession, label)
    edges = scratch.write(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), "links")
    if edges.count() <= SMALL:
        return scratch.write(_at_once(edges), "labels")
    both = scratch.write(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"), "labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels["node"] == near["u"]).select("node", "comp", F.least("comp", "near").alias("low"))
        root = labels.select(F.col("node").alias("r"), F.col("comp").alias("up"))
        moved = low.join(root, low["low"] == root["r"], "left").select("node", F.least("low", F.coalesce("up", "low")).alias("comp"), (F.least("low", F.coalesce("up", "low")) < F.col("comp")).alias("changed"))
        moved = scratch.write(moved, f"labels{step}")
        scratch.drop(f"labels{step - 1}")
        labels = moved.select("node", "comp")
        if not moved.where("changed").limit(1).count():
            return labels
