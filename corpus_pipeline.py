"""Documents to packed sequences, in five stages.

Each stage gets what its predecessor wrote and returns a DataFrame; all but the
last return the columns of ``documents``, with ``text`` (and ``n_chars``, where there
is one) as changed, and any further columns as they were, whatever their names.

Null and empty texts fail the quality rules and go there; a later stage that meets
one keeps it as it is. A row without an id is a document like any other. Repeated
rows (equal id and text) are one document in near dedup and stay or go together.
Very long texts are one row's work in every stage. Ties go to the least id, then the
least hash of the text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bagminhash, linededup, packing, quality_rules, substring
from corpusloom.llm._shared import Scratch, released
from corpusloom.llm.queries import REPEATS, table, vocabulary

#: Rows of an Arrow batch while run() makes a stage: stages carry whole texts to Python and back.
ROWS = 1000


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of characters as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.select(*[(F.length("text").cast(kind) if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are rejected."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a text may become empty, and its row stays."""
    return _counted(linededup.without_frequent_lines(docs, min_docs=10))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays; texts without a word are no copies of each other."""
    return bagminhash.keep_one(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; rows stay."""
    return _counted(substring.without_repeats(docs, **REPEATS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a null or empty text is a document of the end id alone."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", drop_poor), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("packing", pack)]

#: Trees, signatures and a tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread; what a stage stored for itself goes with its end."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with released(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}", batch=ROWS)
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
