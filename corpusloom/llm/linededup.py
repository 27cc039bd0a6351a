"""Line dedup across documents, with DataFrame functions only.

Lines are compared by a key: the line without ``[\\x20\\x09-\\x0D]`` at both ends,
A-Z lower-cased. A key found in at least ``min_docs`` documents loses all its
lines everywhere. Keys travel as MD5 digests.

Each line is hashed once, with its number. Keys on fewer lines than ``min_docs``
end at a count that is combined before the shuffle, so that a key in every
document costs one row a task; the lines of the others are counted by document.
The numbers of the lines that go then meet their text, in a join that adaptive
execution splits where a key is hot. A text is put together again from the pieces
between those lines, which takes time in proportion to its lines.

Null and empty texts are one empty line, which has no key and stays. Rows of one
id are one document, whatever their texts; rows without an id are a document for
each distinct text. So a line repeated in one document, or in repeated rows,
counts once. Very long texts are one row's work. An empty table gives an empty
result. Extra columns are carried by ``drop_frequent_lines`` and
``without_frequent_lines`` under their own names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, own_key, packed

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Characters beyond ASCII that lower() may change.
CASED = r"[\P{ASCII}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def line_key(line: Column) -> Column:
    """The line stripped, A-Z lower-cased; letters beyond ASCII keep their case.

    The general forms, btrim() and translate(), go through a text character by
    character and are used only for lines that need them.
    """
    edge = F.lit(False)
    for c in BLANK:
        edge = edge | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    bare = F.when(edge, F.btrim(line, F.lit(BLANK))).otherwise(line)
    plain = (F.length(bare) == F.octet_length(bare)) | ~F.rlike(bare, F.lit(CASED))
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _digests(text: str, min_key: int) -> Column:
    """A digest for each line, null where the key is too short."""

    def one(line):
        # the key is bound once: the comparison and the digest share it
        return F.get(F.transform(F.array(line_key(line)), lambda k: F.when((F.octet_length(k) if min_key <= 1 else F.length(k)) >= min_key, F.md5(k))), F.lit(0))

    return F.transform(_lines(text), one)


def _dropped(docs: DataFrame, text_col: str, id_col: str, min_docs: int, min_key: int) -> DataFrame:
    """(row, text, n_lines, stay): all other columns, the text, the number of its lines and those that stay."""
    scratch = Scratch(docs.sparkSession, "lines")
    tag = own_key(id_col, text_col)
    lines = docs.select(tag.alias("d"), F.posexplode(_digests(f"`{text_col}`", min_key)).alias("at", "k"))
    keys = scratch.write(lines.where("k is not null"), "keys")
    # stored, so that the joins have an exchange on both sides and a hot key's rows can be split
    often = scratch.write(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("k"), "often")
    found = scratch.write(keys.join(often, "k"), "found")
    scratch.drop("keys")
    unnamed = F.when(F.col("d.i").isNull(), F.struct("d.h", "d.g"))
    per_doc = found.select("k", F.col("d.i").alias("i"), unnamed.alias("u")).groupBy("k", "i", "u").agg(F.lit(1).alias("one"))
    hot = scratch.write(per_doc.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("k"), "hot")
    gone = found.join(hot, "k").groupBy("d").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    rows = docs.select(packed(docs, text_col).alias("row"), tag.alias("d"), F.col(f"`{text_col}`").alias("text"))
    met = rows.join(gone.select(F.col("d").alias("of"), "gone"), F.col("d").eqNullSafe(F.col("of")), "left")
    met = met.select("row", "text", "gone", _lines("text").alias("lines"))
    first = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    end = F.concat("gone", F.array(F.size("lines")))
    pieces = F.zip_with(first, end, lambda a, b: F.slice("lines", a + 1, b - a))
    return met.select("row", "text", F.size("lines").cast("bigint").alias("n_lines"), F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.flatten(pieces)).alias("stay"))


def _text() -> Column:
    return F.when(F.col("n_lines") == F.size("stay"), F.col("text")).otherwise(F.array_join("stay", "\n"))


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """``docs`` with ``text_col`` replaced, and ``n_lines`` and ``n_dropped`` added (where ``docs`` has such names, theirs go)."""
    out = _dropped(docs, text_col, id_col, min_docs, min_key)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    cols = [(_text() if c == text_col else F.col("row")[c]).alias(c) for c in kept]
    return out.select(*cols, "n_lines", (F.col("n_lines") - F.size("stay")).cast("bigint").alias("n_dropped"))


def without_frequent_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """``docs`` with ``text_col`` replaced and no other column changed or added."""
    out = _dropped(docs, text_col, id_col, min_docs, min_key)
    return out.select(*[(_text() if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
