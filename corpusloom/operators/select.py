"""Which chapters a run is about, and the lookups that bring their verses, cards and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chapters(df: DataFrame, book=None, chapter=None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The chapters of one book, or one chapter, or the first ``limit`` in ``order``; books compare as text."""
    if book is not None:
        df = df.where(F.col("book_no").cast("string") == str(book))
    if chapter is not None:
        df = df.where(F.col("adhyaya_no").cast("string") == str(chapter))
    return df if limit is None else df.orderBy(*(order or ["book_no", "adhyaya_no"])).limit(limit)


def of_works(df: DataFrame, specs: list[str], work: str = "work", book: str = "book_no") -> DataFrame:
    """The rows of ``specs``: 'work' for all of it, or 'work:2,3' for those books of it."""
    wanted = F.lit(False)
    for spec in specs:
        name, _, books = spec.partition(":")
        one = F.col(work) == name
        wanted = wanted | (one & F.col(book).cast("string").isin(books.split(",")) if books else one)
    return df.where(wanted)


def only_new(df: DataFrame, had: DataFrame, key: str = "adhyaya_id", chapter: str = "adhyaya_no") -> DataFrame:
    """Chapters whose id ``had`` lacks, without those parked as a second copy ('12w')."""
    return df.where(~F.col(chapter).cast("string").endswith("w")).join(had.select(key), key, "left_anti")


def unclaimed(df: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters that no other work's map claims."""
    return df.join(claimed.select(*keys).distinct(), keys, "left_anti")


def mapped_only(df: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters that a map has a place for; the others are dropped."""
    return df.join(mapped.select(*keys).distinct(), keys, "left_semi")


def long_enough(text: Column, least: int = 200) -> Column:
    """Whether a text has more than ``least`` code points."""
    return F.coalesce(F.length(text) > least, F.lit(False))


def verses_of(manifests: DataFrame, verses: DataFrame, ids: str = "verse_ids", key: str = "id") -> DataFrame:
    """The verses of each chapter in the manifest's order: its columns, ``pos`` and the verse's."""
    one = manifests.select(*[c for c in manifests.columns if c != ids], F.posexplode(ids).alias("pos", key))
    return one.join(verses, key)


def with_manifest(cards: DataFrame, manifests: DataFrame, key: str = "adhyaya_id") -> DataFrame:
    """Cards with ``n_verses`` and ``verse_ids`` of their chapter; those of no known chapter are left out."""
    return cards.join(manifests.select(key, "n_verses", "verse_ids"), key)


def with_translation(chapters: DataFrame, english: DataFrame, books: list[str], key: str = "adhyaya_id") -> DataFrame:
    """Chapters with the English text of those in ``books``; null for others and where there is none."""
    side = english.select(F.col(key).alias("_k"), "text_en")
    return chapters.join(side, (F.col(key) == F.col("_k")) & F.col("book_no").cast("string").isin(books), "left").drop("_k")


def in_book_order(df: DataFrame, book: str = "book_no", chapter: str = "adhyaya_no") -> DataFrame:
    """Rows by book, as text, and chapter, as a number."""
    return df.orderBy(F.col(book).cast("string"), F.col(chapter))
