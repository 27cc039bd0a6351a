"""Records as they are stored, shown and answered with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# The Telugu words for chapter and verse in a long citation.
CHAPTER_TE, VERSE_TE = "అధ్యాయము", "శ్లోకము"


@dataclass(frozen=True)
class Work:
    """What a work's records say of it; ``dotted`` chooses the citation style."""

    prefix: str
    work: str
    work_te: str
    book_te: str = ""
    dotted: bool = False
    edition: str = ""
    source: str = ""
    license: str = ""


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def verse_id(prefix: Column, book: Column, chapter: Column, n: Column, suffix: Column) -> Column:
    """prefix-book-chapter-verse and the suffix, if there is one."""
    return F.concat(F.concat_ws("-", prefix, *[c.cast("string") for c in (book, chapter, n)]), F.coalesce(suffix, F.lit("")))


def book_name(w: Work, book: Column) -> Column:
    return _text(w.book_te + " ", book.cast("string")) if w.book_te else F.lit("")


def citations(w: Work, book: Column, chapter: Column, n: Column, suffix: Column) -> tuple[Column, Column]:
    """(Telugu, English): 'Work 1.2.3', or with the names of book, chapter and verse."""
    b, c, v = (x.cast("string") for x in (book, chapter, n))
    s = F.coalesce(suffix, F.lit(""))
    if w.dotted:
        return _text(w.work_te + " ", b, ".", c, ".", v, s), _text(w.work + " ", b, ".", c, ".", v, s)
    with_book = _text(book_name(w, book), ", ") if w.book_te else F.lit("")
    return _text(w.work_te + ", ", with_book, CHAPTER_TE + " ", c, ", " + VERSE_TE + " ", v, s), _text(w.work + " ", _text(b, ".") if w.book_te else "", c, ".", v, s)


def chapter_citation(w: Work, book: Column, chapter: Column) -> Column:
    with_book = _text(book_name(w, book), ", ") if w.book_te else F.lit("")
    return _text(w.work_te + ", ", with_book, CHAPTER_TE + " ", chapter.cast("string"))


def verse_records(verses: DataFrame, w: Work) -> DataFrame:
    """The 24 columns of a stored verse, from (book, chapter, n, suffix, text, speaker, url); all else of ``verses`` stays in front."""
    book, chapter, n, suffix = (F.col(c) for c in ("book", "chapter", "n", "suffix"))
    te, en = citations(w, book, chapter, n, suffix)
    none = F.lit(None).cast("string")
    ref = _text(w.prefix + "_", book.cast("string"), ".", chapter.cast("string"), ".", n.cast("string"), F.coalesce(suffix, F.lit("")))
    new = {
        "id": verse_id(F.lit(w.prefix), book, chapter, n, suffix), "text_type": F.lit("verse"), "work": F.lit(w.work), "work_te": F.lit(w.work_te), "edition": F.lit(w.edition),
        "book_no": book.cast("string"), "book_te": book_name(w, book), "adhyaya_no": chapter.cast("string"), "verse_no": n.cast("bigint"), "verse_suffix": suffix,
        "citation_te": te, "citation_en": en, "speaker_iast": X.iast(F.col("speaker")), "speaker_te": X.telugu(F.col("speaker")),
        "sloka_iast": X.iast(F.col("text")), "sloka_te_script": X.telugu(F.col("text")), "sloka_devanagari": F.col("text"),
        "gretil_flag_star": F.lit(False), "tatparyam_te": none, "tatparyam_status": none, "source": F.lit(w.source), "source_ref": ref, "source_url": F.col("url"), "license": F.lit(w.license),
    }
    taken = {"book", "chapter", "n", "suffix", "text", "speaker", "url"} | set(new)
    return verses.select(*[c for c in verses.columns if c not in taken], *[c.alias(name) for name, c in new.items()])


def manifests(records: DataFrame, w: Work, order: list[str]) -> DataFrame:
    """One row for each chapter of ``records``: count, ids in order, distinct speakers, source."""
    first = F.struct(*order)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(*order, "id"))), lambda x: x["id"])
    rows = records.groupBy("book_no", "adhyaya_no").agg(F.count(F.lit(1)).cast("int").alias("n_verses"), ids.alias("verse_ids"), F.sort_array(F.collect_set("speaker_iast")).alias("speakers"), F.min_by("source_url", first).alias("source_url"))
    book, chapter = F.col("book_no"), F.col("adhyaya_no")
    return rows.select(_text(w.prefix + "-", book, "-", chapter).alias("adhyaya_id"), F.lit(w.work).alias("work"), F.lit(w.work_te).alias("work_te"), book, chapter, "n_verses", chapter_citation(w, book, chapter).alias("citation_te"), "verse_ids", "speakers", "source_url")


def _joined(c: Column) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")


def card_text(card: Column, evaluation: bool = False) -> Column:
    """What of a card the lexical index reads; the offline evaluation leaves out vows, and does not normalise."""
    one = lambda f: F.coalesce(card[f], F.lit(""))
    names = F.transform(card["entities"], lambda e: e["name_te"])
    vows = [] if evaluation else [_joined(card["vratas_tithis_te"])]
    out = F.concat_ws(" ", one("title_te"), one("summary_te"), one("moral_te"), _joined(card["key_events_te"]), _joined(card["questions_te"]), _joined(card["themes_te"]), *vows, _joined(names))
    return out if evaluation else X.norm(out)


def rerank_text(card: Column) -> Column:
    """What of a card a cross-encoder reads beside the question."""
    return X.norm(F.concat_ws(" ", F.coalesce(card["title_te"], F.lit("")), F.coalesce(card["summary_te"], F.lit("")), _joined(card["questions_te"])))


def passages(selected: DataFrame, total: str = "n_verses") -> DataFrame:
    """Verses that go to a model, from selected verses with their card's title and their chapter's ``total``.

    A speaker may be missing; ``chapter_truncated`` says that the chapter has more verses than were selected.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "adhyaya_id"))
    return selected.select("query_id", "rank", "pos", "id", "adhyaya_id", "work", "citation_te", F.col("sloka_te_script").alias("sloka_te"), "sloka_iast", "speaker_te", "source_url", F.col("title_te").alias("chapter_title_te"), (n < F.col(total)).alias("chapter_truncated"))


def _listed(rows: DataFrame, by: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_{o}") for o in order], F.struct(*fields).alias("r"))))
    return rows.groupBy(by).agg(F.transform(cells, lambda x: x["r"]).alias(name))


def search_response(queries: DataFrame, chapters: DataFrame, verses: DataFrame, chapter_fields: list[str], verse_fields: list[str]) -> DataFrame:
    """(query_id, query_te, chapters, passages) of every query: what a search without an answer returns.

    ``chapters`` (query_id, rank, ...) and ``verses`` (query_id, rank, pos, ...) come in their order; both lists may be empty.
    """
    a = _listed(chapters, "query_id", ["rank"], chapter_fields, "chapters")
    b = _listed(verses, "query_id", ["rank", "pos"], verse_fields, "passages")
    out = queries.select("query_id", X.strip(F.coalesce("text", F.lit(""))).alias("query_te")).join(a, "query_id", "left").join(b, "query_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("query_id", "query_te", empty("chapters"), empty("passages"))


def ranked_json(asked: DataFrame, ranking: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, json): question, route, works and the ranked documents of every query, for evaluations."""
    met = asked.join(_listed(ranking, "query_id", ["rank"], fields, "ranked"), "query_id", "left")
    ranked = F.coalesce("ranked", F.array().cast(met.schema["ranked"].dataType)).alias("ranked")
    return met.select("query_id", F.to_json(F.struct("question_norm", "route", "works", "query", ranked)).alias("json"))


def header(manifest: DataFrame) -> DataFrame:
    """(adhyaya_id, header): a chapter's fields as JSON and the speakers seen in it, to print above its verses."""
    head = F.to_json(F.struct("adhyaya_id", "work", "work_te", "book_no", "adhyaya_no", "n_verses", "citation_te"))
    who = F.when(F.size("speakers") > 0, F.array_join("speakers", ", ")).otherwise("none marked")
    return manifest.select("adhyaya_id", F.concat(head, F.lit("\nspeakers: "), who).alias("header"))


def rendered(answers: DataFrame) -> DataFrame:
    """(query_id, answer, citations, chapters): Markdown of answered questions.

    ``answers`` has citations (citation_te, sloka_te, tatparyam_te), cards (citation_te, title_te), route, works, n_ok and n_failed.
    """
    cites = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("**"), c["citation_te"], F.lit("**  \n"), c["sloka_te"], F.lit("  \n_"), c["tatparyam_te"], F.lit("_"))), "\n\n")
    works = F.when(F.size("works") > 0, F.array_join("works", ", ")).otherwise("all")
    meta = F.concat(F.lit("route: "), F.coalesce("route", F.lit("")), F.lit(" · works: "), works, F.lit(" · citations verified "), F.col("n_ok").cast("string"), F.lit(", dropped "), F.col("n_failed").cast("string"))
    lines = F.array_join(F.transform("cards", lambda c: F.concat(F.lit("- "), c["citation_te"], F.lit(" — "), c["title_te"])), "\n")
    return answers.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.concat(cites, F.lit("\n\n---\n"), meta).alias("citations"), lines.alias("chapters"))
