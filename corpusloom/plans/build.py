"""A corpus from wiki pages: verses, records and manifests, aligned to an older edition of the same work.

Pages are (title, text); every step is a DataFrame of all pages of a work at once. Books and
chapters are text from here on, as a chapter may be '12w'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, parse, records, select, sequence
from ..sources.tables import stored

# How a page title names a chapter by number, and the word in a title that spells it.
BY_NUMBER = r"^(?:अध्याय(?:ाः|ः|:)?|सर्गः?)\s*-?\s*"
SPELLED = "ध्याय"


@dataclass(frozen=True)
class Source:
    """Where a work's pages are: the prefix of their titles, and the books that segments of a title name.

    ``books`` None means a work of one book, whose pages have no segment before the last.
    """

    prefix: str
    books: dict[str, str] | None = None
    chapters: tuple[int, int] | None = None


def chapter_pages(pages: DataFrame, source: Source) -> DataFrame:
    """(book, chapter, title, text): the page of each chapter. Plain numbers win over spelled ones, then the longest text, then the title."""
    title = X.norm(F.col("title"), joiners=True)
    rest = pages.select("title", F.coalesce("text", F.lit("")).alias("text"), title.alias("t")).where(F.startswith("t", F.lit(source.prefix)))
    parts = rest.withColumn("s", F.transform(F.split(F.substr("t", F.lit(len(source.prefix) + 1)), "/"), X.strip))
    last, before = F.element_at("s", -1), F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), "/")
    if source.books is None:
        book = F.when(before == "", "1")
    else:
        book = F.create_map(*[F.lit(x) for kv in source.books.items() for x in kv])[before]
    digits = F.regexp_extract(last, rf"(?U){BY_NUMBER}([{X.INDIC_DIGITS}0-9]+)$", 1)
    number = F.when(digits != "", X.number(digits))
    spelled = F.when(F.contains(last, F.lit(SPELLED)), X.ordinal(last))
    found = parts.select("title", "text", book.alias("book"), F.coalesce(number, spelled).cast("bigint").alias("chapter"), F.when(number.isNull(), 1).otherwise(0).alias("rank"), F.length("text").alias("size")).where("book is not null and chapter is not null")
    if source.chapters:
        found = found.where(F.col("chapter").between(*source.chapters))
    return parse.best_page(found, ["book", "chapter"], "rank", "size", "title").select("book", "chapter", "title", "text")


def page_url(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), X.url_title(F.replace(X.norm(title, joiners=True), F.lit(" "), F.lit("_"))))


def page_verses(pages: DataFrame) -> DataFrame:
    """(book, chapter, pos, n, suffix, text, speaker) of every page, whether a table of half verses or marked lines."""
    keyed = pages.withColumn("page", F.struct("book", "chapter"))
    is_table = F.contains("text", F.lit("<td>"))
    marked = parse.split_marked(keyed.where(~is_table).select("page", X.clean_wikitext(F.col("text")).alias("text")), "page", "text").select("page", "pos", "n", "suffix", "text", "speaker")
    table = parse.split_table(keyed.where(is_table).select("page", "text"), "page", "text").select("page", F.col("pos").cast("bigint").alias("pos"), "n", F.lit(None).cast("string").alias("suffix"), "text", "speaker")
    return marked.unionByName(table).select("page.book", "page.chapter", "pos", "n", "suffix", "text", "speaker")


def renumbered(pages: DataFrame, chapter_map: DataFrame | None) -> DataFrame:
    """Pages under the chapters that a map (new_book, new_ch, old_book, old_ch) gives them.

    A chapter without a place whose number now belongs to another is parked under '<n>w', so that no text is lost.
    """
    plain = pages.withColumn("chapter", F.col("chapter").cast("string"))
    if chapter_map is None:
        return plain
    to = chapter_map.select(F.col("new_book").alias("book"), F.col("new_ch").cast("string").alias("chapter"), F.col("old_book").alias("_b"), F.col("old_ch").cast("string").alias("_c"))
    owned = chapter_map.select(F.col("old_book").alias("book"), F.col("old_ch").cast("string").alias("chapter"), F.lit(True).alias("_owned")).distinct()
    met = plain.join(to, ["book", "chapter"], "left").join(owned, ["book", "chapter"], "left")
    chapter = F.when(F.col("_c").isNotNull(), F.col("_c")).when(F.col("_owned"), F.concat("chapter", F.lit("w"))).otherwise(F.col("chapter"))
    return met.withColumn("_n", chapter).withColumn("book", F.coalesce("_b", "book")).withColumn("chapter", F.col("_n")).drop("_b", "_c", "_owned", "_n")


def numbered(verses: DataFrame) -> DataFrame:
    """Verses of one numbering a chapter: repaired, of the chosen run, halves joined, repeats dropped or told apart by a suffix."""
    keys = ["book", "chapter"]
    fixed = sequence.repair_numbers(verses, keys, ["pos"], "n")
    run = sequence.keep_run(fixed, keys, ["pos"], "n").drop("run")
    merged = sequence.merge_islands(run, keys, ["pos"], ["n", "suffix"], "text", count="pieces").drop("island", "pieces")
    tagged = merged.withColumn("tag", F.coalesce("suffix", F.lit(""))).drop("suffix")
    once = sequence.suffix_duplicates(tagged, [*keys, "n", "tag"], ["pos"], "text")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    return once.select(*keys, pos.cast("bigint").alias("pos"), "n", F.nullif(F.concat("tag", "suffix"), F.lit("")).alias("suffix"), "text", "speaker")


def parked(rows: DataFrame) -> DataFrame:
    """Records whose id another record owns by the verse map, or that an earlier record has, get '-w', '-w2', ...

    ``rows`` have ``id``, ``mapped`` (whether the id is a map's) and ``order``; a mapped record keeps its id first.
    """
    w = Window.partitionBy("id").orderBy(F.desc(F.col("mapped").cast("int")), "order")
    k = F.row_number().over(w)
    suffix = F.when(k == 1, "").when(k == 2, "-w").otherwise(F.concat(F.lit("-w"), (k - 1).cast("string")))
    return rows.withColumn("_s", suffix).withColumn("id", F.concat("id", "_s")).withColumn("suffix", F.nullif(F.concat(F.coalesce("suffix", F.lit("")), "_s"), F.lit(""))).drop("_s")


def apply_verse_map(verses: DataFrame, verse_map: DataFrame, w: records.Work) -> DataFrame:
    """Verses under the ids that a verse map assigns; pieces in a row of one id are joined, collisions parked."""
    keyed = verses.withColumn("vid", records.verse_id(F.lit(w.prefix), F.col("book"), F.col("chapter"), F.col("n"), F.col("suffix")))
    cut = align.cut_records(keyed.select(F.struct("book", "chapter").alias("chapter"), F.col("pos").alias("i"), "text"), verse_map.select(F.struct("book", "chapter").alias("chapter"), "i", "old_vid", "how", "start", "end"))
    cut = cut.select("chapter.book", "chapter.chapter", F.col("i").alias("pos"), "part", "target", "text")
    met = cut.join(keyed.drop("text"), ["book", "chapter", "pos"]).withColumn("own", F.coalesce("target", F.concat_ws("#", "vid", F.col("part").cast("string"))))
    joined = sequence.merge_islands(met, ["book", "chapter"], ["pos", "part"], ["own"], "text", count="pieces")
    p = parse.parse_verse_id(F.col("target"))
    hit = F.coalesce(p["verse"] != "", F.lit(False))
    mine = lambda part, own: F.when(hit, part).otherwise(own)
    order = F.struct("book", "chapter", "pos", "part").alias("order")
    named = joined.select(mine(p["book"], F.col("book")).alias("book"), mine(p["chapter"], F.col("chapter")).alias("chapter"), mine(p["verse"].try_cast("bigint"), F.col("n")).alias("n"), mine(F.nullif(p["suffix"], F.lit("")), F.col("suffix")).alias("suffix"), "text", "speaker", hit.alias("mapped"), F.when(hit, F.col("target")).otherwise(F.col("vid")).alias("id"), order)
    return parked(named).drop("id", "mapped")


def build(pages: DataFrame, w: records.Work, base_url: str = "", chapter_map: DataFrame | None = None, verse_map: DataFrame | None = None, claimed: DataFrame | None = None, drop_unmatched: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, manifests) of resolved pages (book, chapter, title, text).

    ``claimed`` (book, chapter) are chapters that belong to another work; with ``drop_unmatched`` only chapters
    that the map has a place for stay.
    """
    rows = pages.withColumn("chapter", F.col("chapter").cast("string"))
    if claimed is not None:
        rows = select.unclaimed(rows, claimed, ["book", "chapter"])
    if chapter_map is not None and drop_unmatched:
        rows = select.mapped_only(rows, chapter_map.select(F.col("new_book").alias("book"), F.col("new_ch").cast("string").alias("chapter")), ["book", "chapter"])
    rows = stored(renumbered(rows, chapter_map), "pages")
    verses = stored(numbered(page_verses(rows)), "verses")
    if verse_map is not None:
        verses = apply_verse_map(verses, verse_map, w)
    else:
        verses = verses.withColumn("order", F.struct("book", "chapter", "pos", F.lit(0).alias("part"))).drop("pos")
    url = rows.select("book", "chapter", page_url(F.col("title"), base_url).alias("url"))
    out = records.verse_records(verses.join(url, ["book", "chapter"], "left"), w)
    return out, records.manifests(out, w, ["order"])


def sides(rec: DataFrame) -> DataFrame:
    """(work, book, ch, chapter, pos, vid, text, grams) of records, as the alignments want them; parked chapters have no number."""
    pos = F.row_number().over(Window.partitionBy("book_no", "adhyaya_no").orderBy("order")) - 1
    return rec.select("work", F.col("book_no").alias("book"), F.col("adhyaya_no").try_cast("bigint").alias("ch"), F.concat_ws("-", "book_no", "adhyaya_no").alias("chapter"), pos.cast("bigint").alias("pos"), F.col("id").alias("vid"), F.col("sloka_devanagari").alias("text"), X.gram_set(F.col("sloka_iast")).alias("grams"))


def flow(pages: DataFrame, old: DataFrame, w: records.Work, source: Source, base_url: str = "") -> dict[str, DataFrame]:
    """Build on the pages' own numbering, align to ``old`` records, build again, match verses, build again, reconcile.

    ``old`` has the columns of records and ``order``. Returns records, manifests, chapter_map, verse_map and reconciled.
    """
    found = stored(chapter_pages(pages, source), "chapters")
    theirs = stored(sides(old), "old")
    first, _ = build(found, w, base_url)
    chapters = stored(align.chapter_map(sides(first).where("ch is not null"), theirs.where("ch is not null")), "chaptermap")
    second, _ = build(found, w, base_url, chapters)
    ours = stored(sides(second), "new")
    matched = stored(align.verse_map(ours, theirs), "versemap")
    by_place = matched.select(F.split("chapter", "-")[0].alias("book"), F.split("chapter", "-")[1].alias("chapter"), "i", "old_vid", "how", "start", "end")
    third, manifest = build(found, w, base_url, chapters, by_place)
    third = stored(third, "records")
    count = lambda d: d.groupBy(F.concat_ws("-", "book_no", "adhyaya_no").alias("chapter")).agg(F.count(F.lit(1)).alias("n"))
    return {"records": third, "manifests": manifest, "chapter_map": chapters, "verse_map": matched, "reconciled": align.reconciled(count(old), count(third), "chapter")}
