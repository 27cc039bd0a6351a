"""Substring dedup by hashing of lines, paragraphs, and phrases.

Units are normalised to their words (A-Z lower-cased, white space apart) and their
digests are grouped over all documents; the earliest occurrence by (id, position)
stays and the others go, with their code-point ranges in the original text.

* ``line``: each line with a word; ``paragraph``: lines in a row between blank ones.
  An equal line or paragraph of at least ``min_words`` words goes with its line
  break, whole and alone. This is the method by itself, and the default, with a
  least size of one word.
* ``phrase``: passages repeat in the middle of lines and sentences too, where whole
  lines would miss them. Phrases end with their sentence or line, and also after
  the word that with the word before it has the least digest of ``REACH`` words in a
  row. Where a phrase ends so depends on the ``REACH`` words before and after it
  alone, and some phrase ends in any ``REACH`` words: so of a repeated passage of
  ``min_run`` + 2 * ``REACH`` + 1 words at least ``min_run`` go. Phrases of fewer than
  ``SHORT`` words are compared with the words before them, ``AROUND`` in all, so that
  a column of figures is no repeat because each of them occurs elsewhere. Phrases go
  where at least ``min_run`` words of them stand in a row, so that a short formula
  shared by clean documents stays. Scripts written without spaces have each of
  their code points as a word, of which two (or four, of alphabetic scripts) count
  as one.

The earliest occurrence of each digest is an aggregation combined before the
shuffle; digests that occur once end there. The others meet their units again in
a join that adaptive execution splits where a digest is hot. A document's repeated
units, which are at most its own, then meet its text.

Digests are 128 bits for lines and paragraphs. They are 64 for phrases, of which
several in a row, or one of ``min_run`` words, must be equal.

A document is told from another by its id and its text: rows of one id with
different texts follow one another by a hash of the text, rows equal in both are one
document and are treated alike. Rows without an id come last, by a hash of the text.
Null and empty texts have no unit and stay as they are. Very long texts are one
row's work. An empty table gives no rows. Extra columns are carried by
``drop_repeats`` and ``without_repeats`` under their own names, whatever these are.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrow
from ._shared import Scratch, packed

#: Words in a row of which one ends a phrase.
REACH = 12

#: Units of fewer words are compared with the words before them, so many in all.
SHORT, AROUND = 4, 8

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_FACTOR = np.uint64(0xD6E8FEB86659FD93)

#: Quarter words that a code point counts from here on; 0 where words have spaces.
_SCRIPTS = np.array(
    [(0, 0), (0x0E00, 1), (0x10A0, 0), (0x1780, 1), (0x1800, 0), (0x1950, 1), (0x1A00, 0), (0x1A20, 1), (0x1AB0, 0), (0x2E80, 2), (0x3130, 0), (0x3190, 2), (0xA4D0, 0), (0xA9E0, 1), (0xAA00, 0), (0xAA60, 1), (0xAAE0, 0), (0xF900, 2), (0xFB00, 0), (0xFF01, 2), (0xFFA0, 0), (0x20000, 2), (0x40000, 0)]
)


def _spaceless(words: _arrow.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and quarter words of each word, code points of scripts without spaces apart."""
    buf, start, end = words.buf, words.start, words.end
    lead = np.flatnonzero(buf >= 0xE0)
    wide = np.where(buf[lead] >= 0xF0, 4, 3)
    byte = [buf[lead + k].astype(np.int64) & 63 for k in range(3)]
    point = np.where(wide == 3, (byte[0] & 15) << 12 | byte[1] << 6 | byte[2], (byte[0] & 7) << 18 | byte[1] << 12 | byte[2] << 6)
    quarters = _SCRIPTS[np.searchsorted(_SCRIPTS[:, 0], point, "right") - 1, 1]
    lead, wide, quarters = lead[quarters > 0], wide[quarters > 0], quarters[quarters > 0]
    if not len(lead):
        return start, end, np.full(len(start), 4)
    start = np.union1d(start, np.concatenate([lead, (after := lead + wide)[np.append(words.ink, False)[after]]]))
    end = np.union1d(end, np.concatenate([after, lead[(lead > 0) & words.ink[lead - 1]]]))
    size = np.full(len(start), 4)
    size[np.searchsorted(start, lead)] = quarters
    return start, end, size


def _slide(best: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The least or greatest of every ``REACH`` values in a row."""
    size = 1
    while size < REACH:
        step = min(size, REACH - size)
        values = best(values[:-step], values[step:])
        size += step
    return values


class Phrases:
    """Phrases of all documents: document, number in it, words and their quarters, digest, byte range."""

    def __init__(self, words: _arrow.Words, h: np.ndarray):
        buf, off = words.buf, words.off
        start, end, quarters = _spaceless(words)
        if len(start) != len(words.start):
            words = copy(words)
            words.start, words.end = start, end
            words.doc = np.searchsorted(off, words.start, "right") - 1
            h = words.hashes(lower=True)
        self.docs, n = words.docs, len(words.start)
        if not n:
            self.doc = self.pos = self.size = self.quarters = self.start = self.end = np.zeros(0, np.int64)
            self.digest, self.fresh = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        feeds = np.concatenate([[0], np.cumsum(buf == 10)])
        hard = np.ones(n, bool)  # the line or the document ends after this word
        hard[:-1] = (words.doc[1:] != words.doc[:-1]) | (feeds[words.start[1:]] > feeds[words.end[:-1]])
        sentence = hard | _STOP[buf[words.end - 1]]
        pair = np.full(n, ~np.uint64(0))
        pair[1:] = _arrow.mix(h[:-1] * _FACTOR + h[1:]) | np.uint64(1)
        pair[1:][sentence[:-1]] = ~np.uint64(0)  # the word before must be of the same sentence, so of the same document
        pair[sentence] = 0  # least of any window: none reaches past the end of a sentence or a document
        edge = np.zeros(REACH - 1, np.uint64)
        least = _slide(np.minimum, np.concatenate([edge, pair, edge]))
        last = np.flatnonzero(pair == _slide(np.maximum, least))  # the least of some window that it is in
        first = np.concatenate([[0], last[:-1] + 1])
        self.doc, self.size = words.doc[first], last - first + 1
        self.quarters = np.add.reduceat(quarters, first)
        self.start, self.end = words.start[first], words.end[last]
        self.fresh = np.concatenate([[True], hard[last[:-1]]])  # begins a line
        # hashed by distance from the unit's end: the factors are bounded by the longest unit
        back = np.repeat(last, self.size) - np.arange(n)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(self.size.max()), _FACTOR)]))
        total = np.add.reduceat(h * power[back], first) + self.size.astype(np.uint64)
        short = np.flatnonzero(self.size < SHORT)
        at, around = last[short], np.zeros(len(short), np.uint64)
        for k in range(AROUND - 1, -1, -1):
            inside = words.doc[np.maximum(at - k, 0)] == words.doc[at]
            around = _arrow.mix(around * _FACTOR + np.where(inside & (at >= k), h[np.maximum(at - k, 0)], np.uint64(0)))
        total[short] += around
        self.digest = _arrow.mix(total)
        begin = np.searchsorted(self.doc, np.arange(self.docs))
        self.pos = np.arange(len(self.doc)) - begin[self.doc]


_LINE, _PARAGRAPH = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Lines:
    """Lines, or paragraphs, with a word: document, number in it, words, two digests, byte range with the line break."""

    def __init__(self, words: _arrow.Words, h: np.ndarray, paragraph: bool):
        buf, off = words.buf, words.off
        feed = np.flatnonzero(buf == 10)
        # a text's end bounds its last line; empty texts have no words and so no line
        line_end = np.unique(np.concatenate([feed + 1, off[1:]]))
        line = np.searchsorted(line_end, words.start, "right")  # of each word
        new = np.ones(len(line), bool)
        gap = 2 if paragraph else 1
        new[1:] = (line[1:] - line[:-1] >= gap) | (words.doc[1:] != words.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(line)) - 1 if len(first) else first
        self.doc, self.size = words.doc[first], last - first + 1
        begin = np.concatenate([[0], line_end])
        self.start, self.end = begin[line[first]], line_end[line[last]]
        self.pos = np.arange(len(first)) - np.searchsorted(self.doc, np.arange(words.docs))[self.doc]
        self.digest = self.more = np.zeros(0, np.uint64)
        if len(first):
            kind = _PARAGRAPH if paragraph else _LINE
            place = np.arange(len(h), dtype=np.uint64) - np.repeat(first, self.size).astype(np.uint64)
            halves = [np.add.reduceat(_arrow.mix(_arrow.mix(h + salt) ^ (place * _FACTOR + salt)), first) for salt in (kind, ~kind)]
            self.digest, self.more = (_arrow.mix(x + self.size.astype(np.uint64)) for x in halves)


KINDS = ("line", "paragraph", "phrase")


def _found(kinds: tuple[str, ...], buf: np.ndarray, off: np.ndarray) -> list[tuple[str, Phrases | Lines]]:
    """The units of each kind, from words that are found and hashed once."""
    words = _arrow.Words(buf, off)
    h = words.hashes(lower=True)
    return [(kind, Phrases(words, h) if kind == "phrase" else Lines(words, h, kind == "paragraph")) for kind in kinds]


def _place(kind: str, pos: np.ndarray) -> np.ndarray:
    """The number of a unit in its document, of whatever kind."""
    return pos * len(KINDS) + KINDS.index(kind)


def _key(id_col: str, text_col: str) -> list[Column]:
    """What tells one document from another, in order: rows without an id last."""
    i, t = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    return [i.isNull().alias("z"), F.coalesce(i, F.xxhash64(t)).alias("i"), F.hash(t).alias("t")]


def units(docs: DataFrame, kinds: tuple[str, ...], min_words: int) -> DataFrame:
    """(z, i, at, digest, more) of every unit of (z, i, t, text); ``at`` is ``t`` and the unit's number in one."""

    def run(batches):
        for batch in batches:
            salt = batch.column(2).to_numpy().astype(np.int64) << 32
            for first, end, buf, off in _arrow.chunks(batch.column(3)):
                for kind, u in _found(kinds, buf, off):
                    ok = np.ones(len(u.doc), bool) if kind == "phrase" else u.size >= min_words
                    doc = u.doc[ok]
                    more = np.zeros(len(doc), np.int64) if kind == "phrase" else u.more[ok].astype(np.int64)
                    row = pa.array(doc + first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(salt[doc + first] + _place(kind, u.pos[ok])), pa.array(u.digest[ok].astype(np.int64)), pa.array(more)], ["z", "i", "at", "digest", "more"])

    return docs.select("z", "i", "t", "text").mapInArrow(_arrow.tidy(run), "z boolean, i bigint, at bigint, digest bigint, more bigint")


def repeated(docs: DataFrame, kinds: tuple[str, ...], min_words: int) -> DataFrame:
    """(z, i, t, later array<int>): the units of each document of (z, i, t, text) that occur earlier."""
    scratch = Scratch(docs.sparkSession, "units")
    all_units = scratch.write(units(docs, kinds, min_words), "units", batch=2000)
    rank = F.struct("z", "i", "at")
    earliest = all_units.groupBy("digest", "more").agg(F.min(rank).alias("a"), F.max(rank).alias("b")).where("a != b").select("digest", "more", "a")
    earliest = scratch.write(earliest, "earliest")  # so that a hot digest's units can be split in the join
    met = all_units.join(earliest, ["digest", "more"]).where(rank != F.col("a"))
    at = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")
    return met.select("z", "i", F.shiftright("at", 32).cast("int").alias("t"), at).groupBy("z", "i", "t").agg(F.collect_set("at").alias("later"))


def _cut(found: list[tuple[str, Phrases | Lines]], i: int, later: np.ndarray, buf: np.ndarray, off: np.ndarray, min_run: int) -> list[tuple[int, int]]:
    """Byte ranges to remove from document ``i``, ascending and apart."""
    out: list[tuple[int, int]] = []
    for kind, u in found:
        a, b = np.searchsorted(u.doc, [i, i + 1])
        hit = a + np.flatnonzero(np.isin(_place(kind, u.pos[a:b]), later))
        if kind != "phrase":
            out.extend(zip(u.start[hit].tolist(), u.end[hit].tolist(), strict=True))
            continue
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
            if len(run) and u.quarters[run[0] : run[-1] + 1].sum() >= 4 * min_run:
                start, end = int(u.start[run[0]]), int(u.end[run[-1]])
                after = int(u.start[run[-1] + 1]) if run[-1] + 1 < b else int(off[i + 1])
                # the line break after a range stays, unless the range has its lines to itself
                if u.fresh[run[0]] or 10 not in buf[end:after]:
                    end = after
                out.append((start, end))
    joined: list[tuple[int, int]] = []
    for start, end in sorted(out):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def _dropped(docs: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...], min_words: int, min_run: int) -> DataFrame:
    """(row, text, removed, n_removed): all other columns of each row, what is left of its text, and what is not."""
    if not kinds or set(kinds) - set(KINDS):
        raise ValueError(f"units are some of {KINDS}")
    key = _key(id_col, text_col)
    later = repeated(docs.select(*key, F.col(f"`{text_col}`").alias("text")), kinds, min_words)
    rows = docs.select(packed(docs, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"), *key)
    met = rows.join(later, ["z", "i", "t"], "left").select("row", "text", "later")

    def run(batches):
        for batch in batches:
            text, removed = [], []
            flags = batch.column(2)
            for first, end, buf, off in _arrow.chunks(batch.column(1)):
                some = np.flatnonzero(flags.slice(first, end - first).is_valid().to_numpy(zero_copy_only=False))
                # units of the texts that have repeats, side by side
                size = np.diff(off)[some]
                base = np.concatenate([[0], np.cumsum(size)])
                mine = np.concatenate([buf[off[i] : off[i + 1]] for i in some]) if len(some) else buf[:0]
                found = _found(kinds, mine, base) if len(some) else []
                row = dict(zip(some.tolist(), range(len(some)), strict=True))
                data = buf.tobytes()
                for i in range(end - first):
                    own = data[off[i] : off[i + 1]]
                    spans: list = []
                    if i in row:
                        at, parts, k = 0, [], row[i]
                        for s, e in _cut(found, k, flags[first + i].values.to_numpy(), mine, base, min_run):
                            s, e = s - int(base[k]), e - int(base[k])
                            parts.append(own[at:s])
                            start = (spans[-1]["end"] if spans else 0) + len(own[at:s].decode())
                            spans.append({"start": start, "end": start + len(own[s:e].decode())})
                            at = e
                        own = b"".join(parts) + own[at:] if spans else own
                    text.append(own.decode())
                    removed.append(spans)
            null = batch.column(1).is_null().to_pylist()
            text = [None if z else t for t, z in zip(text, null, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([len(x) for x in removed], pa.int64())], ["row", "text", "removed", "n_removed"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(span)), T.StructField("n_removed", T.LongType())])
    return met.mapInArrow(_arrow.tidy(run), schema)


def drop_repeats(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = ("line", "paragraph"), min_words: int = 1, min_run: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeats removed from the text, and ``removed`` (array of start and end) and ``n_removed`` added (where ``docs`` has such names, theirs go)."""
    out = _dropped(docs, id_col, text_col, kinds, min_words, min_run)
    kept = [c for c in docs.columns if c not in ("removed", "n_removed")]
    return out.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in kept], "removed", "n_removed")


def without_repeats(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = ("line", "paragraph"), min_words: int = 1, min_run: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeats removed from the text and no other column changed or added."""
    out = _dropped(docs, id_col, text_col, kinds, min_words, min_run)
    return out.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
