"""Scalar text functions as Spark columns; Python only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal digits of seven Indic scripts, zero to nine each.
INDIC_DIGITS = "०१२३४५६७८९" "೦೧೨೩೪೫೬೭೮೯" "౦౧౨౩౪౫౬౭౮౯" "০১২৩৪৫৬৭৮৯" "૦૧૨૩૪૫૬૭૮૯" "൦൧൨൩൪൫൬൭൮൯" "௦௧௨௩௪௫௬௭௮௯"
JOINERS = "‌‍"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` knows the space alone)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode normal form C; Spark has no such function. ASCII texts are in it already and reach Python as nulls."""
    return F.coalesce(_composed(F.when(F.length(c) < F.octet_length(c), c)), c)


def norm(c: Column, joiners: bool = False) -> Column:
    """NFC, stripped; with ``joiners`` the zero-width (non-)joiners go too. Null gives ''."""
    out = nfc(F.coalesce(c, F.lit("")))
    return strip(F.translate(out, JOINERS, "") if joiners else out)


def number(c: Column) -> Column:
    """A number in any of the seven scripts or ASCII; null if it is none."""
    return F.translate(strip(c), INDIC_DIGITS, "0123456789" * 7).try_cast("bigint")


# The Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(c: Column) -> Column:
    """Subtractive Roman numeral as an integer: a digit counts negative before a greater one."""
    value = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.transform(F.split(F.upper(c), ""), lambda d: value[d])
    step = lambda a, d: F.struct((a["sum"] + d - F.when(a["last"] < d, 2 * a["last"]).otherwise(0)).alias("sum"), d.alias("last"))
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda a: a["sum"]))


def slug(c: Column, n: int = 16) -> Column:
    """First ``n`` hex digits of the SHA-1: a file name for a title."""
    return F.substring(F.sha1(c.cast("binary")), 1, n)


def squash(c: Column, composed: bool = False) -> Column:
    """In NFC, without white space, dandas, punctuation and joiners, to compare quotes; ``composed`` texts are in NFC already."""
    return F.regexp_replace(c if composed else nfc(c), "(?U)[\\s।॥|.,;:!?\\-‌‍]+", "")


def quoted_in(passage: Column, quote: Column, least: int = 8, composed: bool = False) -> Column:
    """Whether the squashed quote of at least ``least`` characters is in the squashed passage.

    Inside a lambda, where no Python can run, both must be ``composed``.
    """
    q = squash(quote, composed)
    return F.coalesce((F.length(q) >= least) & F.contains(squash(passage, composed), q), F.lit(False))


def script(c: Column, native: str = r"[ఀ-౿]") -> Column:
    """'native', 'latin' or 'mixed', by which letters a text has more of."""
    a, b = F.regexp_count(c, F.lit(native)), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(a > b, "native").when(b > a, "latin").otherwise("mixed")


def char_grams(c: Column, n: int) -> Column:
    """All ``n``-grams of code points, in order.

    The text is cut into characters once, and bound as a lambda's variable:
    ``substring`` would count from the start of the text for every gram.
    """

    def grams(chars):
        return F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0))), lambda x, i: F.concat(x, *[F.get(chars, i + k) for k in range(1, n)]))

    return F.flatten(F.transform(F.array(F.split(c, "")), grams))


def gram_bag(c: Column, n: int) -> Column:
    """All ``n``-grams of code points, grouped by where they start modulo ``n``.

    One pass of a pattern from each of the first ``n`` characters: several times
    as fast as ``char_grams`` where order does not matter.
    """
    passes = [F.regexp_extract_all(F.substr(c, F.lit(k + 1)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in range(n)]
    return F.flatten(F.array(*passes))


def lexical_tokens(c: Column, n: int = 4) -> Column:
    """One bag of all character ``n``-grams (spaces included) and the words."""
    return F.concat(gram_bag(c, n), F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def lexical_length(c: Column, n: int = 4) -> Column:
    """The size of ``lexical_tokens`` without making them."""
    return F.greatest(F.length(c) - (n - 1), F.lit(0)) + F.regexp_count(c, F.lit(r"(?U)\S+"))


def letters(c: Column, keep: str = "a-zāīūṛṝḷṃḥśṣñṅṭḍṇ") -> Column:
    """The lower-cased text stripped to the letters ``keep``."""
    return F.regexp_replace(F.lower(c), f"[^{keep}]", "")


def gram_set(c: Column, n: int = 3, keep: str = "a-zāīūṛṝḷṃḥśṣñṅṭḍṇ") -> Column:
    """Distinct ``n``-grams of the lower-cased text stripped to the letters ``keep``."""
    return F.array_distinct(char_grams(letters(c, keep), n))


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements one after the other."""
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


# Names of the media namespace, and the tags that only format.
MEDIA = "File Image Media चित्रम् चित्र संचिका".split()
FORMAT_TAGS = "poem div span center small big b i u p".split()

#: Templates and links inside each other are taken off from the innermost outwards, so many deep.
NESTED = 5


def peeled(c: Column, *steps: tuple[str, str]) -> Column:
    """``steps`` on constructs that hold no other of their kind, again for those that this makes innermost."""
    return chain(c, *(steps * NESTED))


def clean_markup(c: Column, template: str = "", tags: str | None = None) -> Column:
    """Wiki markup to text: comments, notes, templates, tags, media and foreign links go; a link leaves its label.

    ``template`` stands in for a template. Without ``tags`` only formatting tags go, and a
    line break ends the line; with it, every tag becomes ``tags``.
    """
    inner = r"[^\[\]]*"
    away = rf"\[\[(?:{'|'.join(MEDIA)}|[a-z-]+):{inner}\]\]"
    label = r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]"
    plain = chain(c, (r"(?s)<!--.*?-->", ""), (r"(?s)<ref\b(?:[^>]*/|[^>]*>.*?</ref\s*)>", ""))
    plain = peeled(plain, (r"\{\{[^{}]*\}\}", template))
    if tags is None:
        plain = chain(plain, (r"<br\s*/?>", "\n"), (rf"</?(?:{'|'.join(FORMAT_TAGS)})\b[^>]*>", ""))
    else:
        plain = chain(plain, (r"<[^>]+>", tags))
    plain = peeled(plain, (away, ""), (label, "$1"))
    return F.replace(F.regexp_replace(plain, "'{2,}", ""), F.lit("&nbsp;"), F.lit(" "))


def clean_wikitext(c: Column) -> Column:
    """The text of a wiki page in NFC, line by line."""
    return clean_markup(norm(c, joiners=True))


def clean_html(c: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, five entities are read."""
    return F.btrim(
        chain(
            c,
            (r"(?s)<script[^>]*>.*?</script>", " "),
            (r"(?s)<style[^>]*>.*?</style>", " "),
            (r"(?s)<!--.*?-->", " "),
            (r"<[^>]*>", " "),
            ("&nbsp;", " "),
            ("&lt;", "<"),
            ("&gt;", ">"),
            ("&quot;", '"'),
            ("&amp;", "&"),
            (r"[ \t\n\r]+", " "),
        )
    )


def clean_prose(c: Column) -> Column:
    """English wiki prose: no headings, lists or tables, blanks and blank lines squeezed."""
    return strip(chain(clean_markup(c, template=" ", tags=" "), (r"(?m)^\s*[=*#|].*$", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def truncated(c: Column, n: int = 6000) -> Column:
    """The first ``n`` code points."""
    return F.substring(c, 1, n)


def stamp(ts: Column) -> Column:
    """A time as ISO text without fractions."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def title_numbers(title: Column, pattern: str, book: int = 1, chapter: int = 2, read=None) -> Column:
    """Struct (book, chapter) from a page title whose ``pattern`` has a group for each; null where it does not match.

    ``read`` turns a group into a number: ``number`` unless given, ``roman`` for Roman numerals.
    """
    read = read or number
    part = lambda k: read(F.regexp_extract(title, pattern, k))
    return F.when(F.rlike(title, F.lit(pattern)), F.struct(part(book).alias("book"), part(chapter).alias("chapter")))


def clean_verse(c: Column, speaker: str) -> tuple[Column, Column]:
    """(text, last speaker) of a verse: ``speaker`` is a pattern with one group; lines join with a bar."""
    who = F.try_element_at(F.regexp_extract_all(c, F.lit(speaker), F.lit(1)), F.lit(-1))
    lines = F.transform(F.split(F.regexp_replace(c, speaker, ""), "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " |\n"), who


def strip_notes(c: Column) -> Column:
    """Footnote numbers in parentheses go, blanks are squeezed."""
    return F.regexp_replace(F.regexp_replace(c, r"\(\d+\)", ""), " {2,}", " ")


def url_title(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def request_id(work: Column, chapter: Column) -> Column:
    return F.translate(F.concat_ws("__", work, chapter), ".", "_")


def has_latin(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def partial_json(c: Column, field: str) -> Column:
    """The string value of ``field`` in JSON that may still be growing."""
    return F.regexp_extract(c, rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)


def dcg(rank: Column) -> Column:
    """Gain of a hit at a rank from 1."""
    return 1 / F.log2(rank + 1)


def cost(tokens: dict[str, Column], price: dict[str, Column], batch: bool = False) -> Column:
    """Dollars for token counts at prices a million; a batch costs half."""
    total = sum((F.coalesce(tokens[k], F.lit(0)) * price[k] for k in tokens), F.lit(0.0))
    return total / 1e6 * (0.5 if batch else 1.0)


def estimate_tokens(n_verses: Column, fixed: int = 3500, per_verse: int = 70, out: int = 4200) -> tuple[Column, Column]:
    return fixed + per_verse * n_verses, F.lit(out)


# The Sanskrit ordinals that are no compounds, tens and units with their sandhi forms.
ORDINALS = {"प्रथम": 1, "द्वितीय": 2, "तृतीय": 3, "चतुर्थ": 4, "पञ्चम": 5, "षष्ठ": 6, "षष्ट": 6, "सप्तम": 7, "अष्टम": 8, "नवम": 9, "दशम": 10, "एकादश": 11, "द्वादश": 12, "त्रयोदश": 13, "चतुर्दश": 14, "पञ्चदश": 15, "षोडश": 16, "सप्तदश": 17, "अष्टादश": 18, "शततम": 100}
TENS = {"नवति": 90, "णवति": 90, "शीति": 80, "सप्तति": 70, "षष्टि": 60, "षष्ठि": 60, "पञ्चाशत्": 50, "पञ्चाषत्": 50, "चत्वारिंशत्": 40, "चत्वारिंशात्": 40, "त्रिंशत्": 30, "विंशति": 20}
UNITS = {
    "एकोन": -1,
    "ऊन": -1,
    "एका": 1,
    "एक": 1,
    "द्व्य": 2,
    "द्वा": 2,
    "द्वि": 2,
    "त्र्य": 3,
    "त्रयस्": 3,
    "त्रयो": 3,
    "त्रि": 3,
    "चतुश्": 4,
    "चतुष्": 4,
    "चतुस्": 4,
    "चतुर्": 4,
    "चतुर": 4,
    "पञ्चा": 5,
    "पञ्च": 5,
    "पञ्ज": 5,
    "षड्": 6,
    "षट्": 6,
    "षण्": 6,
    "षडा": 6,
    "षड": 6,
    "सप्ता": 7,
    "सप्त": 7,
    "अष्टा": 8,
    "अष्ट": 8,
    "नवा": 9,
    "नव": 9,
    "अ": 0,
    "": 0,
}


def ordinal_table() -> dict[str, int]:
    """Every stem from one to a hundred that the grammar above can write."""
    compounds = {unit + stem: ten + n for stem, ten in TENS.items() for unit, n in UNITS.items()}
    return compounds | ORDINALS


def ordinal(c: Column) -> Column:
    """Sanskrit ordinal of a chapter title as an integer, by lookup of its stem; null if unknown."""
    word = F.translate(strip(c), JOINERS, "")
    plain = F.regexp_replace(word, "(ो|ः)?ऽ?(ध्यायः.*)?$", "")  # first: सप्तमो holds the ending of the compounds
    stem = F.regexp_replace(word, "(तमो|तमः|ो|ः)?ऽ?(ध्यायः.*)?$", "")
    table = F.create_map(*[F.lit(x) for kv in ordinal_table().items() for x in kv])
    return F.coalesce(table[plain], table[stem], table[F.regexp_replace(stem, "ो$", "")])


# Published correspondences of Devanagari and IAST.
_VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ॠ ए ऐ ओ औ".split(), "a ā i ī u ū ṛ ṝ e ai o au".split(), strict=True))
_SIGNS = dict(zip("ा ि ी ु ू ृ ॄ े ै ो ौ".split(), "ā i ī u ū ṛ ṝ e ai o au".split(), strict=True))
_CONSONANTS = dict(zip("क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(), "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḷ".split(), strict=True))
_OTHERS = {"ं": "ṃ", "ः": "ḥ", "ँ": "m̐", "ऽ": "'", "।": "|", "॥": "||"}


def iast(c: Column) -> Column:
    """Devanagari to IAST: a consonant carries 'a' unless a sign or virama follows. Other characters stay."""
    consonants, signs = "".join(_CONSONANTS), "".join(_SIGNS)
    out = F.regexp_replace(c, f"([{consonants}])(?![{signs}्])", "$1a")
    table = _VOWELS | _SIGNS | _CONSONANTS | _OTHERS | {"्": ""} | {ch: str(k % 10) for k, ch in enumerate(INDIC_DIGITS)}
    for ch, letters in table.items():
        if len(letters) > 1:
            out = F.replace(out, F.lit(ch), F.lit(letters))
    one = {ch: x for ch, x in table.items() if len(x) == 1}
    # translate() deletes what has no counterpart: the virama comes last
    return F.translate(out, "".join(one) + "्", "".join(one.values()))


def telugu(c: Column) -> Column:
    """Devanagari to Telugu: the blocks are laid out alike, 0x300 apart; dandas stay."""
    block = "".join(chr(x) for x in range(0x901, 0x970) if x not in (0x964, 0x965))
    return F.translate(c, block, "".join(chr(ord(x) + 0x300) for x in block))
