"""Column functions for cleaning text. All stay inside the JVM; a null input gives null unless stated."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Text = Column | str
# Token patterns by use (hybrid ranking, the keyword index, related titles and queries, answers), words that
# open parts of a book, and the head of blocks that are stripped.
TOKENS = {"hybrid": r"[a-zA-ZÀ-ÿ0-9']+", "index": r"[a-z0-9]{2,}", "word": r"[a-z0-9]+", "answer": r"[A-Za-zÀ-ÖØ-öø-ÿ0-9']+"}
NOISE = r"(?i)^(SECTION|PART|CHAPTER|BASIC PRINCIPLES|THE MOST IMPORTANT HERBS)\b"
STRIPPED_HEAD = "ENCOURAGEMENT—"

#: White space in the Unicode sense; Java's plain \s knows ASCII only.
SPACE = r"(?U)\s"


def _c(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Text) -> Column:
    return F.regexp_replace(_c(c), rf"^(?:{SPACE})+|(?:{SPACE})+$", "")


def trim_blanks(c: Text) -> Column:
    """Without outer blanks, those of other scripts too; tabs and line ends stay."""
    return F.regexp_replace(_c(c), r"^\p{Zs}+|\p{Zs}+\z", "")


def blank_to_null(c: Text) -> Column:
    return F.nullif(strip(c), F.lit(""))


def squash_ws(c: Text) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(_c(c), rf"{SPACE}+", " "))


def clean_block(c: Text) -> Column:
    """Drop soft hyphens, glue hyphenated line breaks, space bullets, strip line tails, cap blank lines and runs of blanks."""
    t = F.replace(F.replace(F.replace(_c(c), F.lit("­"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("•"), F.lit("• "))
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        t = F.regexp_replace(t, pattern, by)
    return strip(t)


def clean_lines(c: Text) -> Column:
    """Trimmed non-empty lines, en dashes as hyphens, blanks squeezed."""
    t = F.regexp_replace(F.replace(_c(c), F.lit("–"), F.lit("-")), r"[ \t]+", " ")
    return F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), strip), lambda x: x != "")


def join_paragraphs(lines: Column) -> Column:
    """One text from cleaned lines: bare page numbers and `word 12` lines go, words broken by a hyphen are glued, wrapped
    lines are joined by a space, bullet lines stay on their own."""
    kept = F.filter(lines, lambda x: ~x.rlike(r"^\d{1,3}$") & ~x.rlike(rf"(?U)^\s*\w+\s*\d{{1,3}}\s*$"))
    glued = F.regexp_replace(F.array_join(kept, "\n"), r"(?<=[A-Za-z])-\n(?=[a-z])", "")
    marked = F.transform(F.split(glued, "\n"), lambda x: F.when(x.rlike(r"^[•\-]\s"), F.concat(F.lit("\u0001"), x, F.lit("\u0001"))).otherwise(x))
    return strip(F.regexp_replace(F.array_join(marked, " "), "(?: ?\u0001 ?)+", "\n"))


def slugify(c: Text) -> Column:
    """Lower-case ASCII letters and digits, anything else as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def section_slug(c: Text) -> Column:
    """Slug of a section title: marks go, blanks become hyphens; `section` if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(_c(c))), r"[^a-z0-9\s-]", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), "-{2,}", "-"), "^-|-$", "")
    return F.when(t == "", F.lit("section")).otherwise(t)


@F.pandas_udf(StringType())
def slugify_decomposed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Slug after NFKD, which Spark lacks: an accent inside a word is a mark of its own and so becomes a hyphen."""
    for s in batches:
        t = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))
        yield t.str.replace(r"[^a-zA-Z0-9]+", "-", regex=True).str.strip("-").str.lower()


def caps_ratio(c: Text, letters: str = "A-Za-z", upper: str = "A-Z") -> Column:
    n = F.length(F.regexp_replace(_c(c), f"[^{letters}]", ""))
    return F.length(F.regexp_replace(_c(c), f"[^{upper}]", "")) / F.greatest(n, F.lit(1))


def is_title_case(c: Text) -> Column:
    """Every run of letters starts with a capital and goes on in lower case."""
    t = _c(c)
    return t.rlike(r"\p{Lu}") & ~t.rlike(r"(?:^|[^\p{L}])\p{Ll}") & ~t.rlike(r"\p{L}\p{Lu}")


def is_heading(c: Text, kind: str = "book") -> Column:
    """Whether a line looks like a heading. Kinds: `header` (short, capitals or title case), `page` (capitals), `section`
    (capitals, or few words without a final stop), `book` (capitals, but for words that open parts of a book)."""
    t = F.trim(_c(c))
    n = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    if kind == "header":
        return F.length(_c(c)).between(3, 60) & ~_c(c).rlike("[.:]$") & ((caps_ratio(_c(c), r"\p{L}", r"\p{Lu}") > 0.7) | is_title_case(_c(c)))
    if kind == "page":
        return F.length(t).between(4, 80) & (n > 0) & (caps_ratio(t) > 0.8)
    if kind == "section":
        few = (F.size(F.split(squash_ws(t), " ")) <= 6) & ~t.endswith(".") & ~t.rlike(r"(?i)^(Part|Section|Chapter)\b")
        return F.length(t).between(1, 80) & (n >= 3) & ((caps_ratio(t) > 0.85) | few)
    return F.length(t).between(1, 120) & ~t.rlike(NOISE) & (n >= 4) & (caps_ratio(t) > 0.8)


def first_sentence(c: Text, n: int = 160) -> Column:
    """Up to the first of .!?, else n characters; an ellipsis if that is not all."""
    t = strip(F.replace(_c(c), F.lit("\n"), F.lit(" ")))
    stop = F.regexp_instr(t, F.lit("[.!?]"))
    s = F.when(stop > 0, F.substring(t, F.lit(1), stop)).otherwise(F.substring(t, 1, n))
    return F.when(F.length(s) < F.length(t), F.concat(s, F.lit("…"))).otherwise(s)


def snippet(c: Text, n: int = 160) -> Column:
    t = squash_ws(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit(" …")))


def context_snippet(c: Text, term: Column, around: int = 100) -> Column:
    """Lower-cased text around the first hit of a term, with ellipses where it is cut; null without a hit."""
    t = F.lower(_c(c))
    at = F.instr(t, term)
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + around, F.length(t))
    s = F.replace(F.substring(t, start + 1, end - start), F.lit("\n"), F.lit(" "))
    s = F.concat(F.when(start > 0, F.lit("… ")).otherwise(F.lit("")), s, F.when(end < F.length(t), F.lit(" …")).otherwise(F.lit("")))
    return F.when((at > 0) & (F.length(term) > 0), s)


def match_spans(c: Text, query: Column) -> Column:
    """Starts and ends (exclusive) of all non-overlapping hits of the literal query, whatever the case."""
    gaps = F.split(F.lower(_c(c)), F.concat(F.lit("\\Q"), F.lower(query), F.lit("\\E")), -1)
    size = F.length(query)
    ends = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda _, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + i * size)
    return F.when(size > 0, F.transform(ends, lambda s: F.struct(s.alias("start"), (s + size).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def tokens(c: Text, kind: str = "index") -> Column:
    """Lower-case tokens; a set except for `answer`."""
    t = F.coalesce(_c(c), F.lit(""))
    if kind == "hybrid":  # cut before lowering, as letters beyond the pattern may fold into it
        found = F.transform(F.regexp_extract_all(t, F.lit(TOKENS[kind]), F.lit(0)), F.lower)
        return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))
    found = F.regexp_extract_all(F.lower(t), F.lit(TOKENS[kind]), F.lit(0))
    return found if kind == "answer" else F.array_distinct(found)


def strip_blocks(c: Text, head: str = STRIPPED_HEAD) -> Column:
    """Remove blocks from `head` to the next blank line or the end; cap blank lines."""
    t = F.regexp_replace(_c(c), rf"(?s)\n?\Q{head}\E.*?(?:\n\s*\n|$)", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_tags(c: Text) -> Column:
    return F.regexp_replace(_c(c), "<.*?>", "")


def dash_bullets(c: Text) -> Column:
    """Trimmed lines, with • bullets as `- `."""
    return F.array_join(F.transform(F.split(_c(c), "\n"), lambda x: F.regexp_replace(trim_blanks(x), r"^•+[\t\n\f\r ]*", "- ")), "\n")


def bullet_items(c: Text) -> Column:
    """Bullet texts if at least half of the lines are bullets, else an empty array."""
    lines = F.transform(F.split(_c(c), "\n"), lambda x: F.regexp_replace(x, r"\p{Zs}+\z", ""))  # a function of two arguments would get the line's number too
    bullets = F.size(F.filter(lines, lambda x: x.rlike("^[•–-] ")))
    kept = F.transform(F.filter(lines, lambda x: trim_blanks(x) != ""), lambda x: F.regexp_replace(x, r"^[•\-–][\t\n\f\r ]*", ""))
    return F.when(bullets * 2 >= F.size(lines), kept).otherwise(F.array().cast("array<string>"))


def shorten(c: Text, width: int, mark: str = " …") -> Column:
    """Whole words up to `width` characters, mark included; white space squashed."""
    t = squash_ws(c)
    room = width - len(mark)
    head = F.regexp_replace(F.substring(t, 1, room + 1), r"\s*\S*$", "")
    head = F.when(F.substring(t, room + 1, 1) == " ", F.substring(t, 1, room)).otherwise(head)
    return F.when(F.length(t) <= width, t).otherwise(F.when(head == "", F.lit(mark.strip())).otherwise(F.concat(head, F.lit(mark))))


def pack(pieces: Column, most: int) -> Column:
    """Join pieces greedily by a space while a pack stays at most `most` characters long; longer pieces stand alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.struct(a["done"].alias("done"), s.alias("cur"))
        longer = F.struct(a["done"].alias("done"), F.concat(a["cur"], F.lit(" "), s).alias("cur"))
        closed = F.struct(F.array_append(a["done"], a["cur"]).alias("done"), s.alias("cur"))
        return F.when(a["cur"].isNull(), fresh).when(F.length(a["cur"]) + F.length(s) < most, longer).otherwise(closed)

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def language_body(lang: Column, en: Text = "content_en", sw: Text = "content_sw") -> Column:
    """The body in the wanted language, else in the other one; only null counts as missing."""
    return F.when(lang == "sw", F.coalesce(_c(sw), _c(en))).otherwise(F.coalesce(_c(en), _c(sw)))
