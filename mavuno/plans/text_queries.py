"""Queries for the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .inputs import BOOK_PAGES, ITEMS, book_pages, documents, items, table
from .registry import query

SP = r"[\t-\r \x{85}\p{Z}]"  # Unicode white space in DuckDB's dialect
STRIP = lambda x: rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"
SQUASH = lambda x: rf"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


@query(rf"SELECT doc_id, {SQUASH('text')} AS clean FROM documents")
def tx_squash_ws(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.squash_ws("text").alias("clean"))


_BLOCK = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace({0}, chr(173), ''), '-' || chr(10), ''), '•', '• '), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"


@query(rf"WITH {BOOK_PAGES} SELECT source, page_no, {STRIP(_BLOCK.format('text'))} AS clean FROM book_pages")
def tx_clean_block(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", T.clean_block("text").alias("clean"))


_LINES = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, '–', '-'), '[ \t]+', ' ', 'g'), '\r\n|[\n\r]'), lambda x: {STRIP('x')}), lambda x: x <> '')"


@query(rf"WITH {BOOK_PAGES} SELECT source, page_no, len({_LINES}) AS n_lines, array_to_string({_LINES}, '|') AS lines FROM book_pages")
def tx_clean_lines(spark, sf_dir):
    lines = T.clean_lines("text")
    return book_pages(spark, sf_dir).select("source", "page_no", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, "|").alias("lines"))


_KEPT = rf"list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\d{{1,3}}$') AND NOT regexp_matches(x, '^\s*[\p{{L}}\p{{N}}_]+\s*\d{{1,3}}\s*$'))"
_GLUED = rf"regexp_replace(array_to_string({_KEPT}, chr(10)), '([A-Za-z])-\n([a-z])', '\1\2', 'g')"
_MARKED = rf"list_transform(string_split({_GLUED}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[•\-]\s') THEN chr(1) || x || chr(1) ELSE x END)"


@query(rf"WITH {BOOK_PAGES} SELECT source, page_no, {STRIP(rf'''regexp_replace(array_to_string({_MARKED}, ' '), '(?: ?\x01 ?)+', chr(10), 'g')''')} AS paragraphs FROM book_pages")
def tx_join_paragraphs(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", T.join_paragraphs(T.clean_lines("text")).alias("paragraphs"))


_SLUG = r"regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_SECTION = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g')"


@query(rf"WITH {ITEMS} SELECT id, {_SLUG.format('title')} AS slug, CASE WHEN {_SECTION} = '' THEN 'section' ELSE {_SECTION} END AS section FROM items")
def tx_slugify(spark, sf_dir):
    return items(spark, sf_dir).select("id", T.slugify("title").alias("slug"), T.section_slug("title").alias("section"))


_NFKD = "array_to_string(list_transform(string_split(title, ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || '~' ELSE c END), '')"


@query(rf"WITH {ITEMS} SELECT id, lower(regexp_replace(regexp_replace({_NFKD}, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM items")
def tx_slugify_decomposed(spark, sf_dir):
    return items(spark, sf_dir).select("id", T.slugify_decomposed("title").alias("slug"))


def _ratio(x: str, letters: str, upper: str) -> str:
    return rf"length(regexp_replace({x}, '[^{upper}]', '', 'g')) / greatest(length(regexp_replace({x}, '[^{letters}]', '', 'g')), 1)"


_L, _LU = r"\p{L}", r"\p{Lu}"
_TITLE = r"(regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '(?:^|[^\p{L}])\p{Ll}') AND NOT regexp_matches(line, '\p{L}\p{Lu}'))"
_N = "length(regexp_replace(trim(line), '[^A-Za-z]', '', 'g'))"


@query(
    rf"""WITH {BOOK_PAGES} SELECT source, page_no, pos,
 length(line) BETWEEN 3 AND 60 AND NOT regexp_matches(line, '[.:]$') AND ({_ratio('line', _L, _LU)} > 0.7 OR {_TITLE}) AS header,
 length(trim(line)) BETWEEN 4 AND 80 AND {_N} > 0 AND {_ratio('trim(line)', 'A-Za-z', 'A-Z')} > 0.8 AS page,
 length(trim(line)) BETWEEN 1 AND 80 AND {_N} >= 3 AND ({_ratio('trim(line)', 'A-Za-z', 'A-Z')} > 0.85 OR (len(string_split({SQUASH('trim(line)')}, ' ')) <= 6 AND trim(line) NOT LIKE '%.' AND NOT regexp_matches(trim(line), '(?i)^(Part|Section|Chapter)\b'))) AS section,
 length(trim(line)) BETWEEN 1 AND 120 AND NOT regexp_matches(trim(line), '(?i)^(SECTION|PART|CHAPTER|BASIC PRINCIPLES|THE MOST IMPORTANT HERBS)\b') AND {_N} >= 4 AND {_ratio('trim(line)', 'A-Za-z', 'A-Z')} > 0.8 AS book
 FROM book"""
)
def tx_is_heading(spark, sf_dir):
    from .inputs import book_lines

    kinds = ("header", "page", "section", "book")
    return book_lines(spark, sf_dir).select("source", "page_no", "pos", *[T.is_heading("line", k).alias(k) for k in kinds])


_ONE = STRIP("replace(text, chr(10), ' ')")


def _first(n: int) -> str:
    s = rf"CASE WHEN regexp_matches({_ONE}, '[.!?]') THEN regexp_extract({_ONE}, '^[^.!?]*[.!?]') ELSE substring({_ONE}, 1, {n}) END"
    return rf"({s}) || CASE WHEN length({s}) < length({_ONE}) THEN '…' ELSE '' END"


LEAD = _first(160)  # of a column named text


@query(rf"SELECT doc_id, {LEAD} AS lead, {_first(120)} AS clue FROM documents")
def tx_first_sentence(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.first_sentence("text").alias("lead"), T.first_sentence("text", 120).alias("clue"))


@query(rf"SELECT doc_id, CASE WHEN length({SQUASH('text')}) <= 160 THEN {SQUASH('text')} ELSE substring({SQUASH('text')}, 1, 160) || ' …' END AS snippet FROM documents")
def tx_snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.snippet("text").alias("snippet"))


@query(
    """WITH q AS (SELECT doc_id, lower(text) AS t, lower(regexp_extract(text, '[A-Za-z]{4,}')) AS term FROM documents),
 a AS (SELECT *, CASE WHEN term = '' THEN 0 ELSE instr(t, term) END AS p FROM q),
 b AS (SELECT *, greatest(p - 1 - 100, 0) AS s, least(p - 1 + 100, length(t)) AS e FROM a)
 SELECT doc_id, term, CASE WHEN p > 0 THEN CASE WHEN s > 0 THEN '… ' ELSE '' END || replace(substring(t, s + 1, e - s), chr(10), ' ') || CASE WHEN e < length(t) THEN ' …' ELSE '' END END AS around FROM b"""
)
def tx_context_snippet(spark, sf_dir):
    term = F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0))
    return documents(spark, sf_dir).select("doc_id", term.alias("term"), T.context_snippet("text", term).alias("around"))


@query(
    """WITH q AS (SELECT doc_id, lower(text) AS t, lower(regexp_extract(text, '[A-Za-z]{3,}')) AS term FROM documents WHERE regexp_matches(text, '[A-Za-z]{3,}')),
 g AS (SELECT doc_id, term, string_split(t, term) AS gaps FROM q)
 SELECT doc_id, term, len(gaps) - 1 AS hits, length(gaps[1]) AS first_start, CAST(list_sum(list_transform(gaps, lambda x: length(x))) + (len(gaps) - 1) * length(term) - length(gaps[-1]) AS BIGINT) AS last_end FROM g"""
)
def tx_match_spans(spark, sf_dir):
    term = F.lower(F.regexp_extract("text", "[A-Za-z]{3,}", 0))
    d = documents(spark, sf_dir).select("doc_id", "text", term.alias("term")).filter("term <> ''")
    d = d.withColumn("spans", T.match_spans("text", F.col("term")))
    return d.select("doc_id", "term", F.size("spans").cast("long").alias("hits"), F.get("spans", F.lit(0))["start"].cast("long").alias("first_start"), F.element_at("spans", -1)["end"].cast("long").alias("last_end"))


_FOUND = lambda p: f"regexp_extract_all(lower(text), '{p}')"


@query(
    f"""SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[a-zA-ZÀ-ÿ0-9'']+'), lambda x: lower(x)), lambda x: length(x) > 1))) AS hybrid,
 len(list_distinct({_FOUND('[a-z0-9]{2,}')})) AS "index", len(list_distinct({_FOUND('[a-z0-9]+')})) AS word, len({_FOUND("[A-Za-zÀ-ÖØ-öø-ÿ0-9'']+")}) AS answer,
 array_to_string(list_sort(list_distinct({_FOUND('[a-z0-9]{2,}')})), ' ') AS terms FROM documents"""
)
def tx_tokens(spark, sf_dir):
    counts = [F.size(T.tokens("text", k)).cast("long").alias(k) for k in ("hybrid", "index", "word", "answer")]
    return documents(spark, sf_dir).select("doc_id", *counts, F.array_join(F.array_sort(T.tokens("text", "index")), " ").alias("terms"))


@query(rf"WITH d AS (SELECT doc_id, replace(replace(text, ', ', chr(10) || chr(10)), '. ', chr(10) || 'ENCOURAGEMENT—') AS text FROM documents) SELECT doc_id, {STRIP(r'''regexp_replace(regexp_replace(text, '(?s)\n?ENCOURAGEMENT—.*?(?:\n\s*\n|$)', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS body FROM d")
def tx_strip_blocks(spark, sf_dir):
    marked = F.replace(F.replace("text", F.lit(", "), F.lit("\n\n")), F.lit(". "), F.lit("\nENCOURAGEMENT—"))
    return documents(spark, sf_dir).select("doc_id", T.strip_blocks(marked).alias("body"))


@query("SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS plain FROM pages")
def tx_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags("html").alias("plain"))


_BUL = "list_transform(string_split(text, chr(10)), lambda x: rtrim(x))"


@query(
    rf"""WITH d AS (SELECT doc_id, replace(replace(text, chr(10), chr(10) || CASE WHEN doc_id % 2 = 0 THEN '• ' ELSE '' END), ', ', chr(10) || '- ') AS text FROM documents)
 SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^•+\s*', '- ')), chr(10)) AS dashed,
 CASE WHEN len(list_filter({_BUL}, lambda x: regexp_matches(x, '^[•–-] '))) * 2 >= len({_BUL}) THEN array_to_string(list_transform(list_filter({_BUL}, lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '^[•\-–]\s*', '')), '|') ELSE '' END AS bullets FROM d"""
)
def tx_bullets(spark, sf_dir):
    line = F.concat(F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("• ")).otherwise(F.lit("")))
    d = documents(spark, sf_dir).select("doc_id", F.replace(F.replace("text", F.lit("\n"), line), F.lit(", "), F.lit("\n- ")).alias("text"))
    return d.select("doc_id", T.dash_bullets("text").alias("dashed"), F.array_join(T.bullet_items("text"), "|").alias("bullets"))


@query(
    rf"""WITH d AS (SELECT doc_id, {SQUASH('text')} AS t FROM documents), h AS (SELECT *, CASE WHEN substring(t, 199, 1) = ' ' THEN substring(t, 1, 198) ELSE regexp_replace(substring(t, 1, 199), '\s*\S*$', '') END AS head FROM d)
 SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN head = '' THEN '…' ELSE head || ' …' END AS short FROM h"""
)
def tx_shorten(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.shorten("text", 200).alias("short"))


@query(f"WITH {ITEMS} SELECT id, coalesce(content_sw, content_en) AS sw, coalesce(content_en, content_sw) AS en FROM items")
def tx_language_body(spark, sf_dir):
    return items(spark, sf_dir).select("id", T.language_body(F.lit("sw")).alias("sw"), T.language_body(F.lit("en")).alias("en"))
