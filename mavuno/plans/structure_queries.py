"""Queries for pages, sections, items and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as S
from ..operators.ordered import numbered
from .inputs import BOOK, BOOK_PAGES, ITEMS, book_pages, documents, items
from .registry import ORACLES, query
from .text_queries import LEAD, _BLOCK, SQUASH, STRIP

_CAPS = lambda x: f"length(regexp_replace({x}, '[^A-Z]', '', 'g')) / greatest(length(regexp_replace({x}, '[^A-Za-z]', '', 'g')), 1)"
_N = lambda x: f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
INITCAP = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')"


@query(f"WITH {BOOK_PAGES}, n AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_no) AS page_no, text FROM book_pages) SELECT source, page_no, length(text) AS n FROM n WHERE page_no BETWEEN 10 AND 40")
def st_page_range(spark, sf_dir):
    """Pages 10 to 40 of every book, counted from its first page."""
    pages = book_pages(spark, sf_dir).select("source", F.col("page_no").alias("_page"), F.length("text").cast("long").alias("n"))
    return S.page_range(numbered(pages, ["source"], ["_page"], "page_no"), 10, 40).select("source", "page_no", "n")


_TOP = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: {SQUASH('x')}), lambda x: x <> '')[1:5]"


@query(
    f"""WITH {BOOK_PAGES}, own AS (SELECT source, page_no, list_filter({_TOP}, lambda x: length(x) BETWEEN 4 AND 80 AND {_N('x')} > 0 AND {_CAPS('x')} > 0.8)[1] AS h FROM book_pages),
 cased AS (SELECT source, page_no, {INITCAP('h')} AS h FROM own)
 SELECT source, page_no, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY source ORDER BY page_no ROWS UNBOUNDED PRECEDING), 'General') AS section FROM cased"""
)
def st_carry_heading(spark, sf_dir):
    return S.carry_heading(book_pages(spark, sf_dir)).select("source", "page_no", "section")


_PARTS = r"CASE WHEN contains(text, chr(10) || chr(10)) THEN regexp_split_to_array(text, '\n\s*\n') ELSE string_split(regexp_replace(text, '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)) END"


@query(f"WITH p AS (SELECT doc_id, list_filter(list_transform({_PARTS}, lambda x: {SQUASH('x')}), lambda x: length(x) >= 60) AS ps FROM documents) SELECT doc_id, len(ps) AS n, array_to_string(ps, '|') AS paragraphs FROM p")
def st_paragraphs(spark, sf_dir):
    ps = S.paragraphs("text", 60)
    return documents(spark, sf_dir).select("doc_id", F.size(ps).cast("long").alias("n"), F.array_join(ps, "|").alias("paragraphs"))


def packed(words: str, most: int) -> str:
    return f"string_split(list_reduce({words}, lambda a, w: CASE WHEN length(string_split(a, chr(1))[-1]) + length(w) < {most} THEN a || ' ' || w ELSE a || chr(1) || w END), chr(1))"


@query(
    f"""WITH {BOOK_PAGES}, p AS (SELECT source, page_no, list_filter(list_transform({_PARTS}, lambda x: {SQUASH('x')}), lambda x: length(x) >= 160) AS ps FROM book_pages),
 k AS (SELECT source, page_no, flatten(list_transform(ps, lambda x: {packed("string_split(x, ' ')", 600)})) AS cs FROM p), u AS (SELECT source, page_no, unnest(cs) AS chunk, unnest(range(1, len(cs) + 1)) AS i FROM k)
 SELECT source, page_no, 'p' || page_no || '-' || i AS chunk_id, chunk FROM u"""
)
def st_wrap_chunks(spark, sf_dir):
    return S.wrapped_chunks(book_pages(spark, sf_dir))


_SECTION = f"(length(l) BETWEEN 1 AND 80 AND {_N('l')} >= 3 AND ({_CAPS('l')} > 0.85 OR (len(string_split({SQUASH('l')}, ' ')) <= 6 AND l NOT LIKE '%.' AND NOT regexp_matches(l, '(?i)^(Part|Section|Chapter)\\b'))))"


@query(
    f"""WITH {BOOK}, t AS (SELECT source, page_no, pos, trim(line) AS l FROM book), m AS (SELECT *, {_SECTION} AS head FROM t),
 b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page_no, pos ROWS UNBOUNDED PRECEDING) AS block FROM m)
 SELECT source, CAST(block AS BIGINT) AS block, max(CASE WHEN head THEN l END) AS heading, {STRIP(_BLOCK.format('string_agg(CASE WHEN NOT head THEN l END, chr(10) ORDER BY page_no, pos)'))} AS body
 FROM b WHERE block > 0 GROUP BY source, block HAVING count(CASE WHEN NOT head THEN 1 END) > 0"""
)
def st_segment_headings(spark, sf_dir):
    return S.segment_headings(book_pages(spark, sf_dir))


_LABEL = rf"(?i)^\s*({'|'.join(S.LABELS)})\s*[:\-–—]?\s*$"
_CANON = lambda x: f"CASE lower({x}) WHEN 'treatments' THEN 'treatment' WHEN 'remedies' THEN 'treatment' WHEN 'preparations' THEN 'preparation' ELSE lower({x}) END"


@query(
    rf"""WITH {BOOK}, m AS (SELECT *, regexp_matches(line, '{_LABEL}') AS head FROM book),
 b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM m),
 s AS (SELECT source, page_no, block, coalesce(max(CASE WHEN head THEN {_CANON(f"regexp_extract(line, '{_LABEL}', 1)")} END), 'overview') AS label, {STRIP(_BLOCK.format(STRIP('string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos)')))} AS body FROM b GROUP BY ALL)
 SELECT source, page_no, label, string_agg(body, chr(10) || chr(10) ORDER BY block) AS body FROM s WHERE body <> '' GROUP BY ALL"""
)
def st_split_subsections(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", F.explode(S.split_subsections("text")).alias("label", "body"))


def _numbered(spark, sf_dir):
    """Lines numbered in the texts' own words: every third line opens an entry, every other entry with a name."""
    name = F.upper(F.regexp_extract("text", "[A-Za-z]{4,}", 0))
    entry = lambda x, i: F.when(i % 3 == 0, F.concat((i + 1).cast("string"), F.lit(" - "), F.when(i % 2 == 0, F.concat(name, F.lit("—"))).otherwise(F.lit("")), x)).otherwise(x)
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), entry), "\n").alias("text"))


_NUMBERED = r"""numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos, name FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, upper(regexp_extract(text, '[A-Za-z]{4,}')) AS name FROM documents)),
 n AS (SELECT doc_id, pos, regexp_replace(CASE WHEN pos % 3 = 0 THEN (pos + 1) || ' - ' || CASE WHEN pos % 2 = 0 THEN name || '—' ELSE '' END || line ELSE line END, '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g') AS line FROM numbered)"""


def _parsed(pattern: str, key: int, rest: int) -> str:
    return rf"""WITH {_NUMBERED}, m AS (SELECT *, regexp_matches(line, '{pattern}') AS head FROM n WHERE line <> ''),
 b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM m)
 SELECT doc_id, CAST(block AS BIGINT) AS block, max(CASE WHEN head THEN trim(regexp_extract(line, '{pattern}', {key})) END) AS entry,
 {STRIP(f"string_agg(CASE WHEN head THEN regexp_extract(line, '{pattern}', {rest}) ELSE line END, chr(10) ORDER BY pos)")} AS body FROM b WHERE block > 0 GROUP BY doc_id, block"""


_P1, _P2 = S.NUMBERED, S.NUMBERED_NAME.replace("'", "''")


@query(f"SELECT doc_id, entry, body FROM ({_parsed(_P1, 1, 2)}) WHERE body <> '' UNION ALL SELECT doc_id, entry, body FROM ({_parsed(_P2, 2, 3)}) WHERE body <> ''")
def st_parse_numbered(spark, sf_dir):
    d = _numbered(spark, sf_dir)
    one = d.select("doc_id", F.inline(S.parse_numbered("text")))
    two = d.select("doc_id", F.inline(S.parse_numbered("text", named=True)))
    return one.unionByName(two).select("doc_id", F.col("head").alias("entry"), "body")


_NOISE = r"(?i)^(SECTION|PART|CHAPTER|BASIC PRINCIPLES|THE MOST IMPORTANT HERBS)\b"


@query(
    rf"""WITH {BOOK}, f AS (SELECT source, page_no, pos, {STRIP('line')} AS line FROM book), g AS (SELECT *, regexp_matches(line, '{_LABEL}') AS lab FROM f WHERE line <> ''),
 m AS (SELECT *, NOT lab AND length(line) <= 120 AND NOT regexp_matches(line, '{_NOISE}') AND {_N('line')} >= 4 AND {_CAPS('line')} > 0.8 AS ttl FROM g),
 b AS (SELECT *, sum(CASE WHEN ttl THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page_no, pos ROWS UNBOUNDED PRECEDING) AS item FROM m),
 l AS (SELECT *, last_value(CASE WHEN ttl THEN 'overview' WHEN lab THEN {_CANON(f"regexp_extract(line, '{_LABEL}', 1)")} END IGNORE NULLS) OVER (PARTITION BY source, item ORDER BY page_no, pos ROWS UNBOUNDED PRECEDING) AS label,
  {INITCAP(r"regexp_replace(first_value(line) OVER (PARTITION BY source, item ORDER BY page_no, pos), '\s+', ' ', 'g')")} AS title FROM b WHERE item > 0)
 SELECT source, CAST(item AS BIGINT) AS item, title, label, string_agg(line, chr(10) ORDER BY page_no, pos) AS body FROM l WHERE NOT ttl AND NOT lab GROUP BY ALL"""
)
def st_parse_conditions(spark, sf_dir):
    return S.parse_conditions(book_pages(spark, sf_dir))


_DLAB = r"(?i)^\s*(SYMPTOMS?|CAUSES?|TREATMENTS?)\s*[:—-]?\s*$"


@query(
    rf"""WITH {BOOK}, m AS (SELECT *, regexp_matches(line, '{_DLAB}') AS head FROM book),
 b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM m),
 s AS (SELECT source, page_no, block, upper(max(CASE WHEN head THEN line END)) AS head, {STRIP('string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos)')} AS body FROM b GROUP BY ALL),
 p AS (SELECT source, page_no, CASE WHEN head LIKE '%SYMPTOM%' THEN 1 WHEN head LIKE '%CAUSE%' THEN 2 WHEN head LIKE '%TREATMENT%' THEN 3 ELSE 4 END AS part, string_agg(body, chr(10) ORDER BY block) AS body FROM s WHERE body <> '' GROUP BY ALL)
 SELECT source, page_no, string_agg(CASE part WHEN 1 THEN 'SYMPTOMS' || chr(10) WHEN 2 THEN 'CAUSES' || chr(10) WHEN 3 THEN 'TREATMENT' || chr(10) ELSE '' END || body, chr(10) || chr(10) ORDER BY part) AS entry FROM p GROUP BY ALL"""
)
def st_disease_entries(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", S.disease_entry("text").alias("entry")).filter("entry <> ''")


def _rules(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{k}'" for k, p in rules) + " ELSE 'general' END"


@query(f"WITH {ITEMS} SELECT id, {_rules('lower(title)', S.SYSTEMS)} AS system FROM items")
def st_detect_system(spark, sf_dir):
    return items(spark, sf_dir).select("id", S.detect_system("title").alias("system"))


@query(f"WITH {ITEMS} SELECT id, {_rules('lower(id) || chr(10) || lower(title)', S.GROUPS)} AS grp FROM items")
def st_infer_group(spark, sf_dir):
    return items(spark, sf_dir).select("id", S.infer_group("id", "title").alias("grp"))


def _faceted(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    return pages.select(F.lit("condition").alias("type"), F.concat(F.lit("Page "), F.col("page_no") % 200).alias("title"), "source", "page_no", S.split_subsections("text").alias("fields"))


_FACETS = f"""SELECT 'condition' AS type, 'Page ' || (page_no % 200) AS title, source, page_no, label AS facet, 'condition:Page ' || (page_no % 200) || '#' || label AS chunk_id,
 'Page ' || (page_no % 200) || ' — ' || upper(substring(label, 1, 1)) || substring(label, 2) AS chunk_title, CASE WHEN label = 'overview' THEN 0 ELSE 1 END AS place, body AS content_en FROM ({ORACLES['st_split_subsections']})"""


@query(_FACETS)
def st_facet_chunks(spark, sf_dir):
    return S.facet_chunks(_faceted(spark, sf_dir))


@query(f"SELECT chunk_id, source, page_no, content_en FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY source, page_no) AS r FROM ({_FACETS}) WHERE length({STRIP('content_en')}) >= 80) WHERE r = 1")
def st_filter_dedupe(spark, sf_dir):
    chunks = S.facet_chunks(_faceted(spark, sf_dir))
    return S.filter_dedupe(chunks, "chunk_id", "content_en", ["source", "page_no"]).select("chunk_id", "source", "page_no", "content_en")


_LISTED = r"regexp_split_to_array(regexp_replace('1 - GINGER— ' || text || ' 2 - WILD MINT— ' || text, '(\b\d+\s*[-–]\s*[A-Z][A-Z\s]+[—-])', chr(1) || '\1', 'g'), chr(1))"
_CHILD = r"(?s)^\s*(\d+)\s*[-–]\s*([A-Z][A-Z\s]+)[—-]?\s*(.*)$"


@query(
    f"""WITH c AS (SELECT 'herb-list-' || doc_id AS parent_id, unnest(ps) AS part, unnest(range(0, len(ps))) AS pos FROM (SELECT doc_id, {_LISTED} AS ps FROM documents)),
 n AS (SELECT parent_id, pos, {INITCAP(SQUASH(f"regexp_extract(part, '{_CHILD}', 2)"))} AS title, {STRIP(f"regexp_extract(part, '{_CHILD}', 3)")} AS body FROM c WHERE regexp_matches(part, '{_CHILD}')),
 s AS (SELECT *, 'herb-' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM n),
 i AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY parent_id, pos) > 1 THEN slug || '-' || substring(md5(title), 1, 6) ELSE slug END AS id FROM s)
 SELECT id, parent_id, title, body, '' AS children FROM i UNION ALL
 SELECT p.parent_id, NULL, 'List', any_value(p.lead), string_agg(i.id, ',' ORDER BY pos) FROM i JOIN (SELECT 'herb-list-' || doc_id AS parent_id, {LEAD} AS lead FROM (SELECT doc_id, '1 - GINGER— ' || text || ' 2 - WILD MINT— ' || text AS text FROM documents)) p USING (parent_id) GROUP BY p.parent_id"""
)
def st_split_children(spark, sf_dir):
    names = F.concat(F.lit("1 - GINGER— "), F.col("text"), F.lit(" 2 - WILD MINT— "), F.col("text"))
    d = documents(spark, sf_dir).select(F.concat(F.lit("herb-list-"), F.col("doc_id")).alias("id"), F.lit("List").alias("title"), names.alias("content_en"))
    return S.split_children(d)


_BARE = rf"regexp_replace(lower({STRIP('line')}), '^(?:\d+[\).\s-]+|[-–—•]\s*)', '')"
_KEY = "CASE " + " ".join(rf"WHEN regexp_matches({_BARE}, '^(?:{'|'.join(w)})\s*(?:[:\-–—].*)?$') THEN '{k}'" for k, w in S.HEADINGS.items()) + " END"
_BLOCKS = rf"""WITH {BOOK}, m AS (SELECT *, {_KEY} AS k FROM book),
 b AS (SELECT *, sum(CASE WHEN k IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM m),
 s AS (SELECT source, page_no, block, coalesce(max(k), 'overview') AS section, {STRIP(f"string_agg(CASE WHEN k IS NULL THEN line ELSE regexp_extract({STRIP('line')}, '[:\\-–—]\\s*(.+)$', 1) END, chr(10) ORDER BY pos)")} AS body FROM b GROUP BY ALL)
 SELECT source, page_no, section, string_agg(body, chr(10) || chr(10) ORDER BY block) AS body FROM s WHERE body <> '' GROUP BY ALL"""


@query(_BLOCKS)
def st_find_blocks(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", F.explode(S.find_blocks("text")).alias("section", "body"))


_ORDER = "CASE section " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.TITLES)) + " END"
_NAME = "CASE section " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in S.TITLES.items()) + " END"


@query(
    f"""WITH {BOOK_PAGES}, f AS (SELECT source, page_no, max(CASE WHEN section <> 'overview' THEN 1 ELSE 0 END) AS found, string_agg({_NAME} || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY {_ORDER}) AS built FROM ({_BLOCKS}) GROUP BY ALL)
 SELECT p.source, p.page_no, CASE WHEN f.found = 1 THEN f.built ELSE p.text END AS body FROM book_pages p LEFT JOIN f ON p.page_no = f.page_no AND p.source = f.source"""
)
def st_rebuild_sections(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", S.rebuild_sections("text").alias("body"))


_HEADER = S.HEADER
_HNAME = rf"regexp_replace(trim(regexp_extract(line, '{_HEADER}', 1)), '\s+', ' ', 'g')"
_HSLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g')"
_TOC = rf"""WITH {BOOK}, m AS (SELECT *, regexp_matches(line, '{_HEADER}') AS head FROM book),
 b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM m),
 s AS (SELECT source, page_no, block, coalesce(max(CASE WHEN head THEN CASE WHEN upper({_HNAME}) = {_HNAME} THEN {INITCAP(_HNAME)} ELSE {_HNAME} END END), 'Overview') AS title, {STRIP('string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos)')} AS body FROM b GROUP BY ALL)
 SELECT source, page_no, title, body, CASE WHEN {_HSLUG} = '' THEN 'section' ELSE {_HSLUG} END AS slug FROM s WHERE body <> ''"""


@query(_TOC)
def st_toc(spark, sf_dir):
    return book_pages(spark, sf_dir).select("source", "page_no", F.inline(S.toc("text")))


@query(f"SELECT source, page_no, {_rules('lower(title)', [(k, '|'.join(S.HEADINGS[k])) for k in ('treatment', 'causes', 'symptoms')]).replace('general', 'overview')} AS bucket, count(*) AS n, sum(length(body)) AS chars FROM ({_TOC}) GROUP BY ALL")
def st_categorize_sections(spark, sf_dir):
    parts = book_pages(spark, sf_dir).select("source", "page_no", F.inline(S.toc("text")))
    return parts.groupBy("source", "page_no", S.section_bucket(F.col("title")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


@query(
    f"""WITH {ITEMS}, e AS (SELECT id, CASE doc_id % 4 WHEN 0 THEN 'herb-' ELSE 'disease-' END || (doc_id + 3) AS target FROM items)
 SELECT e.id, e.target, coalesce(i.title, e.target) AS title FROM e LEFT JOIN items i ON i.id = e.target"""
)
def st_link_edges(spark, sf_dir):
    linked = F.concat(F.coalesce("content_en", "content_sw"), F.lit(" [["), F.when(F.col("doc_id") % 4 == 0, F.lit("herb-")).otherwise(F.lit("disease-")), F.col("doc_id") + 3, F.lit("]]"))
    return S.link_edges(items(spark, sf_dir), linked)


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents), k AS (SELECT doc_id, ws, unnest(range(0, CAST(greatest(ceil((len(ws) - 361) / 128.0), 0) + 1 AS BIGINT))) AS "window" FROM w WHERE len(ws) > 0)
 SELECT doc_id, CAST("window" AS INT) AS "window", CAST("window" * 128 AS INT) AS start, len(ws["window" * 128 + 1:"window" * 128 + 361]) AS n_words, array_to_string(ws["window" * 128 + 1:"window" * 128 + 361], ' ') AS piece FROM k"""
)
def st_overlap_windows(spark, sf_dir):
    return S.overlap_windows(documents(spark, sf_dir), "doc_id", "text", 20)
