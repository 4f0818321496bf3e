"""Queries for translation as data work. The translator here is a stand-in that SQL can express: upper case."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import translate as R
from ..operators.ordered import shared_folder
from .inputs import BOOK_PAGES, ITEMS, book_pages, documents, items
from .registry import query
from .structure_queries import packed
from .text_queries import STRIP


def shout(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


def work(spark, sf_dir) -> DataFrame:
    """Items of which some have a translation, in some state."""
    its = items(spark, sf_dir)
    return its.select("doc_id", "id", "title", "content_en", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("sw "), "title")).otherwise(F.col("content_sw")).alias("content_sw"), F.when(F.col("doc_id") % 6 == 0, F.lit("human")).otherwise(F.lit("original")).alias("status"), "source_file")


_WORK = f"{ITEMS}, work AS (SELECT doc_id, id, title, content_en, CASE WHEN doc_id % 4 = 0 THEN 'sw ' || title ELSE content_sw END AS content_sw, CASE WHEN doc_id % 6 = 0 THEN 'human' ELSE 'original' END AS status, source_file FROM items)"
_EARLIER = "earlier AS (SELECT id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'old ' || title END AS content_sw, 'machine' AS status FROM work WHERE doc_id % 3 = 0)"
_BLANK = lambda c: f"coalesce({STRIP(c)}, '') = ''"


@query(f"WITH {_WORK} SELECT id, title FROM work WHERE NOT {_BLANK('content_en')} AND {_BLANK('content_sw')}")
def tr_worklist(spark, sf_dir):
    return R.worklist(work(spark, sf_dir)).select("id", "title")


@query(f"WITH {_WORK}, {_EARLIER} SELECT w.id, CASE WHEN {_BLANK('w.content_sw')} AND NOT {_BLANK('e.content_sw')} THEN {STRIP('e.content_sw')} ELSE w.content_sw END AS content_sw, CASE WHEN {_BLANK('w.content_sw')} AND NOT {_BLANK('e.content_sw')} THEN e.status ELSE w.status END AS status FROM work w LEFT JOIN earlier e USING (id)")
def tr_resume(spark, sf_dir):
    w = work(spark, sf_dir)
    earlier = w.filter(F.col("doc_id") % 3 == 0).select("id", F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("old "), "title")).alias("content_sw"), F.lit("machine").alias("status"))
    return R.resume(w, earlier).select("id", "content_sw", "status")


@query(f"WITH {_WORK} SELECT id, CASE WHEN status = 'original' AND content_sw IS NOT NULL THEN 'machine' ELSE status END AS status FROM work")
def tr_status(spark, sf_dir):
    return work(spark, sf_dir).select("id", R.status_after(F.col("content_sw").isNotNull(), F.col("status")).alias("status"))


_SENTENCES = r"list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: x <> '')"


@query(
    rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {STRIP('x')}), lambda x: x <> '') AS ps FROM documents), p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS paragraph FROM d),
 k AS (SELECT doc_id, paragraph, {packed(_SENTENCES, 300)} AS cs FROM p) SELECT doc_id, CAST(paragraph AS INT) AS paragraph, CAST(unnest(range(0, len(cs))) AS INT) AS place, unnest(cs) AS segment FROM k"""
)
def tr_segment_sentences(spark, sf_dir):
    return R.sentence_packs(documents(spark, sf_dir), "doc_id", "text")


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents), k AS (SELECT doc_id, ws, unnest(range(0, CAST(floor((len(ws) - 1) / 480.0) + 1 AS BIGINT))) AS place FROM w WHERE len(ws) > 0)
 SELECT doc_id, CAST(place AS INT) AS place, array_to_string(ws[place * 480 + 1:place * 480 + 480], ' ') AS segment FROM k"""
)
def tr_segment_windows(spark, sf_dir):
    return R.word_windows(documents(spark, sf_dir), "doc_id", "text")


_STRUCT = r"^\s*([#>\-*\d.)]+)\s*$"


@query(rf"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, array_to_string(list_transform(ls, lambda x: CASE WHEN trim(x) <> '' AND NOT regexp_matches(x, '{_STRUCT}') THEN replace(upper(x), 'ẞ', 'SS') ELSE x END), chr(10)) AS translated FROM l")
def tr_line_memory(spark, sf_dir):
    """Through a memory that lasts, which is empty at first."""
    return R.line_memory(documents(spark, sf_dir), "doc_id", "text", shout, memory=f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}")


@query("SELECT doc_id, replace(upper(text), 'ẞ', 'SS') AS translated FROM documents")
def tr_translate(spark, sf_dir):
    return R.translate(documents(spark, sf_dir).select("doc_id", "text"), "text", shout).select("doc_id", "translated")


_TERMS = ("and", "the", "der die", "una")
_MARKED = "text"
for _term in _TERMS:
    _MARKED = f"regexp_replace({_MARKED}, '(?i){_term}', '[[T#]]', 'g')"


@query(f"SELECT doc_id, {_MARKED} AS protected, len(regexp_extract_all(coalesce({_MARKED}, ''), '\\[\\[T#\\]\\]')) AS n_marks, text AS restored FROM documents")
def tr_protect(spark, sf_dir):
    """Places of protected terms, with the numbers of the marks left out, and the text that they give back."""
    guarded = R.protect(documents(spark, sf_dir).select("doc_id", "text"), "text", list(_TERMS))
    return guarded.select("doc_id", F.regexp_replace("protected", r"\[\[T\d+\]\]", "[[T#]]").alias("protected"), F.size("marks").cast("long").alias("n_marks"), R.restore("protected", "marks").alias("restored"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)ther', '<T>', 'g'), '(?i)\b(?:of|de)\b', 'ya', 'g') AS text FROM documents")
def tr_glossary_apply(spark, sf_dir):
    one = R.apply_glossary("text", [("ther", "<T>")])
    return documents(spark, sf_dir).select("doc_id", R.apply_glossary(one, [("of", "ya"), ("de", "ya")], whole_words=True).alias("text"))


@query(
    f"""WITH {_WORK}, rows AS (SELECT source_file AS file_key, id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'new ' || title END AS content_sw, 1 AS pos FROM work WHERE doc_id % 2 = 0 UNION ALL SELECT source_file, id, 'newer ' || title, 2 FROM work WHERE doc_id % 10 = 0),
 l AS (SELECT file_key, id, arg_max(content_sw, pos) AS sw FROM rows WHERE trim(content_sw) <> '' GROUP BY ALL)
 SELECT w.id, CASE WHEN l.sw IS NOT NULL AND {_BLANK('w.content_sw')} THEN l.sw ELSE w.content_sw END AS content_sw, l.sw IS NOT NULL AND {_BLANK('w.content_sw')} AS updated FROM work w LEFT JOIN l ON l.id = w.id AND l.file_key = w.source_file"""
)
def tr_apply_by_id(spark, sf_dir):
    w = work(spark, sf_dir).withColumnRenamed("source_file", "file_key")
    one = w.filter(F.col("doc_id") % 2 == 0).select("file_key", "id", F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("new "), "title")).alias("content_sw"), F.lit(1).alias("pos"))
    two = w.filter(F.col("doc_id") % 10 == 0).select("file_key", "id", F.concat(F.lit("newer "), "title").alias("content_sw"), F.lit(2).alias("pos"))
    return R.apply_by_id(w, one.unionByName(two)).select("id", "content_sw", "updated")


@query(
    """WITH f AS (SELECT source, lang, count(*) AS n, source || '/' || lang AS path, 'Pack-' || source || CASE lang WHEN 'en' THEN '.cleaned' WHEN 'fr' THEN '_translation_sw' WHEN 'de' THEN '.cleaned_translations_sw_TZ' ELSE '' END AS stem FROM documents GROUP BY ALL),
 k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), '(_(cleaned|translations?|swa?|sw_ke|sw_tz))+$', '') AS file_key FROM f)
 SELECT path, stem, n AS rows, file_key FROM (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY n DESC, path) AS r FROM k) WHERE r = 1"""
)
def tr_match_files(spark, sf_dir):
    files = documents(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"))
    tail = F.when(F.col("lang") == "en", F.lit(".cleaned")).when(F.col("lang") == "fr", F.lit("_translation_sw")).when(F.col("lang") == "de", F.lit(".cleaned_translations_sw_TZ")).otherwise(F.lit(""))
    files = files.select(F.concat_ws("/", "source", "lang").alias("path"), F.concat(F.lit("Pack-"), "source", tail).alias("stem"), "rows")
    return R.match_files(files)


_LINES = lambda x: f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x: CASE WHEN trim(x) <> '' AND NOT regexp_matches(x, '{_STRUCT}') THEN replace(upper(x), 'ẞ', 'SS') ELSE x END), chr(10))"


@query(
    f"""WITH {BOOK_PAGES}, i AS (SELECT page_no AS id, page_no % 3 AS kind, text, nullif({STRIP('text')}, '') AS body, CASE WHEN page_no % 2 = 0 THEN 'the hand' END AS sw FROM book_pages),
 s AS (SELECT id, kind, text, CASE WHEN kind = 0 THEN concat_ws(chr(10) || chr(10), 'PAGE ' || id, {_LINES('body')}) || chr(10) || chr(10) || 'END' WHEN sw IS NOT NULL THEN sw ELSE {_LINES('text')} END AS c FROM i),
 g AS (SELECT *, regexp_replace(c, '(?i)the', '<T>', 'g') AS g FROM s)
 SELECT id, CASE WHEN kind = 0 THEN 2 ELSE -1 END AS n_sections, g AS content_sw, coalesce({STRIP('text')}, '') = '' OR coalesce({STRIP('g')}, '') = '' AS needs_review FROM g"""
)
def tr_sections(spark, sf_dir):
    """Every third page in two sections, the others without; some have a translation of their own."""
    pages = book_pages(spark, sf_dir)
    part = lambda t, b: F.struct(t.alias("title"), b.alias("body"))
    own = F.when(F.col("page_no") % 3 == 0, F.array(part(F.concat(F.lit("Page "), F.col("page_no")), F.col("text")), part(F.lit(""), F.lit("end")))).otherwise(F.when(F.col("page_no") % 3 == 1, F.array().cast("array<struct<title:string,body:string>>")))
    its = pages.select(F.col("page_no").alias("id"), F.col("text").alias("content_en"), F.when(F.col("page_no") % 2 == 0, F.lit("the hand")).alias("content_sw"), own.alias("sections"), F.lit(True).alias("needs_review"))
    done = R.translate_sections(its, shout, [("the", "<T>")])
    return done.select("id", F.when(F.col("sections_sw").isNull(), -1).otherwise(F.size("sections_sw")).alias("n_sections"), "content_sw", "needs_review")


@query(f"WITH {_WORK} SELECT id, content_sw, replace(upper(content_sw), 'ẞ', 'SS') AS back FROM (SELECT * FROM work ORDER BY doc_id LIMIT 50) WHERE NOT {_BLANK('content_sw')}")
def tr_backcheck_sample(spark, sf_dir):
    return R.backcheck(work(spark, sf_dir), "doc_id", shout).select("id", "content_sw", "back")
