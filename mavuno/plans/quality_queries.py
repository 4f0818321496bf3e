"""Queries for checks, gap reports and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import json_schema as J
from ..operators import quality as Q
from .inputs import ITEMS, documents, items, table
from .registry import query
from .text_queries import SQUASH, STRIP


def _flawed(spark, sf_dir):
    """Items with faults: some ids, titles and contents are taken away or spoilt."""
    return items(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 17 == 0, F.lit("")).when(F.col("doc_id") % 13 == 0, F.upper("id")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("doc_id") % 7 > 0, F.col("content_en")).alias("content_en"),
        "content_sw",
        "image",
        F.when(F.col("doc_id") % 19 == 0, F.lit("synonyms.json")).otherwise(F.col("source_file")).alias("source_file"),
        F.when(F.col("doc_id") % 23 == 0, F.array(F.lit("too_short"))).alias("missing_fields"),
    )


_FLAWED = f"""{ITEMS}, flawed AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN upper(id) ELSE id END AS id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE title END AS title,
 CASE WHEN doc_id % 7 > 0 THEN content_en END AS content_en, content_sw, image, CASE WHEN doc_id % 19 = 0 THEN 'synonyms.json' ELSE source_file END AS source_file, doc_id % 23 = 0 AS too_short FROM items)"""


@query(
    f"""WITH {_FLAWED}, e AS (SELECT id, unnest([CASE WHEN id = '' THEN 'missing id' END, CASE WHEN coalesce(title, '') = '' THEN 'missing title' END, CASE WHEN NOT regexp_matches(id, '^[a-z0-9-]+$') THEN 'malformed id' END,
 CASE WHEN coalesce(content_en, '') = '' AND coalesce(content_sw, '') = '' THEN 'no content' END]) AS error FROM flawed) SELECT * FROM e WHERE error IS NOT NULL"""
)
def qa_validate_items(spark, sf_dir):
    return Q.item_errors(_flawed(spark, sf_dir))


def _json_items(spark, sf_dir):
    """Items as JSON texts, of which some have a value of another type than the schema says, lack a field, or are no JSON."""
    n, quoted = F.col("doc_id"), lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    fields = [
        F.when(n % 17 > 0, F.concat(F.lit('"id":'), F.when(n % 13 == 0, n.cast("string")).otherwise(quoted(F.when(n % 29 == 0, F.lit("x")).otherwise(F.col("id")))))),
        F.concat(F.lit('"title":'), quoted("title")),
        F.concat(F.lit('"contentEn":'), F.coalesce(quoted("content_en"), F.lit("null"))),
        F.concat(F.lit('"tags":'), F.when(n % 5 == 0, quoted("source_file")).when(n % 7 == 0, F.lit('["a",1,null]')).otherwise(F.lit('["a","b"]'))),
        F.concat(F.lit('"needsReview":'), F.when(n % 11 == 0, F.lit('"yes"')).otherwise(F.lit("true"))),
        F.concat(F.lit('"imageMeta":'), F.when(n % 19 == 0, F.lit("[]")).otherwise(F.lit('{"width":3}'))),
        F.lit('"more":{"a":[1,2]}'),
    ]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return items(spark, sf_dir).select("doc_id", F.when(n % 31 == 0, F.lit("{no json")).when(n % 37 == 0, F.lit("[1]")).otherwise(whole).alias("json"))


_JSON_ERRORS = """[CASE WHEN doc_id % 17 = 0 THEN ('id', 'required') WHEN doc_id % 13 = 0 THEN ('id', 'type string') WHEN doc_id % 29 = 0 OR length(id) < 3 THEN ('id', 'minLength 3') END,
 CASE WHEN title IS NULL THEN ('title', 'type string') WHEN length(title) < 2 THEN ('title', 'minLength 2') END, CASE WHEN content_en IS NULL THEN ('contentEn', 'type string') END,
 CASE WHEN doc_id % 5 = 0 THEN ('tags', 'type array') WHEN doc_id % 7 = 0 THEN ('tags[1]', 'type string') END, CASE WHEN doc_id % 5 > 0 AND doc_id % 7 = 0 THEN ('tags[2]', 'type string') END,
 CASE WHEN doc_id % 11 = 0 THEN ('needsReview', 'type boolean') END, CASE WHEN doc_id % 19 = 0 THEN ('imageMeta', 'type object') END]"""


@query(
    f"""WITH {ITEMS}, e AS (SELECT doc_id, unnest(CASE WHEN doc_id % 31 = 0 THEN [('', 'json')] WHEN doc_id % 37 = 0 THEN [('', 'type object')] ELSE {_JSON_ERRORS} END) AS e FROM items)
 SELECT doc_id, e[1] AS path, e[2] AS rule FROM e WHERE e IS NOT NULL"""
)
def qa_schema_check(spark, sf_dir):
    return J.schema_errors(_json_items(spark, sf_dir), Q.ITEM_SCHEMA)


@query(f"WITH {_FLAWED}, s AS (SELECT regexp_extract(title, '^[A-Za-z]*') AS id, source_file, doc_id FROM flawed) SELECT id, count(*) AS n, arg_min(source_file, (source_file, doc_id)) AS first_source_file, arg_min(doc_id, (source_file, doc_id)) AS first_doc_id FROM (SELECT id, source_file, doc_id FROM s) GROUP BY id HAVING count(*) > 1")
def qa_duplicate_ids(spark, sf_dir):
    named = _flawed(spark, sf_dir).withColumn("id", F.regexp_extract("title", "^[A-Za-z]*", 0))
    return Q.duplicate_ids(named, order=("source_file", "doc_id"))


_WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[1:3], lambda x: lower(x))"


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no JSON' WHEN doc_id % 7 = 0 THEN 'no object' WHEN doc_id % 5 = 0 THEN 'not a list' WHEN doc_id % 3 = 0 THEN 'not texts' END AS error, coalesce(w[1], 'none') AS term FROM d)
 SELECT doc_id, CASE WHEN error IN ('not a list', 'not texts') THEN term END AS term, error FROM e WHERE error IS NOT NULL"""
)
def qa_synonyms_check(spark, sf_dir):
    """Synonym files made of the first words of each document, of which some are not what they should be."""
    n, w = F.col("doc_id"), F.transform(F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), 1, 3), F.lower)
    rows = documents(spark, sf_dir).select("doc_id", F.coalesce(F.get(w, F.lit(0)), F.lit("none")).alias("term"), F.to_json(w).alias("list"))
    value = F.when(n % 5 == 0, F.lit('"text"')).when(n % 3 == 0, F.lit('["text",{"a":1}]')).otherwise(F.col("list"))
    whole = F.concat(F.lit('{"'), "term", F.lit('":'), value, F.lit(',"zz zz":["a","b c"]}'))
    return J.synonym_errors(rows.select("doc_id", F.when(n % 11 == 0, F.lit("{")).when(n % 7 == 0, F.col("list")).otherwise(whole).alias("json")))


def _lacks(k: str) -> str:
    return f"NOT regexp_matches(lower(coalesce(nullif({STRIP('content_sw')}, ''), nullif({STRIP('content_en')}, ''), '')), '{Q.GAP_WORDS[k]}')"


@query(
    f"""WITH {_FLAWED}, g AS (SELECT source_file, id, {STRIP('title')} AS title, concat_ws(';', CASE WHEN {STRIP('title')} = '' THEN 'title' END, CASE WHEN coalesce({STRIP('content_en')}, '') = '' AND coalesce({STRIP('content_sw')}, '') = '' THEN 'content' END,
 CASE WHEN coalesce(image, '') = '' THEN 'image' END, {', '.join(f"CASE WHEN {_lacks(k)} THEN 'section:{k}' END" for k in ('treatment', 'causes', 'symptoms'))},
 {', '.join(f"CASE WHEN id LIKE 'herb-%' AND {_lacks(k)} THEN 'section:{k}' END" for k in ('usage', 'habitat'))}) AS missing FROM flawed) SELECT * FROM g WHERE missing <> ''"""
)
def qa_content_gaps(spark, sf_dir):
    return Q.content_gaps(_flawed(spark, sf_dir))


_SHORT = lambda c: f"length(coalesce({SQUASH(c)}, '')) < 400"


@query(
    f"""WITH {_FLAWED} SELECT doc_id, CASE WHEN source_file = 'synonyms.json' THEN 'helper/import file' WHEN id = '' OR title = '' THEN 'missing id/title' WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9\\-]*$') THEN 'malformed id'
 WHEN too_short THEN 'too_short' WHEN {_SHORT('content_en')} AND {_SHORT('content_sw')} THEN 'content too short' END AS reason FROM flawed"""
)
def qa_skip_reasons(spark, sf_dir):
    return _flawed(spark, sf_dir).select("doc_id", Q.skip_reason(400).alias("reason"))


@query(
    f"""WITH {ITEMS}, f AS (SELECT id, image IS NULL AS no_image, coalesce({STRIP('content_sw')}, '') = '' AND coalesce({STRIP('content_en')}, '') <> '' AS untranslated, content_en, content_sw, image FROM items),
 g AS (SELECT *, coalesce(nullif({STRIP('CASE WHEN untranslated THEN content_en ELSE content_sw END')}, ''), nullif({STRIP('content_en')}, ''), '') AS body FROM f)
 SELECT id, CASE WHEN no_image THEN 'images/fallback-' || split_part(id, '-', 1) || '.jpg' ELSE image END AS image, CASE WHEN no_image THEN 'Fallback image' END AS image_credit, body AS content_sw,
 concat_ws(';', CASE WHEN untranslated THEN 'translation' END, CASE WHEN length(body) < 140 THEN 'too_short' END) AS missing, untranslated OR length(body) < 140 AS needs_review FROM g"""
)
def qa_autofill(spark, sf_dir):
    done = Q.autofill(items(spark, sf_dir))
    return done.select("id", "image", "image_credit", "content_sw", F.array_join("missing_fields", ";").alias("missing"), "needs_review")


@query(
    """SELECT 'vectors' AS "check", count(*) AS value FROM embeddings UNION ALL SELECT 'ids', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'dimensions', count(DISTINCT len(embedding)) FROM embeddings
 UNION ALL SELECT 'repeated ids', count(*) FROM (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 1) UNION ALL SELECT 'missing expected ids', count(*) FROM (SELECT DISTINCT doc_id % 37 AS id FROM documents) WHERE id NOT IN (SELECT label FROM embeddings)"""
)
def qa_index_consistency(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("id"), "embedding")
    return Q.index_consistency(index, documents(spark, sf_dir).select((F.col("doc_id") % 37).alias("id")))


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        F.concat(F.element_at(F.array(F.lit("herb"), F.lit("disease"), F.lit("principle")), (F.col("page_id") % 3 + 1).cast("int")), F.lit("-"), (F.col("page_id") % 60) * 3 + F.col("page_id") % 3).alias("item_id"),
        "url",
        (F.length("html") % 1500).cast("long").alias("width"),
        F.when(F.col("page_id") % 4 == 0, F.lit("CC BY")).otherwise(F.lit("")).alias("license"),
    )


_CAND = "cand AS (SELECT CASE page_id % 3 WHEN 0 THEN 'herb' WHEN 1 THEN 'disease' ELSE 'principle' END || '-' || ((page_id % 60) * 3 + page_id % 3) AS item_id, url, length(html) % 1500 AS width, CASE WHEN page_id % 4 = 0 THEN 'CC BY' ELSE '' END AS license FROM pages)"
_BEST = "best AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY width DESC, CASE WHEN license = '' THEN 1 ELSE 0 END, url) AS r FROM cand WHERE width >= 600) WHERE r = 1)"


@query(f"WITH {_CAND}, {_BEST} SELECT * FROM best")
def qa_image_candidates(spark, sf_dir):
    return Q.best_images(_candidates(spark, sf_dir))


@query(
    f"""WITH {ITEMS}, {_CAND}, {_BEST}, r AS (SELECT i.id, i.image, CASE WHEN i.doc_id % 2 = 0 THEN 'manual/' || i.doc_id || '.jpg' END AS m, b.url FROM items i LEFT JOIN best b ON b.item_id = i.id)
 SELECT id, coalesce(image, m, url, 'images/fallback-' || split_part(id, '-', 1) || '.jpg') AS image, CASE WHEN image IS NOT NULL THEN 'existing' WHEN m IS NOT NULL THEN 'manual' WHEN url IS NOT NULL THEN 'found' ELSE 'fallback' END AS outcome FROM r"""
)
def qa_image_resolution(spark, sf_dir):
    its = items(spark, sf_dir)
    manual = its.filter(F.col("doc_id") % 2 == 0).select("id", F.concat(F.lit("manual/"), "doc_id", F.lit(".jpg")).alias("image"))
    return Q.resolve_images(its, manual, _candidates(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN image IS NOT NULL AND doc_id % 2 = 0 THEN 'webp/' || doc_id || '.webp' ELSE image END AS image FROM items")
def qa_rewrite_paths(spark, sf_dir):
    new = documents(spark, sf_dir).filter(F.col("doc_id") % 2 == 0).select(F.col("doc_id").cast("string").alias("stem"), F.concat(F.lit("webp/"), "doc_id", F.lit(".webp")).alias("new_path"))
    return Q.rewrite_paths(items(spark, sf_dir), new)


@query("SELECT doc_id, concat_ws(' ', source, 'plant', array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) <= 20)[1:2], ' ')) AS q FROM documents")
def qa_image_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", Q.image_query("source", F.lit("plant"), F.split("text", " ")).alias("q"))
