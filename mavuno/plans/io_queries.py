"""Queries for readers and writers: each writes what the tables give to a new folder of the shared place and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure
from ..sources import packs as P
from .activity_queries import _scratch
from .inputs import ITEMS, book_pages, documents, items, table
from .registry import ORACLES, query


def _pack_folder(spark, sf_dir) -> str:
    """Packs of both forms: an object around a list of items for one half, one item an array or line for the other. A pack
    holds items of a thousand ids, so there are more packs, not larger ones, in a larger table."""
    its = items(spark, sf_dir).select("id", "title", F.when(F.col("doc_id") % 2 == 0, F.col("content_en")).alias("contentEn"), F.when(F.col("doc_id") % 2 == 1, F.col("content_en")).alias("content_en"), F.col("content_sw").alias("contentSw"), "image", "doc_id")
    folder = _scratch(spark)
    its.filter("doc_id % 3 = 0").groupBy(F.floor(F.col("doc_id") / 1000)).agg(F.collect_list(F.struct("id", "title", "contentEn", "content_en", "contentSw", "image")).alias("items")).select(F.to_json(F.struct("items")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/packs/wrapped")
    rows = its.filter("doc_id % 3 > 0").groupBy(F.floor(F.col("doc_id") / 1000)).agg(F.to_json(F.collect_list(F.struct("id", "title", "contentEn", "content_en", "contentSw", "image"))).alias("value")).select("value")
    rows.write.option("maxRecordsPerFile", 1).text(f"{folder}/packs/arrays")
    return f"{folder}/packs/*"


@query(f"WITH {ITEMS} SELECT id, title, image FROM items")
def io_read_pack(spark, sf_dir):
    return P.read_packs(spark, _pack_folder(spark, sf_dir)).select("id", "title", "image")


@query(f"WITH {ITEMS} SELECT id, nullif(content_en, '') AS content_en, nullif(content_sw, '') AS content_sw FROM items")
def io_fold_names(spark, sf_dir):
    return P.fold_names(P.read_packs(spark, _pack_folder(spark, sf_dir))).select("id", "content_en", "content_sw")


@query(
    """WITH w AS (SELECT source AS term, list_sort(list_distinct(list(lower(lang)))) AS alts FROM documents GROUP BY source), s AS (SELECT 'en' AS lang, term, unnest(alts) AS alt, unnest(range(0, len(alts))) AS place FROM w)
 SELECT lang, term, alt, CAST(place AS INT) AS place FROM s UNION ALL SELECT 'sw', term, alt, CAST(place AS INT) FROM s"""
)
def io_read_synonyms(spark, sf_dir):
    folder = _scratch(spark)
    rows = documents(spark, sf_dir).groupBy(F.upper("source").alias("source")).agg(F.array_sort(F.collect_set(F.concat(F.lit(" "), F.upper("lang")))).alias("alts"))
    rows.select(F.to_json(F.create_map("source", "alts")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/en")
    spark.createDataFrame([("{}",)], "value string").write.text(f"{folder}/sw")
    return P.read_synonyms(spark, {"en": f"{folder}/en", "sw": f"{folder}/sw"})


@query(f"WITH {ITEMS} SELECT id, coalesce(nullif(title, ''), id) AS title, regexp_replace(content_sw, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') AS content_sw FROM items WHERE doc_id % 9 > 0 AND coalesce(trim(content_sw), '') <> ''")
def io_read_translation_csv(spark, sf_dir):
    folder = _scratch(spark)
    rows = items(spark, sf_dir).select(F.when(F.col("doc_id") % 9 > 0, F.col("id")).otherwise(F.lit(" ")).alias("ID"), F.col("title").alias("TitleSw"), F.col("content_sw").alias("contentsw"))
    rows.write.options(header=True, quote='"', escape='"', sep=";", quoteAll=True).csv(folder)
    return P.read_translation_csv(spark, folder).select("id", "title", "content_sw")


@query("WITH s AS (SELECT source, CAST(replace(source, 'src', '') AS INT) AS n FROM documents GROUP BY source) SELECT 'preserve' AS kind, source AS en, NULL AS sw FROM s WHERE n % 3 = 0 UNION ALL SELECT 'map', source, 'sw ' || source FROM s WHERE n % 2 = 0")
def io_read_glossary(spark, sf_dir):
    folder = _scratch(spark)
    n = F.replace("source", F.lit("src"), F.lit("")).cast("int")
    rows = documents(spark, sf_dir).select("source").distinct().select(F.when(n % 3 == 0, F.lit("Yes")).otherwise(F.lit("")).alias("preserve"), F.col("source").alias("en"), F.when(n % 2 == 0, F.concat(F.lit("sw "), "source")).alias("SW"))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(folder)
    kept, mapped = P.read_glossary(spark, folder)
    return kept.select(F.lit("preserve").alias("kind"), "en", F.lit(None).cast("string").alias("sw")).unionByName(mapped.select(F.lit("map").alias("kind"), "en", "sw"))


@query("SELECT event_type AS type, epoch_us(ts) // 1000 AS ms, json_extract_string(props, '$.k') AS k FROM events")
def io_read_events(spark, sf_dir):
    folder = _scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("ts"), F.from_json("props", "map<string,string>").alias("props"))
    rows.write.json(folder)
    return P.read_events(spark, folder).select("type", F.unix_millis("ts").alias("ms"), F.element_at("props", "k").alias("k"))


@query(ORACLES["st_detect_system"])
def io_write_by_system(spark, sf_dir):
    folder = _scratch(spark)
    P.write_by_system(items(spark, sf_dir).select("id", structure.detect_system("title").alias("system")), folder)
    return spark.read.schema("id string, system string").json(folder)


@query(ORACLES["st_facet_chunks"])
def io_write_chunks(spark, sf_dir):
    folder = _scratch(spark)
    pages = book_pages(spark, sf_dir)
    its = pages.select(F.lit("condition").alias("type"), F.concat(F.lit("Page "), F.col("page_no") % 200).alias("title"), "source", "page_no", structure.split_subsections("text").alias("fields"))
    P.write_chunks(its, structure.facet_chunks(its), folder)
    return spark.read.parquet(f"{folder}/chunks")


@query(f"WITH {ITEMS} SELECT id, nullif(title, '') AS title, content_en AS \"contentEn\" FROM items")
def io_export_corpus_csv(spark, sf_dir):
    folder = _scratch(spark)
    P.export_corpus_csv(items(spark, sf_dir), folder)
    rows = spark.read.options(**P.CORPUS_STYLE).schema("id string, title string, contentEn string").csv(folder)
    return rows.withColumn("title", F.nullif(F.col("title"), F.lit("")))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN coalesce(trim(content_sw), '') = '' THEN 'yes' END AS needs_translation, nullif(content_sw, '') AS \"contentSw\" FROM items")
def io_export_worklist_csv(spark, sf_dir):
    folder = _scratch(spark)
    P.export_worklist_csv(items(spark, sf_dir), folder)
    return spark.read.options(**P.STYLE).schema("id string, title string, contentEn string, contentSw string, needs_translation string").csv(folder).select("id", "needs_translation", "contentSw")


@query("SELECT vec_id AS id, 'table' AS model, CAST(len(embedding) AS INT) AS vector_dim, round(CAST(list_sum(embedding) AS DOUBLE), 3) + 0.0 AS total FROM embeddings")
def io_write_vectors(spark, sf_dir):
    folder = _scratch(spark)
    P.write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), folder, "table")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(folder).select("id", "model", "vector_dim", (F.round(total, 3) + F.lit(0.0)).alias("total"))
