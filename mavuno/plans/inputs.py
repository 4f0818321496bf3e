"""What the queries read: the given tables in the shapes that the library works on, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def family(doc_id: Column) -> Column:
    return F.element_at(F.array(F.lit("herb"), F.lit("disease"), F.lit("principle")), (F.pmod(doc_id, F.lit(3)) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as content items: English texts are the one side, all others the other; some images are missing."""
    d = documents(spark, sf_dir)
    title = T.trim_blanks(F.substring(F.regexp_extract("text", r"^[^.!?\n]*", 0), 1, 60))
    english = F.col("lang") == "en"
    return d.select(
        F.concat_ws("-", family(F.col("doc_id")), F.col("doc_id")).alias("id"),
        "doc_id",
        title.alias("title"),
        F.when(english, F.col("text")).alias("content_en"),
        F.when(~english, F.col("text")).alias("content_sw"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("img/"), F.col("doc_id"), F.lit(".jpg"))).alias("image"),
        F.concat(F.col("source"), F.lit(".json")).alias("source_file"),
    )


ITEMS = r"""items AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'herb' WHEN 1 THEN 'disease' ELSE 'principle' END || '-' || doc_id AS id, doc_id,
 trim(substring(regexp_extract(text, '^[^.!?\n]*'), 1, 60)) AS title,
 CASE WHEN lang = 'en' THEN text END AS content_en, CASE WHEN lang <> 'en' THEN text END AS content_sw,
 CASE WHEN doc_id % 5 > 0 THEN 'img/' || doc_id || '.jpg' END AS image, source || '.json' AS source_file FROM documents)"""

LABELS = ("Symptoms", "Causes:", "TREATMENT", "Diet -", "Notes", "Remedies:")


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the pages of books, a book for each source, with headings and labels where prose has none: every seventh
    line of a page is replaced by its first words in capitals, and the line two below by one of LABELS."""
    d = documents(spark, sf_dir).select("source", F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("source", "page_no", F.col("pos").cast("long").alias("pos"), _shaped(F.col("page_no"), F.col("pos"), F.col("line")).alias("line"))


def _shaped(page: Column, pos: Column, line: Column) -> Column:
    head = F.upper(F.regexp_extract(F.regexp_replace(line, "[^A-Za-z ]", ""), r"^ *[A-Za-z]+(?: [A-Za-z]+)?", 0))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(page + pos, F.lit(6)) + 1).cast("int"))
    return F.when(pos % 7 == 0, F.trim(head)).when(pos % 7 == 2, label).otherwise(line)


_LABEL_SQL = "list_extract([" + ", ".join(f"'{x}'" for x in LABELS) + "], CAST((page_no + pos) % 6 + 1 AS INT))"
BOOK = rf"""raw AS (SELECT source, doc_id AS page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
book AS (SELECT source, page_no, pos, CASE WHEN pos % 7 = 0 THEN trim(upper(regexp_extract(regexp_replace(line, '[^A-Za-z ]', '', 'g'), '^ *[A-Za-z]+(?: [A-Za-z]+)?')))
 WHEN pos % 7 = 2 THEN {_LABEL_SQL} ELSE line END AS line FROM raw)"""


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, page_no, text) of the same books."""
    d = documents(spark, sf_dir)
    lines = F.transform(F.split("text", "\n"), lambda x, i: _shaped(F.col("doc_id"), i, x))
    return d.select("source", F.col("doc_id").alias("page_no"), F.array_join(lines, "\n").alias("text"))


BOOK_PAGES = BOOK + ", book_pages AS (SELECT source, page_no, string_agg(line, chr(10) ORDER BY pos) AS text FROM book GROUP BY ALL)"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reading activity: the article and how far it was read."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "ts", "user_id", "event_type", k.alias("k"), F.concat(F.lit("article-"), k % 40).alias("article_id"), F.round(F.pmod("value", F.lit(1.0)), 4).alias("percent"))


ACTIVITY = "activity AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'article-' || (CAST(json_extract(props, '$.k') AS BIGINT) % 40) AS article_id, round(value - floor(value), 4) AS percent FROM events)"
