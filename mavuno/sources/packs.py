"""Readers and writers: content packs, synonyms, translation tables, glossaries, event logs, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from ..functions import text as T
from ..operators.quality import HELPER_FILES

_S = StringType()
_SECTIONS = ArrayType(StructType([StructField(n, _S) for n in ("title", "body", "text")]))
IMAGE_META = StructType([*[StructField(n, _S) for n in ("source", "source_url", "author", "license", "title", "credit")], StructField("width", IntegerType()), StructField("height", IntegerType())])
#: An item as packs spell it, in either case style; nothing is inferred from the data.
ITEM = StructType(
    [StructField(n, _S) for n in ("id", "title", "contentEn", "content_en", "contentSw", "content_sw", "content", "titleSw", "image", "category", "source")]
    + [StructField("tags", ArrayType(_S)), StructField("aliasesSw", ArrayType(_S)), StructField("missingFields", ArrayType(_S)), StructField("needsReview", BooleanType()), StructField("imageMeta", IMAGE_META), StructField("sections", _SECTIONS), StructField("sectionsSw", _SECTIONS)]
)
PACK = StructType([*ITEM.fields, *[StructField(w, ArrayType(ITEM)) for w in ("items", "data", "records", "list")]])
EVENT = StructType([StructField("type", _S), StructField("ts", _S), StructField("props", MapType(_S, _S))])
STYLE = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
#: As export_corpus_csv writes: blanks count, and what is quoted is never null.
CORPUS_STYLE = {**STYLE, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\u0000\u0001\u0000", "emptyValue": ""}


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Items of all packs under a path, arrays or wrapped in an object, with source_file; helper files are left out."""
    rows = spark.read.schema(PACK).option("multiLine", True).json(path).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rows = rows.filter(~F.lower("source_file").isin(*HELPER_FILES))
    wrapped = F.coalesce("items", "data", "records", "list")
    own = F.array(F.struct(*[F.col(f.name) for f in ITEM.fields]))
    return rows.select("source_file", F.explode(F.coalesce(wrapped, own)).alias("item")).select("source_file", "item.*")


def _sections_text(c: str) -> Column:
    lines = F.flatten(F.transform(F.col(c), lambda s: F.array(*[F.coalesce(s[n], F.lit("")) for n in ("title", "body", "text")])))
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def fold_names(packs: DataFrame) -> DataFrame:
    """One name for each field: camel and snake case, then `content`, then the text of the sections; blank counts as missing."""
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return packs.select(
        "id",
        "title",
        F.coalesce(some("contentEn", "content_en", "content"), _sections_text("sections")).alias("content_en"),
        F.coalesce(some("contentSw", "content_sw"), _sections_text("sectionsSw")).alias("content_sw"),
        F.col("titleSw").alias("title_sw"),
        F.coalesce("aliasesSw", F.array().cast("array<string>")).alias("aliases_sw"),
        "image",
        F.col("imageMeta").alias("image_meta"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("missingFields", F.array().cast("array<string>")).alias("missing_fields"),
        F.coalesce("needsReview", F.lit(False)).alias("needs_review"),
        "source_file",
    )


def read_synonyms(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(lang, term, place, alt), lower case and trimmed, from an object of lists for each language; a language without any
    falls back to the English ones."""
    out = None
    for lang, path in paths.items():
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MapType(_S, ArrayType(_S)))).alias("term", "alts"))
        rows = rows.select(F.lit(lang).alias("lang"), F.lower(F.trim("term")).alias("term"), F.posexplode("alts").alias("place", "alt")).withColumn("alt", F.lower(F.trim("alt")))
        out = rows if out is None else out.unionByName(rows)
    names = spark.createDataFrame([(k,) for k in paths], "lang string")
    lacking = names.join(out.select("lang").distinct(), "lang", "left_anti")
    english = out.filter("lang = 'en'").drop("lang")
    return out.unionByName(lacking.crossJoin(english)) if "en" in paths else out  # a row per language on the left


def delimiter(header: str) -> str:
    """The one of comma, semicolon and tab that the header line has most of."""
    return max(",;\t", key=header.count)


def _tables(spark: SparkSession, path: str) -> list[DataFrame]:
    """The CSV tables under a path, those with one header line together; each is read by its own delimiter and order of columns."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
    heads: dict[str, list[str]] = {}
    for r in first.collect():  # a header for each file
        heads.setdefault(r["head"], []).append(r["file"])
    return [spark.read.options(**STYLE, sep=delimiter(head)).csv(sorted(files)) for head, files in sorted(heads.items()) if head.strip()]


def _by_name(rows: DataFrame) -> Callable[[str], Column]:
    """A column by its name in any case or style, with or without a byte order mark; null where there is none."""
    named = {c.lstrip("\ufeff").strip().lower().replace("_", ""): c for c in rows.columns}
    return lambda k: F.col(f"`{named[k]}`") if k in named else F.lit(None).cast("string")


def read_translation_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, content_sw, source_file) of rows with an id and a text; a missing title is the id. Each file has a delimiter and an order of columns of its own."""
    out = spark.createDataFrame([], "id string, title string, content_sw string, source_file string")
    for rows in _tables(spark, path):
        get = _by_name(rows)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")
        out = out.unionByName(rows.select(T.blank_to_null(get("id")).alias("id"), T.blank_to_null(F.coalesce(get("titlesw"), get("title"))).alias("title"), T.blank_to_null(get("contentsw")).alias("content_sw"), name))
    return out.filter("id IS NOT NULL AND content_sw IS NOT NULL").withColumn("title", F.coalesce("title", "id"))


def read_glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(preserved terms, mapped terms), columns taken by name: `preserve` is yes, true or 1 for what is kept as it is; a term with a translation is
    mapped, preserved or not."""
    rows = spark.createDataFrame([], "en string, sw string, keep boolean")
    for part in _tables(spark, path):
        get = _by_name(part)
        keep = F.lower(F.trim(F.coalesce(get("preserve"), F.lit("")))).isin("yes", "true", "1")
        rows = rows.unionByName(part.select(T.blank_to_null(get("en")).alias("en"), T.blank_to_null(get("sw")).alias("sw"), keep.alias("keep")))
    rows = rows.filter("en IS NOT NULL")
    return rows.filter("keep").select("en").distinct(), rows.filter("sw IS NOT NULL").select("en", "sw")


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(type, ts, props) of a log of JSON lines, as a table or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(path).withColumn("ts", F.to_timestamp("ts"))


def write_by_system(items: DataFrame, path: str) -> None:
    """A folder of JSON packs for each system; a large system is written by several tasks."""
    items.write.mode("overwrite").partitionBy("system").json(path)


def write_chunks(items: DataFrame, chunks: DataFrame, path: str) -> None:
    """Structured items, but those whose fields are all empty, as JSON, and flat chunks as Parquet."""
    items.filter(F.exists(F.map_values("fields"), lambda v: v != "")).write.mode("overwrite").json(f"{path}/structured")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")


def one_line_ends(c: Column | str) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def export_corpus_csv(items: DataFrame, path: str) -> None:
    """id, title, contentEn with plain line ends and the blanks that they have, quoted where they must be; an empty text is quoted, of a null one there is
    nothing; items without an id are left out. To be read with CORPUS_STYLE."""
    rows = items.filter(T.blank_to_null("id").isNotNull()).select("id", one_line_ends("title").alias("title"), one_line_ends("content_en").alias("contentEn"))
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', **whole).csv(path)


def export_worklist_csv(items: DataFrame, path: str) -> None:
    """Items with `needs_translation` = yes where there is none."""
    need = F.when(T.blank_to_null("content_sw").isNull(), F.lit("yes")).otherwise(F.lit(""))
    rows = items.select("id", "title", F.col("content_en").alias("contentEn"), F.coalesce("content_sw", F.lit("")).alias("contentSw"), need.alias("needs_translation"))
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="").csv(path)


def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """One table of vectors and what they stand for, so that no order has to be kept between two files."""
    vectors.withColumn("model", F.lit(model)).withColumn("vector_dim", F.size("embedding")).write.mode("overwrite").parquet(path)
