"""Checks, gap reports and automatic completion of content items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import rebuild_sections

ID = r"^[a-z0-9-]+$"
INDEX_ID = r"^[a-z0-9][a-z0-9\-]*$"

# Words that show a section in either language, images by family, helper files and ids that are not indexed.
GAP_WORDS = {
    "treatment": "treatment|matibabu|tiba",
    "causes": "cause|sababu|visababishi|vyanzo",
    "symptoms": "symptom|dalili|ishara|viashiria",
    "usage": "how to use|usage|jinsi ya kutumia|matumizi",
    "habitat": "where found|habitat|inapatikana|hukua",
}
FALLBACK_IMAGES = {"herb": "images/fallback-herb.jpg", "disease": "images/fallback-disease.jpg", "principle": "images/fallback-principle.jpg"}
#: Fixed: the documented shape of an item.
ITEM_SCHEMA = {
    "type": "object",
    "required": ["id", "title"],
    "properties": {
        "id": {"type": "string", "minLength": 3},
        "title": {"type": "string", "minLength": 2},
        "contentEn": {"type": "string"},
        "contentSw": {"type": "string"},
        "tags": {"type": "array", "items": {"type": "string"}},
        "image": {"type": "string"},
        "imageMeta": {"type": "object"},
        "category": {"type": "string"},
        "source": {"type": "string"},
        "needsReview": {"type": "boolean"},
        "missingFields": {"type": "array", "items": {"type": "string"}},
    },
    "additionalProperties": True,
}
HELPER_FILES = ("synonyms.json", "sw_import.json")
SKIP_IDS = ("principle-section-0",)


def _missing(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def item_errors(items: DataFrame) -> DataFrame:
    """(id, error), a row for each fault: no id, no title, an id outside the pattern, no content in either language."""
    faults = F.array_compact(
        F.array(
            F.when(_missing("id"), F.lit("missing id")),
            F.when(_missing("title"), F.lit("missing title")),
            F.when(~F.coalesce(F.col("id"), F.lit("")).rlike(ID), F.lit("malformed id")),
            F.when(_missing("content_en") & _missing("content_sw"), F.lit("no content")),
        )
    )
    return items.select("id", F.explode(faults).alias("error"))


def duplicate_ids(items: DataFrame, key: str = "id", order: tuple[str, ...] = ("source_file",), by: tuple[str, ...] = ()) -> DataFrame:
    """Ids seen more than once over all files and languages, how often, and where first. Only keys are shuffled. `by`, for
    instance the language, counts ids apart."""
    seen = items.groupBy(key, *by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    return seen.filter("n > 1").select(key, *by, "n", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order])


def content_gaps(items: DataFrame) -> DataFrame:
    """(source_file, id, title, missing) of items that lack something; sections are looked for in the other language's text
    first, then in the English one; herbs need usage and habitat too."""
    en, sw = T.blank_to_null("content_en"), T.blank_to_null("content_sw")
    body = F.lower(F.coalesce(sw, en, F.lit("")))
    lacks = lambda k: ~body.rlike(GAP_WORDS[k])
    herb = F.col("id").startswith("herb-")
    missing = F.concat_ws(
        ";",
        F.when(T.blank_to_null("title").isNull(), F.lit("title")),
        F.when(en.isNull() & sw.isNull(), F.lit("content")),
        F.when(T.blank_to_null("image").isNull(), F.lit("image")),
        *[F.when(lacks(k), F.lit(f"section:{k}")) for k in ("treatment", "causes", "symptoms")],
        *[F.when(herb & lacks(k), F.lit(f"section:{k}")) for k in ("usage", "habitat")],
    )
    return items.select("source_file", "id", F.coalesce(T.strip("title"), F.lit("")).alias("title"), missing.alias("missing")).filter("missing <> ''")


def skip_reason(least: int = 80) -> Column:
    """Why an item is not indexed, the first reason that holds; null if it is."""
    short = lambda c: F.length(F.coalesce(T.squash_ws(c), F.lit(""))) < least
    return (
        F.when(F.col("source_file").isin(*HELPER_FILES), F.lit("helper/import file"))
        .when(_missing("id") | _missing("title"), F.lit("missing id/title"))
        .when(F.col("id").isin(*SKIP_IDS), F.lit("skip-id"))
        .when(~F.col("id").rlike(INDEX_ID), F.lit("malformed id"))
        .when(F.array_contains(F.coalesce("missing_fields", F.array().cast("array<string>")), "too_short"), F.lit("too_short"))
        .when(short("content_en") & short("content_sw"), F.lit("content too short"))
    )


def autofill(items: DataFrame) -> DataFrame:
    """Complete items: a family's image where there is none, the English text for a missing translation, sections under
    canonical titles; marks what needs review and why. Without any text the translation is empty, not null."""
    family = F.when(F.contains("id", F.lit("-")), F.split_part(F.col("id"), F.lit("-"), F.lit(1))).otherwise(F.lit("misc"))
    images = F.create_map(*[F.lit(x) for kv in FALLBACK_IMAGES.items() for x in kv])
    no_image = _missing("image")
    untranslated = T.blank_to_null("content_sw").isNull() & T.blank_to_null("content_en").isNotNull()
    filled = items.withColumn("_no_image", no_image).withColumn("_untranslated", untranslated)
    filled = filled.withColumn("image", F.when(F.col("_no_image"), F.coalesce(F.element_at(images, family), F.lit(FALLBACK_IMAGES["principle"]))).otherwise(F.col("image")))
    filled = filled.withColumn("image_credit", F.when(F.col("_no_image"), F.lit("Fallback image"))).withColumn("content_sw", F.when(F.col("_untranslated"), F.col("content_en")).otherwise(F.col("content_sw")))
    for c in ("content_en", "content_sw"):
        filled = filled.withColumn(c, F.when(T.blank_to_null(c).isNotNull(), rebuild_sections(T.strip(c))).otherwise(F.lit("") if c == "content_sw" else F.col(c)))
    short = F.length(F.coalesce(T.blank_to_null("content_sw"), T.blank_to_null("content_en"), F.lit(""))) < 140
    missing = F.array_compact(F.array(F.when(F.col("_untranslated"), F.lit("translation")), F.when(short, F.lit("too_short"))))
    return filled.withColumn("missing_fields", missing).withColumn("needs_review", F.size("missing_fields") > 0).drop("_no_image", "_untranslated")


def index_consistency(index: DataFrame, expected: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(check, value) rows: vectors, distinct ids, repeated ids, dimensions, and expected ids that the index lacks."""
    sums = index.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct(key).alias("ids"), F.countDistinct(F.size(vector)).alias("dimensions"))
    again = index.groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated ids"))
    lacking = expected.select(key).distinct().join(index.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing expected ids"))
    rows = [d.select(F.lit(c).alias("check"), F.col(c).cast("long").alias("value")) for d, cs in ((sums, ("vectors", "ids", "dimensions")), (again, ("repeated ids",)), (lacking, ("missing expected ids",))) for c in cs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def best_images(candidates: DataFrame, least_width: int = 600) -> DataFrame:
    """The widest image of each item that is wide enough; licensed ones first at equal width, then by url."""
    w = Window.partitionBy("item_id").orderBy(F.desc("width"), (F.coalesce(F.col("license"), F.lit("")) == "").cast("int"), "url")
    return candidates.filter(F.col("width") >= least_width).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolve_images(items: DataFrame, manual: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, image, outcome): an item's own image, else the manual map's, else the best candidate, else its family's fallback."""
    best = best_images(candidates).select(F.col("item_id").alias("id"), F.col("url").alias("_best"))
    rows = items.select("id", "image").join(manual.select("id", F.col("image").alias("_manual")), "id", "left").join(best, "id", "left")
    images = F.create_map(*[F.lit(x) for kv in FALLBACK_IMAGES.items() for x in kv])
    fallback = F.element_at(images, F.split_part(F.col("id"), F.lit("-"), F.lit(1)))
    own, hand = F.nullif(F.col("image"), F.lit("")), F.nullif(F.col("_manual"), F.lit(""))
    outcome = F.when(own.isNotNull(), F.lit("existing")).when(hand.isNotNull(), F.lit("manual")).when(F.col("_best").isNotNull(), F.lit("found")).when(fallback.isNotNull(), F.lit("fallback")).otherwise(F.lit("missing"))
    return rows.select("id", F.coalesce(own, hand, "_best", fallback).alias("image"), outcome.alias("outcome"))


def rewrite_paths(items: DataFrame, images: DataFrame) -> DataFrame:
    """Replace an image whose file stem is in the table (stem, new_path)."""
    stem = F.regexp_extract("image", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = items.select("id", "image", stem.alias("stem")).join(images, "stem", "left")
    return rows.select("id", F.coalesce("new_path", "image").alias("image"))


def image_query(title: Column | str, hint: Column, tags: Column) -> Column:
    """Search text for an image: the title, a hint, and the first two tags of at most 20 characters."""
    return F.concat_ws(" ", title, hint, F.array_join(F.slice(F.filter(tags, lambda x: F.length(x) <= 20), 1, 2), " "))
