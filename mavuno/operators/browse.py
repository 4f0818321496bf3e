"""Browsing lists, picks and quizzes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import cut, numbered
from .structure import GROUPS, infer_group


def family(id: Column | str = "id") -> Column:
    return F.split_part(F.col(id) if isinstance(id, str) else id, F.lit("-"), F.lit(1))


def family_lists(items: DataFrame) -> DataFrame:
    """(family, n, place, id, title): each family's items in title order, as rows rather than one list."""
    return numbered(items.select(family().alias("family"), "id", "title"), ["family"], ["title", "id"], "place", "n")


def az_groups(items: DataFrame) -> DataFrame:
    """(letter, place, id, title): by the title's upper first letter, `#` for what is no letter A to Z; titles sorted regardless
    of case, null ones last."""
    first = F.substring(T.trim_blanks("title"), 1, 1)
    letter = F.when(first.rlike("[A-Za-zıſ]"), F.upper(first)).otherwise(F.lit("#"))  # tested before it is raised, as ß becomes SS
    low = F.lower(F.translate("title", "İΣ", "iσ"))  # letter by letter, as lower() makes two of the one and looks at what follows the other
    rows = items.select(letter.alias("letter"), "id", "title", F.col("title").isNull().alias("_none"), low.alias("_low"))
    return numbered(rows, ["letter"], ["_none", "_low", "id"]).drop("_none", "_low")


def group_buckets(items: DataFrame) -> DataFrame:
    """(grp, n, first_title) of diseases by inferred group; groups without items are kept with n = 0."""
    names = items.sparkSession.createDataFrame([(g,) for g in dict.fromkeys([*[k for k, _ in GROUPS], "general"])], "grp string")
    found = items.filter(F.col("id").startswith("disease-")).groupBy(infer_group("id", "title").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))
    return names.join(found, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first_title")


def pick_of_day(items: DataFrame, day: Column, shifts: dict[str, int] | None = None) -> DataFrame:
    """(family, id, title): the item at place day mod n of each family, in order of id; principles are shifted by 17 days."""
    shifts = {"principle": 17} if shifts is None else shifts
    rows = items.select(family().alias("family"), "id", "title")
    shift = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shifts.items() for x in kv]), F.col("family")), F.lit(0))
    rows = numbered(rows, ["family"], ["id"], "_place", "_n").withColumn("_at", F.col("_place") - 1)
    return rows.filter(F.col("_at") == F.pmod(F.unix_date(day) + shift, F.col("_n"))).select("family", "id", "title")


def quiz(items: DataFrame, seed: int = 0, choices: int = 4, pool: int = 16) -> DataFrame:
    """(id, place, choice, correct): each item with choices - 1 others, shuffled by a seeded hash. Families of fewer items than
    choices give none. Others come from the `pool` items that follow in a seeded order of the family, never from all pairs."""
    rows = items.select(family().alias("family"), "id").withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "id")))
    rows = cut(numbered(rows, ["family"], ["_h", "id"], "_place", "_n").withColumn("_at", F.col("_place") - 1).filter(F.col("_n") >= choices))
    ask = rows.withColumn("_step", F.explode(F.sequence(F.lit(1), F.least(F.col("_n") - 1, F.lit(pool)).cast("int"))))
    ask = ask.select("family", "id", F.pmod(F.col("_at") + F.col("_step"), F.col("_n")).alias("_other"))
    others = ask.join(rows.select("family", F.col("_at").alias("_other"), F.col("id").alias("choice")), ["family", "_other"])
    drawn = others.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.md5(F.concat_ws(":", F.lit(seed + 1), "id", "choice")), "choice"))).filter(F.col("_r") < choices)
    both = drawn.select("id", "choice", F.lit(False).alias("correct")).unionByName(rows.select("id", F.col("id").alias("choice"), F.lit(True).alias("correct")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.md5(F.concat_ws(":", F.lit(seed + 2), "id", "choice")), "choice")))
