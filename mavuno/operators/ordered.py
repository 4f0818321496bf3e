"""Places in a global or per-key order without putting a key's rows into one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where spark.checkpoint.dir is unset, a temporary one on a single machine only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, by: list[str], order: list[str], into: str = "place", count: str | None = None) -> DataFrame:
    """Number the rows of each key from 1 in ascending order; with `count` also add the key's number of rows.

    Rows are dealt by ranges of (key, order), so a key of any size is spread over many tasks; each range numbers its own
    rows, and the sizes of the ranges before it, a few numbers for each range, are added. The dealt table is cut, as
    both passes must see the same ranges. `order` must tell rows apart, or equal rows may swap places.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    offsets = sizes.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(*by)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(offsets, _same(by)).withColumn(into, F.col("_before") + F.col("_inside"))
    kept = [*df.columns, into]
    if count:
        out, kept = out.withColumn(count, F.col("_all")), [*kept, count]
    return out.select(*kept)


def _ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df dealt by ranges of (key, order) and cut, with the number of each row's range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))


def _same(by: list[str]) -> Column:
    """The same range, as `_r`, and the same key, as `_k0` and so on; null keys are a key like others."""
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return same


def running(df: DataFrame, by: list[str], order: list[str], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, own: bool = True) -> DataFrame:
    """Add the last value that is not null, and the sum, up to each row of its key, for each named column; with `own` False
    without the row itself. Null keys count as a key.

    A key of any size is spread over many ranges; each range fills its own rows, and its first ones from the ends of the ranges before it.
    """
    last, total = last or {}, total or {}
    dealt = _ranged(df.withColumns({f"_own_{n}": c for n, c in {**last, **total}.items()}), by, order)
    ends = dealt.groupBy("_range", *by).agg(
        *[F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), F.struct(*order))).alias(f"_end_{n}") for n in last],
        *[F.sum(f"_own_{n}").alias(f"_end_{n}") for n in total],
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    ends = ends.select(
        F.col("_range").alias("_r"),
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)],
        *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_end_{n}") for n in last],
        *[F.coalesce(F.sum(f"_end_{n}").over(earlier), F.lit(0)).alias(f"_end_{n}") for n in total],
    )
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    new = {n: F.coalesce(F.last(f"_own_{n}", ignorenulls=True).over(inside), F.col(f"_end_{n}")) for n in last}
    new |= {n: F.col(f"_end_{n}") + F.coalesce(F.sum(f"_own_{n}").over(inside), F.lit(0)) for n in total}
    return dealt.join(ends, _same(by), "left").select(*[c for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """Add the last value that is not null up to each row of its key."""
    return running(df, by, order, last={into: value})


def counted(df: DataFrame, by: list[str], order: list[str], mark: Column, into: str) -> DataFrame:
    """Add the number of marked rows up to each row of its key."""
    return running(df, by, order, total={into: F.when(mark, 1).otherwise(0)})
