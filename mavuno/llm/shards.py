"""Contiguous shards of near-equal bytes, cut by global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges

NULL_RANGES = 256  # over which rows without a key are dealt by a hash


def byte_shards(df: DataFrame, n_shards: int, size: Column, key: str = "doc_id", payload: tuple[str, ...] = ()) -> DataFrame:
    """Deal rows, in ascending `key`, into `n_shards` contiguous shards of near-equal total `size`.

    Rows are dealt into key ranges; the totals of the ranges (one row each) are summed up in order and give each
    range its offset, and a running sum inside the range gives each row its global byte position. A row belongs to
    the shard that holds the middle of its bytes, so a shard differs from total / n_shards by one row at most.

    Returns key, payload, size, shard and slot (the row's place in its shard, from 0 without gaps).
    Repeated keys are ordered by size and payload; rows without a key come first, in an order that their size and payload
    give, dealt over NULL_RANGES ranges. An empty table gives no rows. Only key, size and payload are shuffled,
    never the text they come from.
    """
    cuts = ranges(df, key)
    lean = df.select(F.col(key), *payload, size.cast("long").alias("size"))
    unkeyed = (-1 - F.pmod(F.xxhash64("size", *payload), F.lit(NULL_RANGES))).cast("int")
    lean = lean.withColumn("_range", F.when(F.col(key).isNull(), unkeyed).otherwise(cuts.number(F.col(key))))
    order = [F.col(key).asc_nulls_first(), F.col("size"), *[F.col(c) for c in payload]]
    totals = lean.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range, at most 65,536 and NULL_RANGES
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_offset"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = (
        lean.withColumn("_place", F.row_number().over(inside) - 1)
        .withColumn("_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(offsets), "_range")
        .withColumn("_middle", 2 * (F.col("_byte_offset") + F.col("_before")) + F.col("size"))
        .withColumn("_share", F.expr(f"(_middle * {n_shards}) div (2 * greatest(_total, 1))"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.col("_share")).cast("int"))
        .withColumn("_row", F.col("_row_offset") + F.col("_place"))
    )
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_start"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select(key, *payload, "size", "shard", (F.col("_row") - F.col("_start")).alias("slot"))
