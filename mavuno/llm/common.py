"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where spark.checkpoint.dir is unset, a temporary one on a single machine only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there, so that a lost executor costs no recomputation.

    A table has its true size, while a checkpoint keeps the estimate of the plan behind it, which squares with each join of
    an iteration.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts takes of a Python worker's memory; the same bound for every operator."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


MOST_BROADCAST = 50_000  # rows of a few numbers


def joined(rows: DataFrame, facts: DataFrame, on: list[str], count: str, how: str = "inner", spread: Column | None = None, keep: bool = True) -> DataFrame:
    """rows with the facts of their key, whatever share of the rows a key holds.

    `facts` has one row for each key, and in `count` how many rows that key has. They are counted, and cut
    with `keep`; up to MOST_BROADCAST of them are broadcast. Beyond, keys with more than 1 / (8 p) of all rows, p the number of shuffle
    partitions, are broadcast: there are at most 8 p of them. Rows of such a key are spread by `spread` in the shuffle
    join that serves the others. Null keys match nothing.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = cut(facts) if keep else facts
    n, total = facts.agg(F.count(F.lit(1)), F.sum(count)).first()
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(facts), on, how)
    least = max(256, total // (8 * parts))
    told = [c for c in facts.columns if c not in on]
    hot = facts.filter(F.col(count) > least).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in told])
    cold = facts.filter(F.col(count) <= least).withColumn("_salt", F.lit(0))
    salt = F.when(F.col(f"_hot_{count}").isNull(), 0).otherwise(1 + F.pmod(F.spark_partition_id() if spread is None else F.xxhash64(spread), F.lit(1024)))
    out = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt.cast("int")).join(cold, [*on, "_salt"], "left")
    out = out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in told])
    return out.filter(F.col(count).isNotNull()) if how == "inner" else out


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that no model may learn from; a null id counts as the empty string."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(4)) == 2


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


@dataclass(frozen=True)
class Ranges:
    """Ascending ids in contiguous ranges of about equal row counts. Range j > 0 starts with cuts[j - 1], an id that occurs."""

    cuts: list[int]
    first: int | None
    rows: int

    def number(self, key: Column) -> Column:
        """The range of an id, by binary search among the cuts; null for a null id."""
        if not self.cuts:
            return F.when(key.isNotNull(), F.lit(0))
        cuts = F.array(*[F.lit(c).cast("long") for c in self.cuts])

        def halve(acc: Column, _: Column) -> Column:
            middle = F.shiftright(acc["lo"] + acc["hi"], 1)
            below = F.get(cuts, middle) <= acc["key"]
            open_ = acc["lo"] < acc["hi"]
            return F.struct(
                F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"),
                acc["key"].alias("key"),
            )

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(self.cuts)).alias("hi"), key.cast("long").alias("key"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(len(self.cuts).bit_length())), start, halve)["lo"]
        return F.when(key.isNotNull(), found)


def ranges(df: DataFrame, key: str, rows_each: int = 4096, most: int = 65_536) -> Ranges:
    """Cut points for `key` from one aggregate over that column alone.

    There are several ranges for each shuffle partition, as they are dealt by hash and few would lie unevenly. Their number
    grows with the table up to `most`, so that many numbers come to the driver at any size; beyond about 270 million
    rows the ranges grow instead, and a task sorts them with spilling.
    """
    n = df.agg(F.count(key)).first()[0]
    least = 6 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = min(most, max(least, n // rows_each))
    row = df.agg(
        F.min(key).alias("first"),
        F.percentile_approx(key, [j / count for j in range(1, count)], 20 * count).alias("cuts"),
    ).first()
    cuts = sorted({int(c) for c in row["cuts"] or [] if c > row["first"]})
    return Ranges(cuts, row["first"], n)
