"""Connected components of an edge table that stays on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component; roots themselves included.

    Alternating star contraction: every node hangs its larger neighbours on the least of its neighbours, then its
    smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest chain. Each
    round is cut by a checkpoint and sends a row per edge; least neighbours are pre-aggregated before the shuffle, no
    neighbour list is ever gathered, and the least neighbours of hubs are broadcast (`joined`), so a hub may touch any
    share of the edges. Edges from a node to itself are left out; an empty table gives none.
    """
    edges = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = None
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = joined(both.filter(F.col("y") > F.col("x")), least, ["x"], "_n", spread=F.col("y"), keep=False).select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = joined(large, down, ["v"], "_n", spread=F.col("u"), keep=False).select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        edges = cut(small.filter(F.col("u") != F.col("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
