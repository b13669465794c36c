"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest known neighbour (or itself) to its larger neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller neighbours and itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any two comparable columns -> (node, root): the smallest node that each node reaches.

    Only nodes with an edge to another node come back; nulls and self-loops are ignored. A round costs a
    pre-aggregated minimum and a join, both splittable when a hub holds many edges. The loop ends when a whole
    round changes nothing, told by a count and an order-free digest of the edges.
    """
    edges = edges.toDF("u", "v").where("u <> v").distinct()
    seen = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
