"""Connected components of an edge table (distributed union-find by alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, release


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node``, ``root`` (the smallest node that is reachable) of every node that has an edge to another.

    Large and small star steps alternate until nothing changes. Each is an
    aggregation with map-side combining and a join that AQE can split where
    one node has very many edges; every round is written,
    and the one before it deleted.
    """
    now = checkpoint(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        before, now = now, checkpoint(small)
        release(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = new
