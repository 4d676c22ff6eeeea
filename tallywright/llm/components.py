"""Distributed union-find: connected components of an edge table by alternating large-star and small-star steps.

Only minima by node are taken, so a node of any degree is pre-aggregated before the shuffle and its edges can be split over
tasks. Every round is cut off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b: long); root is the smallest node of its component. Self-loops are ignored."""
    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = e.agg(mark).first()[0]
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = e.agg(mark).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
