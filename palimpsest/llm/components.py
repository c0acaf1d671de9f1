"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, undirected). Returns node, component: the smallest node reachable; nodes without edges are
    not in it. Every step is one write to the shared folder, so a lost executor costs one step at most. Hubs are
    reduced by partial aggregation, and the joins below have one row per node on one side, so skew can be split."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        e = both.join(least.hint("merge"), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        stars = e.join(least.hint("merge"), "u")
        e = stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = saved(e, "stars")
        # Done once no centre of a star belongs to another one and each node has one centre.
        again = e.join(e.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").select("u").unionByName(e.groupBy("u").count().where("count > 1").select("u"))
        if again.isEmpty():
            leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
