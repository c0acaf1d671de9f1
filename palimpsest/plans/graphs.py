"""Queries: graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.plans import bridge


def _cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.category_cycle_edges(spark, sf_dir).select(F.col("parent").alias("src"), F.col("child").alias("dst"))


def _small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("src"))
    return n.select("src", F.explode(F.array((F.col("src") * 3 + 1) % 25, (F.col("src") + 1) % 25)).alias("dst")).distinct()


def _small_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 11 = 0").select(F.col("n_nationkey").cast("long").alias("page_id"))


def category_cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_members(_cycle_edges(spark, sf_dir))


def category_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cycles(_cycle_edges(spark, sf_dir))
    return found.select("start", F.col("length").cast("long").alias("length"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("nodes")).orderBy("length", "start")


def furthest_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    redirects = bridge.pages(spark, sf_dir).where("is_redirect").select("page_id")
    return graph.furthest(0, bridge.page_links(spark, sf_dir).select("src", "dst"), redirects)


def furthest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    redirects = bridge.pages(spark, sf_dir).where("is_redirect").select("page_id")
    found = graph.paths_to(0, bridge.page_links(spark, sf_dir).select("src", "dst"), redirects)
    return found.select("node", "dist", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


def longest_paths_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.longest_shortest_paths(_small_edges(spark, sf_dir), _small_redirects(spark, sf_dir)).select("src", "dst", "dist")


QUERIES = {
    "category_cycle_members": category_cycle_members,
    "category_cycles": category_cycles,
    "furthest_from": furthest_from,
    "furthest_paths": furthest_paths,
    "longest_paths_small": longest_paths_small,
}
ORACLE_SQL = {
    "category_cycle_members": f"WITH RECURSIVE {bridge.ctes('cycleedge')}, reach(a, b) AS (SELECT parent, child FROM cycleedge UNION SELECT a, child FROM reach JOIN cycleedge ON b = parent) SELECT a AS node FROM reach WHERE a = b",
    "furthest_from": f"WITH RECURSIVE {bridge.ctes('page', 'pagelink')}, cost AS (SELECT src, dst, CASE WHEN is_redirect THEN 0 ELSE 1 END AS c FROM pagelink JOIN page ON page_id = src), walk(node, dist) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT src, dist + c FROM walk JOIN cost ON dst = node WHERE dist < 40), best AS (SELECT node, min(dist) AS dist FROM walk GROUP BY node) SELECT node, dist FROM best WHERE dist = (SELECT max(dist) FROM best)",
    "longest_paths_small": "WITH RECURSIVE edge AS (SELECT DISTINCT src, dst, CASE WHEN src % 11 = 0 THEN 0 ELSE 1 END AS c FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation) e), walk(src, dst, dist) AS (SELECT src, dst, CAST(c AS BIGINT) FROM edge UNION SELECT w.src, e.dst, w.dist + e.c FROM walk w JOIN edge e ON w.dst = e.src WHERE w.dist < 26), best AS (SELECT src, dst, min(dist) AS dist FROM walk WHERE src <> dst GROUP BY src, dst) SELECT src, dst, dist FROM best WHERE dist = (SELECT max(dist) FROM best)",
}
