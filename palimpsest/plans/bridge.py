"""The driver's tables seen as wiki tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("page_id"),
        (F.col("user_id") % 16).cast("int").alias("ns"),
        F.col("event_id").alias("rev_seq"),
        "ts",
        F.col("event_type").alias("contributor"),
        (F.col("value") > 50).alias("minor"),
        F.col("event_type").alias("comment"),
        F.col("props").alias("text"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("page_id"),
        (F.col("p_size") % 4).cast("int").alias("ns"),
        F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("title"),
        (F.col("p_partkey") % 11 == 0).alias("is_redirect"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, dst_exists: each page links to its half and to one other, now and then to a missing one."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    n = p.agg(F.count("*").alias("n"))
    two = p.crossJoin(F.broadcast(n)).select("src", "n", F.explode(F.array(F.when(F.col("src") > 0, F.expr("src div 2")), F.expr("(src * 7 + 3) % (n + n div 10)"))).alias("dst"))
    return two.where("dst is not null").select("src", "dst", (F.col("dst") < F.col("n")).alias("dst_exists")).distinct()


def deep_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: a binary tree over parts."""
    return _read(spark, sf_dir, "part").where("p_partkey > 0").select(F.expr("p_partkey div 2").alias("parent"), F.col("p_partkey").alias("child"))


def deep_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, page: orders in the categories of their parts."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("category"), F.col("l_orderkey").alias("page")).distinct()


def named_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cat_id, title"""
    r, n = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    return r.select(F.concat(F.lit("R"), "r_regionkey").alias("cat_id"), F.col("r_name").alias("title")).unionByName(n.select(F.concat(F.lit("N"), "n_nationkey").alias("cat_id"), F.col("n_name").alias("title")))


def named_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))


def named_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, page (a display name)"""
    c, s = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    return c.select(F.concat(F.lit("N"), "c_nationkey").alias("category"), F.col("c_name").alias("page")).unionByName(s.select(F.concat(F.lit("N"), "s_nationkey").alias("category"), F.col("s_name").alias("page")))


def category_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("parent"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("child"))


def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("url")).distinct()


def template_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, template: a part uses its type and its brand."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.explode(F.array("p_type", "p_brand")).alias("template")).distinct()


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, title, day, views"""
    e = _read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("project"), F.col("user_id").cast("string").alias("title"), F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, rev_seq, contributor, text"""
    c = _read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("rev_seq"), F.col("role").alias("contributor"), "text")


SQL = {
    "revision": "SELECT user_id AS page_id, CAST(user_id % 16 AS INT) AS ns, event_id AS rev_seq, ts, event_type AS contributor, value > 50 AS minor, event_type AS comment, props AS text FROM events",
    "page": "SELECT p_partkey AS page_id, CAST(p_size % 4 AS INT) AS ns, p_name || '_' || CAST(p_partkey AS VARCHAR) AS title, p_partkey % 11 = 0 AS is_redirect FROM part",
    "pagelink": "SELECT DISTINCT src, dst, dst < n AS dst_exists FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, (p_partkey * 7 + 3) % (n + n // 10) FROM part, (SELECT count(*) AS n FROM part) k) e, (SELECT count(*) AS n FROM part) c",
    "deepsub": "SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0",
    "deeparticle": "SELECT DISTINCT l_partkey AS category, l_orderkey AS page FROM lineitem",
    "namedcat": "SELECT 'R' || r_regionkey AS cat_id, r_name AS title FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation",
    "namedsub": "SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation",
    "namedarticle": "SELECT 'N' || c_nationkey AS category, c_name AS page FROM customer UNION ALL SELECT 'N' || s_nationkey, s_name FROM supplier",
    "cycleedge": "SELECT CAST(n_nationkey AS BIGINT) AS parent, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS child FROM nation",
    "extlink": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS url FROM pages",
    "templatelink": "SELECT DISTINCT p_partkey AS page_id, unnest([p_type, p_brand]) AS template FROM part",
    "pageview": "SELECT event_type AS project, CAST(user_id AS VARCHAR) AS title, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY ALL",
    "history": "SELECT conv_id AS page_id, turn AS rev_seq, role AS contributor, text FROM conversations",
}


def ctes(*names: str) -> str:
    """The named views as the members of a WITH clause."""
    return ", ".join(f"{n} AS ({SQL[n]})" for n in names)
