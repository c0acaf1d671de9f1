"""Queries: titles, diffs, blame, page views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as t
from palimpsest.functions import titles
from palimpsest.operators import blame, diff, trending
from palimpsest.plans import bridge

TODAY = dt.date(2024, 2, 14)
_FULL = "CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN ':Category:' || p_name WHEN 2 THEN 'talk:' || p_name WHEN 3 THEN '2001:' || p_name WHEN 4 THEN 'User_Talk:' || p_name WHEN 5 THEN '::' || p_name WHEN 6 THEN 'No such:' || p_name WHEN 7 THEN '14:' || p_name ELSE 'Hjelp:' || p_name END"
_SITE = {0: "", 1: "Talk", 2: "User", 3: "User talk", 12: "Hjelp", 14: "Category"}


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_FULL).alias("full"))


def title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _full(spark, sf_dir).withColumns({"a": titles.parse_title(F.col("full")), "b": titles.parse_title(F.col("full"), _SITE)})
    return p.select("p_partkey", F.col("a.ns").alias("ns"), F.col("a.title").alias("title"), F.col("b.ns").alias("site_ns"), F.col("b.title").alias("site_title"))


def title_parse_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).withColumn("a", titles.parse_engine_title(F.col("full"))).select("p_partkey", F.col("a.ns").alias("ns"), F.col("a.title").alias("title"))


def title_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", titles.display_title((F.col("p_size") % 20).cast("int"), F.col("p_name")).alias("display"))


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", titles.normalise_name(F.col("p_name")).alias("name"))


def datetime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("d"))
    e = e.withColumn("d", F.when(F.col("event_id") % 2 == 0, F.substring("d", 1, 8)).otherwise(F.col("d")))
    return e.select("event_id", F.date_format(t.parse_date_time(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def url_decode_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+%2F")).alias("u"))
    return d.select("p_partkey", titles.url_title(F.col("u")).alias("title"))


def utf16_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.utf16_length(F.coalesce("text", F.lit(""))).alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bridge.history(spark, sf_dir)
    before = F.lag("text").over(Window.partitionBy("page_id").orderBy("rev_seq"))
    return h.select("page_id", "rev_seq", before.alias("a"), F.col("text").alias("b")).where("a is not null")


def diff_text_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.diff_pairs(_pairs(spark, sf_dir))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["inserted_b"] - i["deleted_a"])
    return found.select("page_id", "rev_seq", total.alias("delta"))


def diff_text_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.diff_pairs(_pairs(spark, sf_dir), trim=True, blanks=True, case=True)
    script = F.array_join(F.transform("items", lambda i: F.concat_ws(".", i["deleted_a"], i["inserted_b"], i["start_a"], i["start_b"])), "*")
    return found.select("page_id", "rev_seq", script.alias("script"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = t.split_lines(F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "|")).alias("digest"))


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame.blame(bridge.history(spark, sf_dir))


def blame_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame_lines(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n_lines"))


def blame_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame.contributors(blame_lines(spark, sf_dir))


def blame_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the pages of documents of a source: a text that comes again is a revert."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return blame.reverts(d.select(F.col("source").alias("page_id"), F.col("doc_id").alias("rev_seq"), F.coalesce("text", F.lit("")).alias("text")))


def daily_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending.daily_views(bridge.page_views(spark, sf_dir)).select("title", F.col("day").cast("string").alias("day"), "views")


def trending_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trending.scores(trending.daily_views(bridge.page_views(spark, sf_dir)), TODAY)
    return found.select("title", "earlier", "later", F.round("score", 6).alias("score"))


QUERIES = {
    "title_parse": title_parse,
    "title_parse_engine": title_parse_engine,
    "title_display": title_display,
    "name_normalise": name_normalise,
    "datetime_parse": datetime_parse,
    "url_decode_title": url_decode_title,
    "utf16_length": utf16_length,
    "diff_text_delta": diff_text_delta,
    "diff_text_scripts": diff_text_scripts,
    "split_lines": split_lines,
    "blame_lines": blame_lines,
    "blame_line_counts": blame_line_counts,
    "blame_contributors": blame_contributors,
    "blame_reverts": blame_reverts,
    "daily_views": daily_views,
    "trending_score": trending_score,
}
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in titles.NAMESPACES.items())
_LINES = "len(string_split(text, chr(10)))"
ORACLE_SQL = {
    "title_parse": "SELECT p_partkey, CAST(CASE p_partkey % 9 WHEN 1 THEN 14 WHEN 2 THEN 1 WHEN 3 THEN 2001 WHEN 4 THEN 3 WHEN 7 THEN 14 ELSE 0 END AS INT) AS ns, CASE p_partkey % 9 WHEN 6 THEN 'No such:' || p_name WHEN 8 THEN 'Hjelp:' || p_name ELSE p_name END AS title, CAST(CASE p_partkey % 9 WHEN 1 THEN 14 WHEN 2 THEN 1 WHEN 4 THEN 3 WHEN 7 THEN 14 WHEN 8 THEN 12 ELSE 0 END AS INT) AS site_ns, CASE p_partkey % 9 WHEN 6 THEN 'No such:' || p_name ELSE p_name END AS site_title FROM part",
    "title_parse_engine": "SELECT p_partkey, CAST(CASE p_partkey % 9 WHEN 2 THEN 1 WHEN 3 THEN 2001 WHEN 4 THEN 3 WHEN 7 THEN 14 ELSE 0 END AS INT) AS ns, CASE p_partkey % 9 WHEN 1 THEN 'Category:' || p_name WHEN 5 THEN ':' || p_name WHEN 6 THEN 'No such:' || p_name WHEN 8 THEN 'Hjelp:' || p_name ELSE p_name END AS title FROM part",
    "title_display": f"SELECT p_partkey, CASE WHEN p_size % 20 = 0 THEN p_name ELSE coalesce(n.name, CAST(p_size % 20 AS VARCHAR)) || ':' || p_name END AS display FROM part LEFT JOIN (VALUES {_NAMES}) AS n(id, name) ON n.id = p_size % 20",
    "name_normalise": "SELECT p_partkey, upper(substr(replace(p_name, ' ', '_'), 1, 1)) || substr(replace(p_name, ' ', '_'), 2) AS name FROM part",
    "datetime_parse": "SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events",
    "url_decode_title": "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '+/' AS title FROM part",
    "utf16_length": "SELECT doc_id, CAST(length(coalesce(text, '')) + len(regexp_extract_all(coalesce(text, ''), '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS n FROM documents",
    "diff_text_delta": f"WITH {bridge.ctes('history')}, n AS (SELECT page_id, rev_seq, {_LINES.replace('text', 'text')} AS k FROM history), d AS (SELECT page_id, rev_seq, k - lag(k) OVER (PARTITION BY page_id ORDER BY rev_seq) AS delta FROM n) SELECT page_id, rev_seq, CAST(delta AS BIGINT) AS delta FROM d WHERE delta IS NOT NULL",
    "split_lines": f"SELECT doc_id, CAST({_LINES} - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines, md5(CASE WHEN suffix(text, chr(10)) THEN replace(text[:-2], chr(10), chr(10) || '|') || chr(10) ELSE replace(text, chr(10), chr(10) || '|') END) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d",
    "blame_line_counts": f"WITH {bridge.ctes('history')}, last AS (SELECT page_id, arg_max(text, rev_seq) AS text FROM history GROUP BY page_id) SELECT page_id, CAST({_LINES} - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM last WHERE text <> ''",
    "blame_reverts": "SELECT page_id, rev_seq, to_rev FROM (SELECT source AS page_id, doc_id AS rev_seq, min(doc_id) OVER (PARTITION BY source, coalesce(text, '')) AS to_rev FROM documents) r WHERE rev_seq > to_rev",
    "daily_views": f"WITH {bridge.ctes('pageview')} SELECT title, CAST(day AS VARCHAR) AS day, CAST(sum(views) AS BIGINT) AS views FROM pageview GROUP BY title, day",
    "trending_score": f"WITH {bridge.ctes('pageview')}, s AS (SELECT title, CAST(coalesce(sum(views) FILTER (WHERE DATE '{TODAY}' - day BETWEEN 7 AND 20), 0) AS BIGINT) / 2.0 AS earlier, CAST(coalesce(sum(views) FILTER (WHERE DATE '{TODAY}' - day BETWEEN 0 AND 6), 0) AS BIGINT) AS later FROM pageview GROUP BY title) SELECT title, CAST(earlier AS DOUBLE) AS earlier, later, round(abs(later - CAST(earlier AS DOUBLE)) * ln((later + 1) / (CAST(earlier AS DOUBLE) + 1)), 6) AS score FROM s",
}
