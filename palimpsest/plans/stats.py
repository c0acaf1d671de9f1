"""Queries: edit statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import userstats
from palimpsest.plans import bridge

DATE0, LIMIT = dt.datetime(2024, 2, 14), 1440


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_edit", "last_edit")})


def user_edit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(userstats.user_edit_stats(bridge.revisions(spark, sf_dir), DATE0, repeat_limit=LIMIT))


def user_edit_stats_per_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(userstats.user_edit_stats(bridge.revisions(spark, sf_dir), DATE0, namespaces=list(range(16)), repeat_limit=LIMIT, per_namespace=True))


def user_edit_stats_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bots: the two first names; namespaces 8 and above are unknown to the site."""
    rows = bridge.revisions(spark, sf_dir)
    bots = rows.select(F.col("contributor").alias("name")).distinct().orderBy("name").limit(2)
    return _stamped(userstats.user_edit_stats(rows, DATE0, bots=bots, namespaces=list(range(8)), repeat_limit=LIMIT))


def dump_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return userstats.totals(bridge.revisions(spark, sf_dir))


def _sql(namespaces: int = 16, per_namespace: bool = False, bots: str = "SELECT '' AS name WHERE FALSE") -> str:
    recent = "ts >= TIMESTAMP '2024-01-15 00:00:00'"
    every = ", ".join(f"('{n}')" for n in ["main", "others", "talk", "total"] + [f"ns{k}" for k in range(namespaces) if per_namespace])
    sums = ("revisions", "minors", "dsize", "new_pages", "recent_revisions", "recent_minors", "recent_dsize", "recent_new_pages", "edits", "recent_edits")
    sets = "(contributor), (contributor, class)" + ", (contributor, ns)" * per_namespace
    ns = "WHEN grouping(ns) = 0 THEN 'ns' || ns" if per_namespace else ""
    return f"""
WITH {bridge.ctes("revision")},
bot AS ({bots}),
before AS (
  SELECT *, lag(contributor) OVER w AS pu, lag(text) OVER w AS pt, lag(ts) OVER w AS pts, coalesce(length(lag(text) OVER w), 0) AS pl, row_number() OVER w = 1 AS is_new
  FROM revision WHERE ns < {namespaces} WINDOW w AS (PARTITION BY page_id ORDER BY rev_seq)),
marked AS (SELECT *, coalesce(pu = contributor AND pt = text, FALSE) AS skip, coalesce(length(text), 0) - pl AS diff FROM before),
broken AS (
  SELECT *, sum(CASE WHEN NOT skip AND (is_new OR pu <> contributor OR pts + INTERVAL {LIMIT} MINUTE < ts) THEN 1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY rev_seq ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (
  SELECT page_id, span, contributor, ns, CASE WHEN ns % 2 <> 0 THEN 'talk' WHEN ns = 0 THEN 'main' ELSE 'others' END AS class,
    count(*) AS revisions, count(*) FILTER (WHERE minor) AS minors, sum(diff) AS dsize, count(*) FILTER (WHERE is_new) AS new_pages,
    count(*) FILTER (WHERE {recent}) AS recent_revisions, count(*) FILTER (WHERE {recent} AND minor) AS recent_minors,
    coalesce(sum(diff) FILTER (WHERE {recent}), 0) AS recent_dsize, count(*) FILTER (WHERE {recent} AND is_new) AS recent_new_pages,
    sum(length(comment)) AS comment_len, 1 AS edits, max(CASE WHEN {recent} THEN 1 ELSE 0 END) AS recent_edits, min(ts) AS first_edit, max(ts) AS last_edit
  FROM broken WHERE NOT skip GROUP BY 1, 2, 3, 4, 5),
found AS (
  SELECT contributor, CASE WHEN grouping(class) = 0 THEN class {ns} ELSE 'total' END AS group_name,
    {", ".join(f"sum({c}) AS {c}" for c in (*sums, "comment_len"))}, min(first_edit) AS first_edit, max(last_edit) AS last_edit
  FROM spans GROUP BY GROUPING SETS ({sets})),
users AS (SELECT contributor, group_name FROM (SELECT DISTINCT contributor FROM revision) u, (VALUES {every}) AS g(group_name))
SELECT u.contributor, u.group_name, u.contributor IN (SELECT name FROM bot) AS is_bot, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in sums)},
  strftime(first_edit, '%Y-%m-%d %H:%M:%S') AS first_edit, strftime(last_edit, '%Y-%m-%d %H:%M:%S') AS last_edit,
  round(coalesce(CAST(revisions AS DOUBLE) / nullif(edits, 0), 0), 5) AS average_span, round(coalesce(CAST(comment_len AS DOUBLE) / nullif(revisions, 0), 0), 5) AS average_comment
FROM users u LEFT JOIN found f ON u.contributor = f.contributor AND u.group_name = f.group_name"""


QUERIES = {"user_edit_stats": user_edit_stats, "user_edit_stats_per_ns": user_edit_stats_per_ns, "user_edit_stats_bots": user_edit_stats_bots, "dump_totals": dump_totals}
ORACLE_SQL = {
    "user_edit_stats": _sql(),
    "user_edit_stats_per_ns": _sql(per_namespace=True),
    "user_edit_stats_bots": _sql(8, bots="SELECT DISTINCT event_type AS name FROM events ORDER BY 1 LIMIT 2"),
    "dump_totals": f"WITH {bridge.ctes('revision')} SELECT count(DISTINCT page_id) AS pages, count(*) AS revisions, count(DISTINCT contributor) AS users FROM revision",
}
