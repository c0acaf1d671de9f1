"""Output files: statistics as XML, wanted pages as CSV, blame as text or HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import thousands
from palimpsest.operators.blame import blame_html, blame_text
from palimpsest.plans.storage import written

# Elements of a group, by column.
ELEMENTS = {
    "first_edit": "firstedit",
    "last_edit": "lastedit",
    "edits": "edits",
    "revisions": "revisions",
    "minors": "minors",
    "dsize": "dsize",
    "new_pages": "newpages",
    "recent_edits": "recentedits",
    "recent_revisions": "recentrevisions",
    "recent_minors": "recentminors",
    "recent_dsize": "recentdsize",
    "recent_new_pages": "recentnewpages",
    "average_span": "averagespan",
    "average_comment": "averagecomment",
}
NEVER = "0001-01-01T00:00:00"


def write_user_stats(stats: DataFrame, names: DataFrame, path: str) -> None:
    """<userstats><user id name | ip><bot/><group name>...; names: contributor, name, user_id, ip."""
    def cell(column: str) -> F.Column:
        if column.endswith("_edit"):
            return F.coalesce(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(NEVER))
        return thousands(F.col(column)) if column.startswith("average") else F.col(column).cast("string")

    group = F.struct(F.col("group_name").alias("_name"), *(cell(c).alias(e) for c, e in ELEMENTS.items()))
    users = stats.groupBy("contributor").agg(F.sort_array(F.collect_list(group)).alias("group"), F.max("is_bot").alias("is_bot")).join(names, "contributor")
    out = users.select(F.col("user_id").alias("_id"), F.when(F.col("user_id").isNotNull(), F.col("name")).alias("_name"), F.col("ip").alias("_ip"), F.when(F.col("is_bot"), F.lit("")).alias("bot"), "group")
    out.write.format("xml").option("rootTag", "userstats").option("rowTag", "user").mode("overwrite").save(path)


def write_wanted(wanted: DataFrame, path: str) -> None:
    """count;title, unquoted, most wanted first; files in order of their names."""
    wanted.select("wanted_by", "dst").orderBy(F.desc("wanted_by"), "dst").write.option("sep", ";").option("quote", "").mode("overwrite").csv(path)


def write_blame(lines: DataFrame, path: str) -> None:
    """One row a line, by page and line; files in order of their names. Ranges are found by a pass of its own, so the lines
    are kept for it: else all pages would be folded twice."""
    ordered = written(lines).repartitionByRange("page_id", "line_no").sortWithinPartitions("page_id", "line_no")
    blame_text(ordered).write.mode("overwrite").text(path)


def write_blame_html(lines: DataFrame, page_id: int, path: str) -> None:
    """One page; through Spark, so any file system will do."""
    spark = lines.sparkSession
    spark.createDataFrame([(blame_html(lines, page_id),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_diagnostics(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", F.col("severity"), F.col("table"), F.col("message")).alias("value")).write.mode("overwrite").text(path)
