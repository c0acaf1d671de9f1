"""Page views and trending scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import trending_score
from palimpsest.functions.titles import url_title


def page_counts(lines: DataFrame, project: str) -> DataFrame:
    """lines: value. title, views of one project's lines of exactly three fields; other lines of it raise."""
    f = lines.select(F.split("value", " ").alias("f"))
    wrong = F.raise_error(F.concat(F.lit("not three fields: "), F.array_join("f", " "))).cast("boolean")
    rows = f.where(F.when(F.size("f") == 3, F.col("f")[0] == project).otherwise(wrong))
    return rows.select(url_title(F.col("f")[1]).alias("title"), F.col("f")[2].cast("long").alias("views")).where("title != ''")


def project_views(lines: DataFrame, projects: list[str]) -> DataFrame:
    """title, views: sums over all lines of the projects."""
    f = lines.select(F.split("value", " ").alias("f")).where(F.col("f")[0].isin(*projects) & (F.size("f") >= 3))
    return f.groupBy(F.col("f")[1].alias("title")).agg(F.sum(F.col("f")[2].cast("long")).alias("views"))


def daily_views(views: DataFrame) -> DataFrame:
    """title, day, views over all projects."""
    return views.groupBy("title", "day").agg(F.sum("views").alias("views"))


def scores(daily: DataFrame, today: dt.date) -> DataFrame:
    """title, earlier (half the views one to three weeks ago), later (views of the last week), score."""
    age = F.date_diff(F.lit(today), F.col("day"))
    sums = daily.groupBy("title").agg(
        F.sum(F.when((age >= 7) & (age < 21), F.col("views")).otherwise(0)).alias("before"),
        F.sum(F.when((age >= 0) & (age < 7), F.col("views")).otherwise(0)).alias("later"),
    )
    return sums.select("title", (F.col("before") / 2).alias("earlier"), "later").withColumn("score", trending_score(F.col("earlier"), F.col("later")))
