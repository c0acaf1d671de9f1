"""Plain text inputs: space-separated files, page-view folders, name lists, category fixups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.titles import parse_engine_title
from palimpsest.operators.trending import project_views


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """fields array<string>: lines split at each blank, empty fields kept."""
    return spark.read.text(path).select(F.split("value", " ").alias("fields"))


def read_page_views(spark: SparkSession, folder: str, projects: list[str], pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, views of known pages; title, views of titles that are no page), over all files of the folder."""
    views = project_views(spark.read.text(folder), projects).withColumn("t", parse_engine_title(F.col("title")))
    known = pages.select("page_id", "ns", F.col("title").alias("name"))
    on = (F.col("t.ns") == known["ns"]) & (F.col("t.title") == known["name"])
    return views.join(known, on).groupBy("page_id").agg(F.sum("views").alias("views")), views.join(known, on, "left_anti").select("title", "views")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name: trimmed lines that are not empty, once each."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != ''").distinct()


def read_fixups(spark: SparkSession, path: str) -> DataFrame:
    """page, category of lines -cat|Page|Category; what follows a # is a comment. Other lines raise."""
    line = spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("line")).where("line != ''")
    f = line.select("line", F.split("line", r"\|").alias("f"))
    bad = F.raise_error(F.concat(F.lit("not a fixup: "), "line")).cast("boolean")
    f = f.where(F.when((F.size("f") == 3) & (F.col("f")[0] == "-cat"), True).otherwise(bad))
    return f.select(F.col("f")[1].alias("page"), F.col("f")[2].alias("category"))
