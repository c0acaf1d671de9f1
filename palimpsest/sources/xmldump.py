"""XML history dumps: one row per revision, and the site's own data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.titles import NAMESPACES, parse_title

REVISION = "struct<id:int,parentid:int,timestamp:timestamp,minor:string,contributor:struct<_deleted:string,ip:string,id:int,username:string>,comment:string,sha1:string,model:string,format:string,text:string>"
PAGE = f"title string, ns string, id int, redirect string, restrictions string, revision array<{REVISION}>"
DELETED = "#deleted#"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)


def read_namespaces(spark: SparkSession, path: str) -> dict[int, str]:
    """Number -> name of the site's namespaces; a few dozen at most."""
    rows = _xml(spark, path, "namespace", "_key int, _VALUE string").collect()
    return {r["_key"]: r["_VALUE"] or "" for r in rows} or dict(NAMESPACES)


def read_site(spark: SparkSession, path: str) -> DataFrame:
    return _xml(spark, path, "siteinfo", "sitename string, base string, dbname string, generator string, `case` string")


def read_history(spark: SparkSession, path: str, site: dict[int, str] | None = None) -> DataFrame:
    """page_id, page_seq, rev_seq, ns, title, is_redirect, rev_id, parent_id, ts, minor, contributor (key), user_id,
    user_name, ip, comment, text.

    The namespace comes from the title. Registered users are known by id, anonymous ones by address, deleted ones are all
    one. A page or revision without a required element raises."""
    pages = _xml(spark, path, "page", PAGE).withColumn("page_seq", F.monotonically_increasing_id())
    named = pages.withColumn("t", parse_title(F.col("title"), site))
    r = named.select("id", "page_seq", "t", F.col("redirect").isNotNull().alias("is_redirect"), F.posexplode("revision").alias("rev_seq", "r"))
    who = F.col("r.contributor")
    deleted = who["_deleted"].isNotNull()
    fits = deleted | (who["ip"].isNotNull() != (who["id"].isNotNull() & who["username"].isNotNull()))
    required = F.col("id").isNotNull() & F.col("t.title").isNotNull() & F.col("r.id").isNotNull() & F.col("r.timestamp").isNotNull() & who.isNotNull() & F.col("r.text").isNotNull() & fits
    bad = F.raise_error(F.concat(F.lit("incomplete revision in page "), F.coalesce(F.col("id").cast("string"), F.lit("?")))).cast("boolean")
    r = r.where(F.when(required, True).otherwise(bad))
    ip = F.when(deleted, DELETED).otherwise(who["ip"])
    return r.select(
        F.col("id").cast("long").alias("page_id"),
        "page_seq",
        F.col("rev_seq").cast("long").alias("rev_seq"),
        F.col("t.ns").alias("ns"),
        F.col("t.title").alias("title"),
        "is_redirect",
        F.col("r.id").alias("rev_id"),
        F.coalesce("r.parentid", F.lit(0)).alias("parent_id"),
        F.col("r.timestamp").cast("timestamp_ntz").alias("ts"),
        F.col("r.minor").isNotNull().alias("minor"),
        F.when(ip.isNotNull(), F.concat(F.lit("ip:"), ip)).otherwise(F.concat(F.lit("id:"), who["id"].cast("string"))).alias("contributor"),
        F.when(~deleted, who["id"]).alias("user_id"),
        F.when(~deleted, who["username"]).alias("user_name"),
        ip.alias("ip"),
        F.coalesce("r.comment", F.lit("")).alias("comment"),
        F.col("r.text").alias("text"),
    )


def display_names(history: DataFrame) -> DataFrame:
    """contributor, name, user_id, ip: the name of each user's first sighting in the dump."""
    seen = F.struct("page_seq", "rev_seq")
    return history.groupBy("contributor").agg(F.min_by(F.coalesce("user_name", "ip"), seen).alias("name"), F.first("user_id").alias("user_id"), F.first("ip").alias("ip"))
