"""Live database tables over JDBC; the driver's jar comes with the session."""

from __future__ import annotations

import zlib
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMES = ("mysql", "mysql-tcp", "mysql-memory", "mysql-pipe")


def is_url(location: str) -> bool:
    return location.split("://", 1)[0] in SCHEMES and "://" in location


def translate(location: str) -> tuple[str, dict[str, str], list[str]]:
    """(JDBC url, properties, path parts after the database) of mysql://user:password@host:port/db/..."""
    u = urlsplit(location)
    if u.scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {u.scheme}")
    if u.scheme in SCHEMES[2:]:
        raise ValueError(f"{u.scheme}: only TCP connections work over JDBC")
    parts = [unquote(p) for p in u.path.split("/") if p]
    if not parts:
        raise ValueError("no database in the url")
    properties = {k: unquote(v) for k, v in (("user", u.username), ("password", u.password)) if v}
    return f"jdbc:mysql://{u.hostname or 'localhost'}:{u.port or 3306}/{parts[0]}", properties, parts[1:]


#: A table is read by one task for each so many values of its key, by PARTS at most.
PART_KEYS, PARTS = 500_000, 1000


def read_keyed(spark: SparkSession, url: str, table: str, properties: dict[str, str], key: str | None = None) -> DataFrame:
    """A table of the database; with an integer key, in ranges of it read side by side (rows of a null key: in the first)."""
    properties = {"fetchsize": "10000"} | properties
    if key is None:
        return spark.read.jdbc(url, table, properties=properties)
    low, high = spark.read.jdbc(url, f"(select min({key}) as low_, max({key}) as high_ from {table}) bounds_", properties=properties).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    low, high = int(low), int(high)
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=min((high - low) // PART_KEYS + 1, PARTS), properties=properties)


def read_table(spark: SparkSession, location: str, prefix: str = "", key: str | None = None) -> DataFrame:
    """All columns as strings, nulls stay; key: an integer column to read ranges of side by side."""
    url, properties, rest = translate(location)
    t = read_keyed(spark, url, prefix + rest[0], properties, key)
    return t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])


def inflated(raw: Column) -> Column:
    """Text of a raw deflate stream."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else zlib.decompress(bytes(b), wbits=-15).decode())

    return run(raw)


def revision_text(raw: Column, flags: Column) -> Column:
    """Text of the text table: gzip is inflated, anything but utf-8 or with object raises."""
    kinds = F.split(flags, ",")
    bad = F.raise_error(F.concat(F.lit("unsupported text flags: "), flags)).cast("string")
    fits = F.array_contains(kinds, "utf-8") & ~F.array_contains(kinds, "object")
    return F.when(~fits, bad).when(F.array_contains(kinds, "gzip"), inflated(F.when(F.array_contains(kinds, "gzip"), raw))).otherwise(raw.cast("string"))


def join_history(page: DataFrame, revision: DataFrame, text: DataFrame, title: str | None = None, ns: int = 0, first: str | None = None, last: str | None = None) -> DataFrame:
    """Revisions of all pages, or of one, in a time range (both ends included); user 0 is anonymous. One join, with the
    filters pushed to the database. Order within a page: rev_timestamp, then rev_id."""
    if title is not None:
        page = page.where((F.col("page_title") == title) & (F.col("page_namespace") == ns))
    if first is not None:
        revision = revision.where(F.col("rev_timestamp") >= first)
    if last is not None:
        revision = revision.where(F.col("rev_timestamp") <= last)
    rows = page.join(revision, F.col("page_id") == F.col("rev_page")).join(text, F.col("rev_text_id") == F.col("old_id"))
    anonymous = F.col("rev_user") == 0
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("page_namespace").alias("ns"),
        F.col("page_title").alias("title"),
        F.col("page_is_redirect").cast("boolean").alias("is_redirect"),
        "rev_id",
        F.coalesce("rev_parent_id", F.lit(0)).alias("parent_id"),
        F.to_timestamp("rev_timestamp", "yyyyMMddHHmmss").cast("timestamp_ntz").alias("ts"),
        F.col("rev_minor_edit").cast("boolean").alias("minor"),
        F.when(anonymous, F.concat(F.lit("ip:"), "rev_user_text")).otherwise(F.concat(F.lit("id:"), F.col("rev_user").cast("string"))).alias("contributor"),
        "rev_user_text",
        F.coalesce("rev_comment", F.lit("")).alias("comment"),
        revision_text(F.col("old_text"), F.col("old_flags")).alias("text"),
    )


def read_history(spark: SparkSession, location: str, prefix: str = "", first: str | None = None, last: str | None = None) -> DataFrame:
    """History of mysql://.../db[/page title]."""
    url, properties, rest = translate(location)
    keys = {"page": "page_id", "revision": "rev_id", "text": "old_id"}
    page, revision, text = (read_keyed(spark, url, prefix + t, properties, key) for t, key in keys.items())
    return join_history(page, revision, text, rest[0].replace(" ", "_") if rest else None, 0, first, last)
