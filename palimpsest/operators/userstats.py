"""Edit statistics per user, from full revision histories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import utf16_length

RECENT_DAYS, REPEAT_LIMIT = 30, 20
_SUMS = ("revisions", "minors", "dsize", "new_pages", "recent_revisions", "recent_minors", "recent_dsize", "recent_new_pages", "comment_len", "edits", "recent_edits")


def edit_spans(revisions: DataFrame, date0: dt.datetime, repeat_limit: int = REPEAT_LIMIT) -> DataFrame:
    """One row per span: a run of a page's revisions by one user without a gap of more than repeat_limit minutes.

    A revision with the user and text of its predecessor is a null edit and does not count. Only the length and two
    hashes of a text take part in the shuffle, never the text."""
    page = Window.partitionBy("page_id").orderBy("rev_seq")
    rows = revisions.select(
        "page_id",
        "ns",
        "rev_seq",
        "ts",
        "contributor",
        F.coalesce("minor", F.lit(False)).alias("minor"),
        F.coalesce(utf16_length(F.col("comment")), F.lit(0)).alias("comment_len"),
        utf16_length(F.coalesce("text", F.lit(""))).alias("size"),
        F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("content"),
    )
    before = rows.select(
        "*",
        F.lag("contributor").over(page).alias("last_user"),
        F.lag("content").over(page).alias("last_content"),
        F.lag("size", 1, 0).over(page).alias("last_size"),
        F.lag("ts").over(page).alias("last_ts"),
        (F.row_number().over(page) == 1).alias("is_new"),
    )
    same_user = F.coalesce(F.col("last_user") == F.col("contributor"), F.lit(False))
    null_edit = same_user & F.coalesce(F.col("last_content") == F.col("content"), F.lit(False)) & (F.col("last_size") == F.col("size"))
    late = F.col("last_ts") + F.make_dt_interval(mins=F.lit(repeat_limit)) < F.col("ts")
    breaks = ~null_edit & (F.col("is_new") | ~same_user | (late if repeat_limit else F.lit(True)))
    recent = F.col("ts") >= F.lit(date0 - dt.timedelta(days=RECENT_DAYS)).cast("timestamp_ntz")
    marked = before.select(
        "page_id",
        "ns",
        "contributor",
        "ts",
        "minor",
        "comment_len",
        "is_new",
        null_edit.alias("null_edit"),
        (F.col("size") - F.col("last_size")).alias("diff"),
        F.coalesce(recent, F.lit(False)).alias("recent"),
        F.sum(breaks.cast("long")).over(page.rowsBetween(Window.unboundedPreceding, 0)).alias("span"),
    ).where("not null_edit")
    count = lambda c: F.count_if(c)
    return marked.groupBy("page_id", "span", "contributor", "ns").agg(
        F.count("*").alias("revisions"),
        count(F.col("minor")).alias("minors"),
        F.sum("diff").alias("dsize"),
        count(F.col("is_new")).alias("new_pages"),
        count(F.col("recent")).alias("recent_revisions"),
        count(F.col("recent") & F.col("minor")).alias("recent_minors"),
        F.sum(F.when(F.col("recent"), F.col("diff")).otherwise(0)).alias("recent_dsize"),
        count(F.col("recent") & F.col("is_new")).alias("recent_new_pages"),
        F.sum("comment_len").alias("comment_len"),
        F.lit(1).cast("long").alias("edits"),
        F.max("recent").cast("long").alias("recent_edits"),
        F.min("ts").alias("first_edit"),
        F.max("ts").alias("last_edit"),
    )


def namespace_class(ns: Column) -> Column:
    return F.when(ns % 2 != 0, "talk").when(ns == 0, "main").otherwise("others")


def user_edit_stats(
    revisions: DataFrame,
    date0: dt.datetime,
    bots: DataFrame | None = None,
    namespaces: list[int] | None = None,
    repeat_limit: int = REPEAT_LIMIT,
    per_namespace: bool = False,
) -> DataFrame:
    """contributor, group_name, is_bot, ten counters, first_edit, last_edit, average_span, average_comment.

    Every user has the groups main, others, talk and total (and ns<k> for each of namespaces, if asked for), empty ones
    too. Pages of a namespace that is not listed do not count, but their users appear. bots: one column, name."""
    known = revisions if namespaces is None else revisions.where(F.col("ns").isin(*[n for n in namespaces if n >= 0]))
    spans = edit_spans(known, date0, repeat_limit)
    sums = [F.sum(c).alias(c) for c in _SUMS] + [F.min("first_edit").alias("first_edit"), F.max("last_edit").alias("last_edit")]
    by_ns = spans.groupBy("contributor", "ns").agg(*sums)
    rolled = by_ns.withColumn("class", namespace_class(F.col("ns"))).groupingSets([["contributor"], ["contributor", "class"]] + ([["contributor", "ns"]] if per_namespace else []), "contributor", "class", "ns")
    name = F.when(F.grouping("class") == 0, F.col("class")).when(F.grouping("ns") == 0, F.concat(F.lit("ns"), F.col("ns").cast("string"))).otherwise("total")
    found = rolled.agg(name.alias("group_name"), *sums).drop("class", "ns")
    names = ["main", "others", "talk", "total"] + [f"ns{k}" for k in (namespaces or [] if per_namespace else []) if k >= 0]
    users = revisions.select("contributor").distinct().withColumn("group_name", F.explode(F.array(*map(F.lit, names))))
    if bots is not None:
        users = users.join(bots.select(F.col("name").alias("contributor"), F.lit(True).alias("is_bot")).distinct(), "contributor", "left")
    else:
        users = users.withColumn("is_bot", F.lit(False))
    out = users.join(found, ["contributor", "group_name"], "left")
    average = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 5)
    return out.select(
        "contributor",
        "group_name",
        F.coalesce("is_bot", F.lit(False)).alias("is_bot"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SUMS if c != "comment_len"],
        "first_edit",
        "last_edit",
        average("revisions", "edits").alias("average_span"),
        average("comment_len", "revisions").alias("average_comment"),
    )


def totals(revisions: DataFrame) -> DataFrame:
    """pages, revisions, users"""
    return revisions.agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("revisions"), F.countDistinct("contributor").alias("users"))
