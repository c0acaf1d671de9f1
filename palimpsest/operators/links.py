"""Table loaders: casts by position, resolution of link targets, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.titles import CATEGORY

# Ids of pages that are only link targets.
MISSING_CATEGORY, MISSING_TEMPLATE, MISSING_PAGE = -1, -2, -3
#: Columns of each dump table, by position.
ARITY = {"page": 13, "categorylinks": 7, "templatelinks": 4, "pagelinks": 4, "externallinks": 3}


def _checked(rows: DataFrame, table: str) -> DataFrame:
    n = ARITY[table]
    wrong = F.raise_error(F.concat(F.lit(f"{table}: expected {n} columns, not "), F.size("values").cast("string")))
    return rows.select(F.when(F.size("values") == n, F.col("values")).otherwise(wrong.cast("array<string>")).alias("v"))


def load_pages(rows: DataFrame) -> DataFrame:
    """rows: values array<string>, as the dump source gives them. Category pages are never redirects."""
    v = _checked(rows, "page")
    ns = F.col("v")[1].cast("int")
    return v.select(F.col("v")[0].cast("int").alias("page_id"), ns.alias("ns"), F.col("v")[2].alias("title"), F.when(ns == CATEGORY, F.lit(False)).otherwise(F.col("v")[4].cast("int") != 0).alias("is_redirect"))


def load_links(rows: DataFrame, table: str) -> DataFrame:
    """from_id, ns, title (categorylinks, templatelinks, pagelinks) or from_id, url (externallinks)."""
    v = _checked(rows, table)
    source = F.col("v")[0].cast("int").alias("from_id")
    if table == "externallinks":
        return v.select(source, F.col("v")[1].alias("url")).distinct()
    if table == "categorylinks":
        return v.select(source, F.lit(CATEGORY).alias("ns"), F.col("v")[1].alias("title")).distinct()
    return v.select(source, F.col("v")[1].cast("int").alias("ns"), F.col("v")[2].alias("title")).distinct()


def resolve(links: DataFrame, pages: DataFrame, missing: int) -> DataFrame:
    """from_id, ns, title, to_id: links from known pages; to_id is the target's id, or `missing` where there is no page."""
    known = links.join(pages.select(F.col("page_id").alias("from_id")), "from_id", "left_semi")
    targets = pages.select("ns", "title", F.col("page_id").alias("to_id"))
    return known.join(targets, ["ns", "title"], "left").select("from_id", "ns", "title", F.coalesce("to_id", F.lit(missing)).alias("to_id"))


def broken_sources(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links from pages that do not exist."""
    return links.join(pages.select(F.col("page_id").alias("from_id")), "from_id", "left_anti")


def split_members(category_links: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subcategories, articles) of resolved category links, by the namespace of the source."""
    with_ns = category_links.join(pages.select(F.col("page_id").alias("from_id"), F.col("ns").alias("from_ns")), "from_id")
    return with_ns.where(F.col("from_ns") == CATEGORY).drop("from_ns"), with_ns.where(F.col("from_ns") != CATEGORY).drop("from_ns")


def diagnostics(**frames: tuple[DataFrame, str, str]) -> DataFrame:
    """severity, table, message: name=(rows, severity, column of the message)."""
    out = None
    for name, (rows, severity, message) in frames.items():
        part = rows.select(F.lit(severity).alias("severity"), F.lit(name).alias("table"), F.col(message).cast("string").alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_fixups(members: DataFrame, fixups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members: category, page; fixups: page, category, to remove. (members that stay, fixups that name no member)."""
    return members.join(fixups, ["category", "page"], "left_anti"), fixups.join(members, ["category", "page"], "left_anti")


def red_links(links: DataFrame, pages: DataFrame, ns: int = 0) -> DataFrame:
    """links: src, dst, dst_exists. Missing targets and how many pages of the namespace link to them."""
    inside = pages.where(F.col("ns") == ns).select(F.col("page_id").alias("src"))
    return links.where("not dst_exists").join(inside, "src", "left_semi").groupBy("dst").agg(F.countDistinct("src").alias("wanted_by"))


def neighbourhood(ids: DataFrame, edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """ids with a sorted array of the other ends of their edges (empty: no edges)."""
    grouped = edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(value)).alias(name))
    return ids.join(grouped, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
