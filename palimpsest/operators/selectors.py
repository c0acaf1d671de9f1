"""Selectors: sets of page ids, as DataFrames with one column page_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.titles import TEMPLATE
from palimpsest.operators.graph import closure


@dataclass
class WikiTables:
    """page(page_id, ns, title, is_redirect); category(cat_id, title), subcat(parent, child), catarticle(category, page);
    templatelink(page_id, template); pagelink(src, dst); extlink(page_id, url). Links are edge rows."""

    page: DataFrame | None = None
    category: DataFrame | None = None
    subcat: DataFrame | None = None
    catarticle: DataFrame | None = None
    templatelink: DataFrame | None = None
    pagelink: DataFrame | None = None
    extlink: DataFrame | None = None


def in_namespace(t: WikiTables, ns: int) -> DataFrame:
    return t.page.where(F.col("ns") == ns).select("page_id")


def inside_categories(t: WikiTables, roots: DataFrame) -> DataFrame:
    """roots: node. The articles of the roots and of all their descendants."""
    inside = closure(roots, t.subcat.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    return t.catarticle.join(inside, t.catarticle["category"] == inside["node"], "left_semi").select(F.col("page").alias("page_id")).distinct()


def in_category(t: WikiTables, name: str) -> DataFrame:
    return inside_categories(t, t.category.where(F.col("title") == name).select(F.col("cat_id").alias("node")))


def in_category_matching(t: WikiTables, pattern: str) -> DataFrame:
    """Of every category whose title the pattern finds; one walk from all of them."""
    return inside_categories(t, t.category.where(F.col("title").rlike(pattern)).select(F.col("cat_id").alias("node")))


def duplicates_in_category(t: WikiTables, roots: DataFrame) -> DataFrame:
    """Articles that are direct members of two or more categories of the closure."""
    inside = closure(roots, t.subcat.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    members = t.catarticle.join(inside, t.catarticle["category"] == inside["node"], "left_semi").select("category", "page").distinct()
    return members.groupBy("page").count().where("count > 1").select(F.col("page").alias("page_id"))


def with_template(t: WikiTables, template: str, ns: int = TEMPLATE) -> DataFrame:
    """The namespace counts where the link table has a column template_ns."""
    found = t.templatelink.where(F.col("template") == template)
    if "template_ns" in t.templatelink.columns:
        found = found.where(F.col("template_ns") == ns)
    return found.select("page_id").distinct()


def linking_to(t: WikiTables, dst: int) -> DataFrame:
    """The target may be missing (a phantom)."""
    return t.pagelink.where(F.col("dst") == dst).select(F.col("src").alias("page_id")).distinct()


def with_external_link(t: WikiTables, pattern: str) -> DataFrame:
    return t.extlink.where(F.col("url").rlike(pattern)).select("page_id").distinct()


#: Words of the query language; more can be registered.
SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "ns": in_namespace,
    "namespace": in_namespace,
    "category": in_category,
    "cat": in_category,
    "categoryre": in_category_matching,
    "catre": in_category_matching,
    "duplicates": lambda t, name: duplicates_in_category(t, t.category.where(F.col("title") == name).select(F.col("cat_id").alias("node"))),
    "dupes": lambda t, name: duplicates_in_category(t, t.category.where(F.col("title") == name).select(F.col("cat_id").alias("node"))),
    "template": with_template,
    "pagelink": linking_to,
    "extlink": with_external_link,
}
#: Selectors that only look at the pages they are given; the others walk all categories.
LOCAL = {"ns", "namespace", "template", "pagelink", "extlink"}


def register(word: str, selector: Callable[..., DataFrame]) -> None:
    SELECTORS[word] = selector


# Set operations over page_id frames: (current, selected) -> new current.
def replace(current: DataFrame, selected: DataFrame) -> DataFrame:
    return selected


def add(current: DataFrame, selected: DataFrame) -> DataFrame:
    return current.unionByName(selected).distinct()


def subtract(current: DataFrame, selected: DataFrame) -> DataFrame:
    return current.join(selected, "page_id", "left_anti")


def reverse_subtract(current: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.join(current, "page_id", "left_anti")


def intersect(current: DataFrame, selected: DataFrame) -> DataFrame:
    return current.join(selected, "page_id", "left_semi")


OPERATIONS = {"=": replace, "+": add, "-": subtract, "~": reverse_subtract, "*": intersect}


def operand_count(op: str, word: str, current: DataFrame, selected: DataFrame) -> int:
    """How many pages the evaluated operand has: of what a local selector finds under - and *, only pages of the current
    set; under ~, only those that are not in it."""
    if op in "-*" and word in LOCAL:
        selected = intersect(selected, current)
    elif op == "~":
        selected = subtract(selected, current)
    return selected.count()
