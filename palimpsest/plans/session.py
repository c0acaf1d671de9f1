"""An interactive session: a current set of pages, named sets, and a small command language over them."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.titles import NAMESPACES, TEMPLATE, display_title, parse_title
from palimpsest.operators import graph, links, selectors
from palimpsest.operators.selectors import WikiTables

HELP = (
    "= + - ~ * ?  with  ns category categoryre duplicates template pagelink extlink;  count list sort transform set get unset vars "
    "popular page category cycles furthestfrom longestpaths wantedarticles help quit"
)


class WikiSession:
    """Sets are lazy and immutable; only count, list and popular run anything. A stored set is a snapshot.

    views: project, page_id, views; or a function from projects to page_id, views."""

    def __init__(self, spark: SparkSession, tables: WikiTables, views: DataFrame | Callable[[list[str]], DataFrame] | None = None, legacy_regex_normalise: bool = False):
        self.spark, self.tables, self.views, self.legacy = spark, tables, views, legacy_regex_normalise
        self.current = tables.page.select("page_id").limit(0)
        self.variables: dict[str, DataFrame] = {}
        self.sort_key: str | None = None
        self.rewrite: tuple[str, str] | None = None

    def select(self, word: str, argument: str) -> DataFrame:
        if word not in selectors.SELECTORS:
            raise ValueError(f"unknown selector {word}")
        value: Any = argument
        if word in ("ns", "namespace"):
            numbers = {n.lower(): i for i, n in NAMESPACES.items()}
            if not re.fullmatch(r"[+-]?\d+", argument) and argument.lower() not in numbers:
                raise ValueError(f"no such namespace {argument}")
            value = int(argument) if re.fullmatch(r"[+-]?\d+", argument) else numbers[argument.lower()]
        elif word == "pagelink":
            return self.linking_to(argument)
        elif word == "template" and "template_ns" in self.tables.templatelink.columns:
            ns, title = self.split_title(argument if ":" in argument else f"{NAMESPACES[TEMPLATE]}:{argument}")
            found = selectors.with_template(self.tables, title, ns)
            if found.isEmpty():
                raise ValueError(f"no such template {argument}")
            return found
        elif word not in ("extlink", "categoryre", "catre") or self.legacy:
            value = argument.replace(" ", "_")
            value = value[:1].upper() + value[1:]
            if word in ("category", "cat", "duplicates", "dupes"):
                self.category_id(value)
            elif word == "template" and self.tables.templatelink.where(F.col("template") == value).isEmpty():
                raise ValueError(f"no such template {argument}")
        return selectors.SELECTORS[word](self.tables, value)

    def split_title(self, full: str) -> tuple[int, str]:
        """(namespace, title) of a full title."""
        row = self.spark.range(1).select(parse_title(F.lit(full.replace(" ", "_"))).alias("t")).first()["t"]
        return row["ns"], row["title"][:1].upper() + row["title"][1:]

    def page_id(self, argument: str) -> int:
        """Of a page by its number or full title."""
        if re.fullmatch(r"\d+", argument):
            return int(argument)
        ns, title = self.split_title(argument)
        row = self.tables.page.where((F.col("ns") == ns) & (F.col("title") == title)).first()
        if not row:
            raise ValueError(f"no such page {argument}")
        return row["page_id"]

    def linking_to(self, argument: str) -> DataFrame:
        """Pages that link to a page by its number or full title; with dst_ns and dst_title in the link table, also to a title
        that is no page."""
        links_ = self.tables.pagelink
        if not re.fullmatch(r"\d+", argument) and "dst_title" in links_.columns:
            ns, title = self.split_title(argument)
            found = links_.where((F.col("dst_ns") == ns) & (F.col("dst_title") == title)).select(F.col("src").alias("page_id")).distinct()
            if found.isEmpty():
                self.page_id(argument)
            return found
        return selectors.linking_to(self.tables, self.page_id(argument))

    def category_id(self, name: str) -> Any:
        name = name.replace(" ", "_")
        row = self.tables.category.where(F.col("title") == name[:1].upper() + name[1:]).first()
        if not row:
            raise ValueError(f"no such category {name}")
        return row["cat_id"]

    def page_info(self, argument: str) -> list[str]:
        """The categories of a page, sorted."""
        mine = self.tables.catarticle.where(F.col("page") == self.page_id(argument))
        named = mine.join(self.tables.category, mine["category"] == self.tables.category["cat_id"]).select("title").distinct()
        return sorted(r["title"] for r in named.collect()) or ["(uncategorized)"]

    def category_info(self, argument: str) -> dict[str, Any]:
        """Super- and subcategories of a category, and how many pages it has."""
        me, t = self.category_id(argument), self.tables
        ends = lambda key, other: sorted(r["title"] for r in t.subcat.where(F.col(key) == me).join(t.category, F.col(other) == F.col("cat_id")).select("title").distinct().collect())
        return {"above": ends("child", "parent"), "below": ends("parent", "child"), "pages": t.catarticle.where(F.col("category") == me).select("page").distinct().count()}

    def wanted(self) -> DataFrame:
        """dst, wanted_by: missing pages by how many articles link to them."""
        known = self.tables.page.select(F.col("page_id").alias("dst"), F.lit(True).alias("known"))
        links_ = self.tables.pagelink.select("src", "dst", *(c for c in ("dst_ns", "dst_title") if c in self.tables.pagelink.columns))
        rows = links_.join(known, "dst", "left").withColumn("dst_exists", F.coalesce("known", F.lit(False)))
        if "dst_title" in rows.columns:
            rows = rows.withColumn("dst", F.concat_ws(":", "dst_ns", "dst_title"))
        return links.red_links(rows, self.tables.page).orderBy(F.desc("wanted_by"), "dst")

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return self.tables.pagelink.select("src", "dst"), self.tables.page.where("is_redirect").select("page_id")

    def operate(self, op: str, word: str, argument: str) -> DataFrame:
        if op in "-*" and self.current.isEmpty():
            raise ValueError("the current set is empty")
        self.current = selectors.OPERATIONS[op](self.current, self.select(word, argument))
        return self.current

    def listing(self, n: int = 0) -> DataFrame:
        """page_id, shown: display titles, by the sort pattern's match (or the title), rewritten on demand; n = 0: all."""
        rows = self.tables.page.join(self.current, "page_id", "left_semi").select("page_id", display_title(F.col("ns"), F.col("title")).alias("display"))
        if self.sort_key:
            match = F.regexp_extract("display", self.sort_key, 0)
            rows = rows.orderBy(F.when(match != "", match).otherwise(F.col("display")), "display")
        shown = F.regexp_replace("display", *self.rewrite) if self.rewrite else F.col("display")
        rows = rows.select("page_id", shown.alias("shown"))
        return rows.limit(n) if n else rows

    def popular(self, n: int, projects: list[str]) -> DataFrame:
        """page_id, views of the current set, most viewed first, none without views."""
        if self.views is None:
            raise ValueError("no page views are loaded")
        views = self.views(projects) if callable(self.views) else self.views.where(F.col("project").isin(*projects))
        views = views.groupBy("page_id").agg(F.sum("views").alias("views"))
        rows = self.current.join(views, "page_id", "left").select("page_id", F.coalesce("views", F.lit(0)).alias("views")).where("views > 0").orderBy(F.desc("views"), "page_id")
        return rows.limit(n) if n else rows

    def command(self, line: str) -> Any:
        """One line of the command language; None ends the session."""
        words = line.split()
        if not words:
            return ""
        verb, rest = words[0], words[1:]
        if verb in ("quit", "exit", "bye"):
            return None
        if verb == "help":
            return HELP
        if verb == "?":
            return self.select(rest[0], " ".join(rest[1:])).count()
        if verb in selectors.OPERATIONS:
            return self.operate(verb, rest[0], " ".join(rest[1:])).count()
        if verb == "count":
            return self.current.count()
        if verb == "list":
            return [r["shown"] for r in self.listing(int(rest[0]) if rest else 20).collect()]
        if verb == "sort":
            try:
                self.sort_key = re.compile(" ".join(rest)).pattern or None
            except re.error:
                self.sort_key = None
            return self.sort_key
        if verb == "transform":
            self.rewrite = (rest[0], re.sub(r"\$\{(\w+)\}", r"$\1", " ".join(rest[1:]))) if rest else None
            return self.rewrite
        if verb == "popular":
            return [(r["page_id"], r["views"]) for r in self.popular(int(rest[0]), rest[1:]).collect()]
        if verb == "page":
            return self.page_info(" ".join(rest))
        if verb in ("category", "cat"):
            return self.category_info(" ".join(rest))
        if verb == "wantedarticles":
            rows = self.wanted().limit(int(rest[0])) if rest else self.wanted()
            return [tuple(r) for r in rows.collect()]
        if verb == "cycles":
            edges = self.tables.subcat.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
            return sorted((r["length"], list(r["nodes"])) for r in graph.cycles(edges).collect())
        if verb == "furthestfrom":
            return sorted((r["dist"], r["node"]) for r in graph.furthest(self.page_id(" ".join(rest)), *self._graph()).collect())
        if verb == "longestpaths":
            return sorted((r["dist"], list(r["path"])) for r in graph.longest_shortest_paths(*self._graph()).collect())
        if verb == "set":
            self.variables[rest[0]] = self.current
            return rest[0]
        if verb == "get":
            self.current = self.variables[rest[0]]
            return rest[0]
        if verb == "unset":
            return self.variables.pop(rest[0], None) is not None
        if verb == "vars":
            return sorted(self.variables)
        raise ValueError(f"unknown command {verb}")
