"""Queries: selectors, set operations, link tables and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.titles import display_title
from palimpsest.operators import links, selectors
from palimpsest.operators.graph import reverse_links
from palimpsest.operators.selectors import WikiTables
from palimpsest.plans import bridge

TEMPLATE, TARGET, URL_PATTERN, ROOT = "Brand#11", 5, "/th", 5


def flat_tables(spark: SparkSession, sf_dir: str) -> WikiTables:
    return WikiTables(
        page=bridge.pages(spark, sf_dir),
        templatelink=bridge.template_links(spark, sf_dir),
        pagelink=bridge.page_links(spark, sf_dir),
        extlink=bridge.external_links(spark, sf_dir),
    )


def deep_tables(spark: SparkSession, sf_dir: str) -> WikiTables:
    return WikiTables(subcat=bridge.deep_subcategories(spark, sf_dir), catarticle=bridge.deep_articles(spark, sf_dir))


def named_tables(spark: SparkSession, sf_dir: str) -> WikiTables:
    return WikiTables(category=bridge.named_categories(spark, sf_dir), subcat=bridge.named_subcategories(spark, sf_dir), catarticle=bridge.named_articles(spark, sf_dir))


def _root(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(ROOT).cast("long").alias("node"))


def sel_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.in_namespace(flat_tables(spark, sf_dir), 0)


def sel_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.with_template(flat_tables(spark, sf_dir), TEMPLATE)


def sel_pagelink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.linking_to(flat_tables(spark, sf_dir), TARGET)


def sel_extlink_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.with_external_link(flat_tables(spark, sf_dir), URL_PATTERN)


def sel_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.inside_categories(deep_tables(spark, sf_dir), _root(spark))


def sel_category_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.in_category_matching(named_tables(spark, sf_dir), "^A")


def sel_category_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.duplicates_in_category(deep_tables(spark, sf_dir), _root(spark))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = flat_tables(spark, sf_dir)
    return selectors.in_namespace(t, 0), selectors.with_template(t, TEMPLATE)


def _operation(op: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return selectors.OPERATIONS[op](*_two(spark, sf_dir))

    return query


def op_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected pages, and the current set that stays as it is."""
    current, selected = _two(spark, sf_dir)
    return selected.agg(F.count("*").alias("n_selected")).crossJoin(current.agg(F.count("*").alias("n_current")))


def op_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored set is a snapshot: adding to the current set later leaves it alone."""
    current, selected = _two(spark, sf_dir)
    variables = {"x": current}
    current = selectors.add(current, selected)
    sizes = [d.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, d in (*variables.items(), ("result", current))]
    return sizes[0].unionByName(sizes[1])


def load_links_phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link with its resolved target; missing targets are -3."""
    pages = bridge.pages(spark, sf_dir).select("page_id", F.lit(0).alias("ns"), F.col("page_id").cast("string").alias("title"))
    rows = bridge.page_links(spark, sf_dir).select(F.col("src").alias("from_id"), F.lit(0).alias("ns"), F.col("dst").cast("string").alias("title"))
    return links.resolve(rows, pages, links.MISSING_PAGE).select("from_id", "title", F.col("to_id").cast("long").alias("to_id"))


def load_links_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics: links from missing pages (the links turned round), and links to missing pages."""
    pages, rows = bridge.pages(spark, sf_dir), bridge.page_links(spark, sf_dir)
    turned = rows.select(F.col("dst").alias("from_id"))
    return links.diagnostics(
        backlinks=(links.broken_sources(turned, pages), "warning", "from_id"),
        pagelinks=(rows.where("not dst_exists"), "notice", "dst"),
    )


def category_fixups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of categories after removals: a supplier leaves its nation's category if its balance is negative."""
    members = bridge.named_articles(spark, sf_dir)
    gone = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal < 0").select(F.col("s_name").alias("page"), F.concat(F.lit("N"), "s_nationkey").alias("category"))
    return links.apply_fixups(members, gone)[0].groupBy("category").agg(F.count("*").alias("members"))


def reverse_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse_links(bridge.page_links(spark, sf_dir).select("src", "dst"), bridge.pages(spark, sf_dir))


def wanted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.red_links(bridge.page_links(spark, sf_dir), bridge.pages(spark, sf_dir)).orderBy(F.desc("wanted_by"), "dst")


def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its categories."""
    members = bridge.named_articles(spark, sf_dir).join(bridge.named_categories(spark, sf_dir), F.col("category") == F.col("cat_id")).select("page", "title")
    found = links.neighbourhood(members.select(F.col("page").alias("id")).distinct(), members, "page", "title", "categories")
    return found.select(F.col("id").alias("page"), F.when(F.size("categories") == 0, "(uncategorized)").otherwise(F.array_join("categories", "|")).alias("categories"))


def category_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category with its super- and subcategories, and how many pages."""
    cats = bridge.named_categories(spark, sf_dir).select(F.col("cat_id").alias("id"), "title")
    subs = bridge.named_subcategories(spark, sf_dir)
    pages = bridge.named_articles(spark, sf_dir).groupBy(F.col("category").alias("id")).agg(F.countDistinct("page").alias("n_pages"))
    both = links.neighbourhood(links.neighbourhood(cats, subs, "child", "parent", "above"), subs, "parent", "child", "below")
    return both.join(pages, "id", "left").select("id", "title", F.array_join("above", "|").alias("supercategories"), F.array_join("below", "|").alias("subcategories"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("pages"))


def list_sorted_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: display title rewritten, sort key by a pattern, place in the order."""
    from pyspark.sql import Window

    shown = bridge.pages(spark, sf_dir).select("page_id", display_title(F.col("ns"), F.col("title")).alias("display"))
    match = F.regexp_extract("display", "[0-9]+$", 0)
    keyed = shown.select("page_id", "display", F.when(match != "", match).otherwise(F.col("display")).alias("sort_key"))
    # A list has one order: range partitions first, then numbers within them would do for output; here the place is a column.
    place = F.rank().over(Window.partitionBy(F.substring("sort_key", 1, 1)).orderBy("sort_key", "display")).cast("long")
    return keyed.select("page_id", F.regexp_replace("display", "_([0-9]+)$", " ($1)").alias("shown"), "sort_key", place.alias("place"))


def popular_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 pages with the most views in two projects; pages without views do not appear."""
    views = bridge.page_views(spark, sf_dir).where(F.col("project").isin("click", "view")).groupBy("title").agg(F.sum("views").alias("views"))
    pages = bridge.pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("title"), F.col("title").alias("name"))
    found = pages.join(views, "title", "left").select("name", F.coalesce("views", F.lit(0)).alias("views")).where("views > 0")
    return found.orderBy(F.desc("views"), "name").limit(50)


QUERIES = {
    "sel_namespace": sel_namespace,
    "sel_template": sel_template,
    "sel_pagelink": sel_pagelink,
    "sel_extlink_regex": sel_extlink_regex,
    "sel_category": sel_category,
    "sel_category_regex": sel_category_regex,
    "sel_category_duplicates": sel_category_duplicates,
    "op_replace": _operation("="),
    "op_add": _operation("+"),
    "op_subtract": _operation("-"),
    "op_reverse_subtract": _operation("~"),
    "op_intersect": _operation("*"),
    "op_count": op_count,
    "op_variables": op_variables,
    "load_links_phantoms": load_links_phantoms,
    "load_links_broken": load_links_broken,
    "category_fixups": category_fixups,
    "reverse_links": reverse_links_query,
    "wanted_articles": wanted_articles,
    "page_info": page_info,
    "category_info": category_info,
    "list_sorted_transformed": list_sorted_transformed,
    "popular_pages": popular_pages,
}

_CURRENT = "SELECT page_id FROM page WHERE ns = 0"
_SELECTED = f"SELECT DISTINCT page_id FROM templatelink WHERE template = '{TEMPLATE}'"
_BOTH = f"WITH {bridge.ctes('page', 'templatelink')}"
_CLOSURE = f"WITH RECURSIVE {bridge.ctes('deepsub', 'deeparticle')}, inside(node) AS (SELECT CAST({ROOT} AS BIGINT) UNION SELECT child FROM deepsub JOIN inside ON parent = node)"
ORACLE_SQL = {
    "sel_namespace": f"WITH {bridge.ctes('page')} {_CURRENT}",
    "sel_template": f"WITH {bridge.ctes('templatelink')} {_SELECTED}",
    "sel_pagelink": f"WITH {bridge.ctes('pagelink')} SELECT DISTINCT src AS page_id FROM pagelink WHERE dst = {TARGET}",
    "sel_extlink_regex": f"WITH {bridge.ctes('extlink')} SELECT DISTINCT page_id FROM extlink WHERE regexp_matches(url, '{URL_PATTERN}')",
    "sel_category": f"{_CLOSURE} SELECT DISTINCT page AS page_id FROM deeparticle JOIN inside ON category = node",
    "sel_category_regex": f"WITH RECURSIVE {bridge.ctes('namedcat', 'namedsub', 'namedarticle')}, inside(node) AS (SELECT cat_id FROM namedcat WHERE regexp_matches(title, '^A') UNION SELECT child FROM namedsub JOIN inside ON parent = node) SELECT DISTINCT page AS page_id FROM namedarticle JOIN inside ON category = node",
    "sel_category_duplicates": f"{_CLOSURE} SELECT page AS page_id FROM deeparticle JOIN inside ON category = node GROUP BY page HAVING count(DISTINCT category) > 1",
    "op_replace": f"{_BOTH} {_SELECTED}",
    "op_add": f"{_BOTH} {_CURRENT} UNION {_SELECTED}",
    "op_subtract": f"{_BOTH} {_CURRENT} EXCEPT {_SELECTED}",
    "op_reverse_subtract": f"{_BOTH} {_SELECTED} EXCEPT {_CURRENT}",
    "op_intersect": f"{_BOTH} {_CURRENT} INTERSECT {_SELECTED}",
    "op_count": f"{_BOTH} SELECT (SELECT count(*) FROM ({_SELECTED})) AS n_selected, (SELECT count(*) FROM ({_CURRENT})) AS n_current",
    "op_variables": f"{_BOTH} SELECT 'x' AS name, count(*) AS n FROM ({_CURRENT}) UNION ALL SELECT 'result', count(*) FROM ({_CURRENT} UNION {_SELECTED})",
    "load_links_phantoms": f"WITH {bridge.ctes('pagelink')} SELECT src AS from_id, CAST(dst AS VARCHAR) AS title, CASE WHEN dst_exists THEN dst ELSE -3 END AS to_id FROM pagelink",
    "load_links_broken": f"WITH {bridge.ctes('pagelink')} SELECT 'warning' AS severity, 'backlinks' AS \"table\", CAST(dst AS VARCHAR) AS message FROM pagelink WHERE dst NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'notice', 'pagelinks', CAST(dst AS VARCHAR) FROM pagelink WHERE NOT dst_exists",
    "category_fixups": f"WITH {bridge.ctes('namedarticle')} SELECT category, count(*) AS members FROM namedarticle a WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_name = a.page AND 'N' || s_nationkey = a.category) GROUP BY category",
    "reverse_links": f"WITH {bridge.ctes('page', 'pagelink')} SELECT DISTINCT dst, src FROM pagelink WHERE src IN ({_CURRENT}) AND dst IN ({_CURRENT})",
    "wanted_articles": f"WITH {bridge.ctes('page', 'pagelink')} SELECT dst, count(DISTINCT src) AS wanted_by FROM pagelink WHERE NOT dst_exists AND src IN ({_CURRENT}) GROUP BY dst",
    "page_info": f"WITH {bridge.ctes('namedcat', 'namedarticle')} SELECT page, string_agg(DISTINCT title, '|' ORDER BY title) AS categories FROM namedarticle JOIN namedcat ON category = cat_id GROUP BY page",
    "category_info": f"WITH {bridge.ctes('namedcat', 'namedsub', 'namedarticle')} SELECT cat_id AS id, title, coalesce((SELECT string_agg(parent, '|' ORDER BY parent) FROM namedsub WHERE child = cat_id), '') AS supercategories, coalesce((SELECT string_agg(child, '|' ORDER BY child) FROM namedsub WHERE parent = cat_id), '') AS subcategories, (SELECT count(DISTINCT page) FROM namedarticle WHERE category = cat_id) AS pages FROM namedcat",
    "list_sorted_transformed": f"WITH {bridge.ctes('page')}, shown AS (SELECT page_id, CASE ns WHEN 0 THEN title WHEN 1 THEN 'Talk:' || title WHEN 2 THEN 'User:' || title ELSE 'User_talk:' || title END AS display FROM page), keyed AS (SELECT *, CASE WHEN regexp_extract(display, '[0-9]+$') <> '' THEN regexp_extract(display, '[0-9]+$') ELSE display END AS sort_key FROM shown) SELECT page_id, regexp_replace(display, '_([0-9]+)$', ' (\\1)') AS shown, sort_key, rank() OVER (PARTITION BY substr(sort_key, 1, 1) ORDER BY sort_key, display) AS place FROM keyed",
    "popular_pages": f"WITH {bridge.ctes('page', 'pageview')} SELECT p.title AS name, CAST(sum(views) AS BIGINT) AS views FROM page p JOIN pageview v ON v.title = CAST(page_id AS VARCHAR) WHERE project IN ('click', 'view') GROUP BY p.page_id, p.title ORDER BY views DESC, name LIMIT 50",
}
