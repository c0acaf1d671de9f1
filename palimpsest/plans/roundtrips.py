"""Queries: sources, loaders and sinks, over files that are written from the test tables and read again."""

from __future__ import annotations

import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import blame, links, trending
from palimpsest.plans import bridge
from palimpsest.plans.storage import shared_dir
from palimpsest.sinks import files
from palimpsest.sources import jdbc, plain, resolve, sevenzip, sqldump, xmldump


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/palimpsest-files-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, raw: bytes) -> str:
    """One small file in any file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(raw))
    out.close()
    return path


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _dump(rows: DataFrame, values: list[Column], key: str, path: str) -> str:
    """INSERT statements of about 50 rows each, gzipped."""
    row = F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")"))
    statements = rows.select((F.col(key) % 200).alias("k"), row.alias("row")).groupBy("k").agg(F.concat_ws(",", F.collect_list("row")).alias("rows"))
    statements.select(F.concat(F.lit("INSERT INTO `t` VALUES "), "rows", F.lit(";")).alias("value")).write.option("compression", "gzip").text(path)
    return path


_TITLE = "p_name || '''s \\ ),(x;_' || p_partkey"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table of the dump: 13 columns, titles with all that needs an escape."""
    p = _read(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit("'s \\ ),(x;_"), F.col("p_partkey").cast("string"))
    ns = F.col("p_size") % 16
    values = [F.col("p_partkey").cast("string"), ns.cast("string"), _quoted(title), F.lit("''"), (F.col("p_partkey") % 11 == 0).cast("int").cast("string"), *[F.lit("NULL")] * 3, *[F.lit("-1.5e3")] * 5]
    return links.load_pages(sqldump.read_dump(spark, _dump(p, values, "p_partkey", _place(spark))))


def load_pages_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.col("page_id").cast("long").alias("page_id"), F.col("ns").cast("long").alias("ns"), "title", "is_redirect")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for the link tables: customers, those of segment BUILDING as categories."""
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("page_id"), F.when(F.col("c_mktsegment") == "BUILDING", 14).otherwise(0).alias("ns"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("title"))


def _orders_dump(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Links from a customer (some of them missing) to another one, by orders."""
    o = _read(spark, sf_dir, "orders")
    source = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 9 == 0, 10_000_000).otherwise(0)).cast("string")
    target = _quoted(F.concat(F.lit("P"), (F.col("o_orderkey") * 7 % 1999).cast("string")))
    values = {
        "categorylinks": [source, target, *[F.lit("''")] * 5],
        "templatelinks": [source, F.lit("0"), target, F.lit("0")],
        "pagelinks": [source, F.lit("0"), target, F.lit("0")],
        "externallinks": [source, _quoted(F.concat(F.lit("http://h/?q='"), F.col("o_orderkey").cast("string"))), F.lit("'i'")],
    }[table]
    return links.load_links(sqldump.read_dump(spark, _dump(o, values, "o_orderkey", _place(spark))), table)


def _resolved(table: str, missing: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = links.resolve(_orders_dump(spark, sf_dir, table), _customers(spark, sf_dir), missing)
        return found.select(F.col("from_id").cast("long").alias("from_id"), "title", F.col("to_id").cast("long").alias("to_id"))

    return query


def load_external_links_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_dump(spark, sf_dir, "externallinks").select(F.col("from_id").cast("long").alias("from_id"), "url")


def load_category_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of each category come from categories and from articles."""
    pages = _customers(spark, sf_dir)
    sub, articles = links.split_members(links.resolve(_orders_dump(spark, sf_dir, "categorylinks"), pages, links.MISSING_CATEGORY), pages)
    both = sub.select("title", F.lit(1).alias("s"), F.lit(0).alias("a")).unionByName(articles.select("title", F.lit(0).alias("s"), F.lit(1).alias("a")))
    return both.groupBy("title").agg(F.sum("s").alias("subcategories"), F.sum("a").alias("articles"))


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of broken links, written and read as text."""
    broken = links.broken_sources(_orders_dump(spark, sf_dir, "pagelinks"), _customers(spark, sf_dir))
    path = _place(spark)
    files.write_diagnostics(links.diagnostics(pagelinks=(broken, "warning", "from_id")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _xml(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an XML history: a user is a talk page, an event a revision."""
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    e = _read(spark, sf_dir, "events")
    n = F.col("event_id")
    anonymous = n % 3 == 0
    who = F.when(n % 10 == 9, F.lit('<contributor deleted="deleted"/>')).otherwise(
        tag("contributor", F.when(anonymous, tag("ip", F.concat(F.lit("10.0.0."), (n % 5).cast("string")))).otherwise(F.concat(tag("username", _xml("event_type")), tag("id", (n % 7 + 1).cast("string")))))
    )
    stamp = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    minor = F.when(F.col("value") > 50, F.lit("<minor/>")).otherwise("")
    revision = tag("revision", F.concat(tag("id", n.cast("string")), tag("timestamp", stamp), minor, who, tag("comment", _xml("event_type")), tag("text", _xml(F.concat(F.lit("<a&b>"), F.coalesce("props", F.lit("")))))))
    pages = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), revision.alias("x")))).alias("r"))
    u = F.col("user_id").cast("string")
    page = tag("page", F.concat(tag("title", F.concat(F.lit("Talk:U"), u)), tag("ns", F.lit("9")), tag("id", u), F.when(F.col("user_id") % 4 == 0, F.lit('<redirect title="x"/>')).otherwise(""), F.array_join(F.transform("r", lambda r: r["x"]), "")))
    path = _place(spark)
    documents = pages.select((F.col("user_id") % 8).alias("k"), page.alias("page")).groupBy("k").agg(tag("mediawiki", F.array_join(F.collect_list("page"), "\n")).alias("value"))
    documents.write.partitionBy("k").text(path)  # one document a file
    return xmldump.read_history(spark, path)


def xml_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return h.select("page_id", F.col("ns").cast("long").alias("ns"), "title", "is_redirect", F.col("rev_id").cast("long").alias("rev_id"), "rev_seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "minor", "contributor", "comment", "text")


def xml_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces of a site, by nations."""
    n = _read(spark, sf_dir, "nation")
    one = F.concat(F.lit('<namespace key="'), F.col("n_nationkey").cast("string"), F.lit('">'), "n_name", F.lit("</namespace>"))
    path = _place(spark)
    head = "<siteinfo><sitename>W</sitename><base>b</base><dbname>d</dbname><generator>g</generator><case>c</case><namespaces>"
    n.agg(F.concat(F.lit(head), F.array_join(F.collect_list(one), ""), F.lit("</namespaces></siteinfo>")).alias("value")).write.text(path)
    names = xmldump.read_namespaces(spark, path)
    found = spark.createDataFrame(sorted(names.items()), "key long, name string")
    return found.crossJoin(F.broadcast(xmldump.read_site(spark, path).select("sitename", "dbname")))


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, revision and text tables as of a live database, joined to a history; every third text is deflated."""

    @F.pandas_udf("binary")
    def deflated(x: pd.Series) -> pd.Series:
        def one(t: str) -> bytes:
            c = zlib.compressobj(wbits=-15)
            return c.compress(t.encode()) + c.flush()

        return x.map(one)

    e = _read(spark, sf_dir, "events")
    u = F.col("user_id")
    page = e.select(u.cast("int").alias("page_id"), (u % 4).cast("int").alias("page_namespace"), F.concat(F.lit("U"), u.cast("string")).alias("page_title"), (u % 5 == 0).cast("int").alias("page_is_redirect")).distinct()
    n = F.col("event_id")
    revision = e.select(n.cast("int").alias("rev_id"), F.lit(None).cast("int").alias("rev_parent_id"), F.date_format("ts", "yyyyMMddHHmmss").alias("rev_timestamp"), (F.col("value") > 50).cast("int").alias("rev_minor_edit"), (n % 4).cast("int").alias("rev_user"), F.col("event_type").alias("rev_user_text"), F.when(n % 2 == 0, F.col("event_type")).alias("rev_comment"), u.cast("int").alias("rev_page"), n.cast("int").alias("rev_text_id"))
    content = F.coalesce("props", F.lit(""))
    text = e.select(n.cast("int").alias("old_id"), F.when(n % 3 == 0, deflated(content)).otherwise(content.cast("binary")).alias("old_text"), F.when(n % 3 == 0, "utf-8,gzip").otherwise("utf-8").alias("old_flags"))
    h = jdbc.join_history(page, revision, text, first="20240105000000")
    return h.select("page_id", F.col("ns").cast("long").alias("ns"), "title", "is_redirect", F.col("rev_id").cast("long").alias("rev_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "minor", "contributor", "comment", "text")


def space_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    o = _read(spark, sf_dir, "orders")
    o.select(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit(""), "o_orderstatus", F.translate("o_orderpriority", " ", "_")).alias("value")).write.text(path)
    return plain.read_fields(spark, path).select(F.col("fields")[0].cast("long").alias("o_orderkey"), F.size("fields").cast("long").alias("n"), F.array_join("fields", "|").alias("fields"))


def _view_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project title views bytes, by orders; a third of the titles are no pages."""
    o = _read(spark, sf_dir, "orders")
    return o.select(F.concat_ws(" ", F.lower("o_orderstatus"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")), (F.col("o_orderkey") % 100).cast("string"), F.lit("9")).alias("value"))


def page_view_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    _view_lines(spark, sf_dir).write.text(path)
    pages = _read(spark, sf_dir, "customer").where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("page_id"), F.lit(0).alias("ns"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("title"))
    known, unknown = plain.read_page_views(spark, path, ["o", "f"], pages)
    rows = known.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("title"), "views")
    return rows.unionByName(unknown.groupBy("title").agg(F.sum("views").alias("views")).select(F.lit(None).cast("long").alias("page_id"), "title", "views"))


def name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    _read(spark, sf_dir, "orders").select(F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")).alias("value")).unionByName(spark.range(3).selectExpr("'' as value")).write.text(path)
    return plain.read_names(spark, path)


def fixup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    s = _read(spark, sf_dir, "supplier")
    s.select(F.when(F.col("s_suppkey") % 5 == 0, F.lit("# a note")).otherwise(F.concat(F.lit("-cat|"), F.translate("s_name", "#", "_"), F.lit("|Category:N"), F.col("s_nationkey").cast("string"), F.lit(" # why"))).alias("value")).write.text(path)
    return plain.read_fixups(spark, path).select("page", F.rtrim("category").alias("category"))


def seven_zip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations, packed into an archive and read again."""
    names = sorted(r["n_name"] for r in _read(spark, sf_dir, "nation").collect())
    path = _put(spark, f"{_place(spark)}.7z", sevenzip.pack("\n".join(names).encode()))
    return sevenzip.read_7z(spark, path).select(F.col("line").alias("name"))


def resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is found by its ending, and what the first bytes say of each kind of file."""
    base = _place(spark)
    rows = ",".join(f"({r['r_regionkey']},'{r['r_name']}')" for r in _read(spark, sf_dir, "region").collect())
    raw = f"-- a dump\nINSERT INTO `t` VALUES {rows};\n".encode()
    _put(spark, f"{base}.sql", raw)
    kind = resolve.kind_of(raw[:8])
    values = resolve.read_table(spark, base)
    return values.select(F.col("values")[0].cast("long").alias("id"), F.col("values")[1].alias("name"), F.lit(kind).alias("kind"), F.substring_index(F.lit(resolve.find(spark, base)), ".", -1).alias("ending"))


def wanted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    files.write_wanted(links.red_links(bridge.page_links(spark, sf_dir), bridge.pages(spark, sf_dir)), path)
    return spark.read.option("sep", ";").schema("wanted_by long, dst long").csv(path)


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with known authors: each event puts a line of its own above those of the page."""
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("rev_seq"), F.col("event_type").alias("contributor"))
    line = F.concat(F.lit("event "), F.col("rev_seq").cast("string"), F.lit("\n"))
    above = Window.partitionBy("page_id").orderBy(F.asc_nulls_last("rev_seq")).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("text", F.array_join(F.reverse(F.collect_list(line).over(above)), ""))


def blame_known_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = blame.blame(_grown(spark, sf_dir))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", "\n", "").alias("line"), F.col("rev_no").cast("long").alias("rev_no"), "rev_seq", "contributor")


def blame_known_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blame.contributors(blame.blame(_grown(spark, sf_dir)))
    return found.select("page_id", "contributor", "lines", "first_rev", "last_rev", F.col("place").cast("long").alias("place"))


def blame_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blame as text, written and read: how many rows name each revision."""
    path = _place(spark)
    files.write_blame(blame.blame(_grown(spark, sf_dir)), path)
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return cells.select(F.trim(F.col("c")[1]).cast("long").alias("rev_seq"), F.trim(F.col("c")[2]).alias("contributor"), F.col("c")[3].alias("line"))


def page_count_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts with encoded titles, of one project."""
    o = _read(spark, sf_dir, "orders")
    lines = o.select(F.concat_ws(" ", F.lower("o_orderstatus"), F.concat(F.lit("p%20"), F.col("o_orderkey").cast("string")), (F.col("o_orderkey") % 100).cast("string")).alias("value"))
    return trending.page_counts(lines, "o").toDF("title", "views").select("title", F.col("views").cast("long").alias("views"))


QUERIES = {
    "load_pages_dump": load_pages_dump,
    "load_category_links_dump": _resolved("categorylinks", links.MISSING_CATEGORY),
    "load_template_links_dump": _resolved("templatelinks", links.MISSING_TEMPLATE),
    "load_page_links_dump": _resolved("pagelinks", links.MISSING_PAGE),
    "load_external_links_dump": load_external_links_dump,
    "load_category_members": load_category_members,
    "load_log": load_log,
    "xml_history": xml_history,
    "xml_site": xml_site,
    "table_history": table_history,
    "space_separated": space_separated,
    "page_view_folder": page_view_folder,
    "page_count_lines": page_count_lines,
    "name_list": name_list,
    "fixup_file": fixup_file,
    "seven_zip_lines": seven_zip_lines,
    "resolved_files": resolved_files,
    "wanted_file": wanted_file,
    "blame_known_authors": blame_known_authors,
    "blame_known_contributors": blame_known_contributors,
    "blame_file": blame_file,
}

_LINK = "SELECT DISTINCT o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 10000000 ELSE 0 END AS from_id, 'P' || (o_orderkey * 7 % 1999) AS title FROM orders"
_PAGE = "SELECT c_custkey AS page_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 14 ELSE 0 END AS ns, 'P' || c_custkey AS title FROM customer"


def _resolve_sql(ns: int, missing: int) -> str:
    return f"WITH l AS ({_LINK}), p AS ({_PAGE}) SELECT from_id, l.title, coalesce(t.page_id, {missing}) AS to_id FROM l JOIN p f ON f.page_id = from_id LEFT JOIN p t ON t.ns = {ns} AND t.title = l.title"


_WHO = "CASE WHEN event_id % 10 = 9 THEN 'ip:#deleted#' WHEN event_id % 3 = 0 THEN 'ip:10.0.0.' || (event_id % 5) ELSE 'id:' || (event_id % 7 + 1) END"
_GROWN = "SELECT user_id AS page_id, event_id AS rev_seq, event_type AS contributor, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS line_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rev_no FROM events"
ORACLE_SQL = {
    "load_pages_dump": f"SELECT p_partkey AS page_id, CAST(p_size % 16 AS BIGINT) AS ns, {_TITLE} AS title, CASE WHEN p_size % 16 = 14 THEN FALSE ELSE p_partkey % 11 = 0 END AS is_redirect FROM part",
    "load_category_links_dump": _resolve_sql(14, links.MISSING_CATEGORY),
    "load_template_links_dump": _resolve_sql(0, links.MISSING_TEMPLATE),
    "load_page_links_dump": _resolve_sql(0, links.MISSING_PAGE),
    "load_external_links_dump": "SELECT o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 10000000 ELSE 0 END AS from_id, 'http://h/?q=''' || o_orderkey AS url FROM orders",
    "load_category_members": f"WITH l AS ({_LINK}), p AS ({_PAGE}) SELECT l.title, CAST(count(*) FILTER (WHERE p.ns = 14) AS BIGINT) AS subcategories, CAST(count(*) FILTER (WHERE p.ns <> 14) AS BIGINT) AS articles FROM l JOIN p ON page_id = from_id GROUP BY l.title",
    "load_log": f"WITH l AS ({_LINK}), p AS ({_PAGE}) SELECT 'warning pagelinks ' || from_id AS line, count(*) AS n FROM l WHERE from_id NOT IN (SELECT page_id FROM p) GROUP BY 1",
    "xml_history": f"SELECT user_id AS page_id, CAST(1 AS BIGINT) AS ns, 'U' || user_id AS title, user_id % 4 = 0 AS is_redirect, event_id AS rev_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rev_seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value > 50 AS minor, {_WHO} AS contributor, event_type AS comment, '<a&b>' || coalesce(props, '') AS text FROM events",
    "xml_site": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, 'W' AS sitename, 'd' AS dbname FROM nation",
    "table_history": "SELECT user_id AS page_id, user_id % 4 AS ns, 'U' || user_id AS title, user_id % 5 = 0 AS is_redirect, event_id AS rev_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value > 50 AS minor, CASE WHEN event_id % 4 = 0 THEN 'ip:' || event_type ELSE 'id:' || (event_id % 4) END AS contributor, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS comment, coalesce(props, '') AS text FROM events WHERE ts >= TIMESTAMP '2024-01-05'",
    "space_separated": "SELECT o_orderkey, CAST(4 AS BIGINT) AS n, o_orderkey || '||' || o_orderstatus || '|' || replace(o_orderpriority, ' ', '_') AS fields FROM orders",
    "page_view_folder": "WITH v AS (SELECT o_custkey, CAST(sum(o_orderkey % 100) AS BIGINT) AS views FROM orders WHERE lower(o_orderstatus) IN ('o', 'f') GROUP BY 1), k AS (SELECT v.*, c_custkey IS NOT NULL AS known FROM v LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 < 2) SELECT CASE WHEN known THEN o_custkey END AS page_id, CASE WHEN NOT known THEN 'P' || o_custkey END AS title, views FROM k",
    "page_count_lines": "SELECT 'P ' || o_orderkey AS title, o_orderkey % 100 AS views FROM orders WHERE o_orderstatus = 'O'",
    "name_list": "SELECT DISTINCT trim(o_orderpriority) AS name FROM orders",
    "fixup_file": "SELECT replace(s_name, '#', '_') AS page, 'Category:N' || s_nationkey AS category FROM supplier WHERE s_suppkey % 5 <> 0",
    "seven_zip_lines": "SELECT n_name AS name FROM nation",
    "resolved_files": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'sql' AS kind, 'sql' AS ending FROM region",
    "wanted_file": f"WITH {bridge.ctes('page', 'pagelink')} SELECT dst, count(DISTINCT src) AS wanted_by FROM pagelink WHERE NOT dst_exists AND src IN (SELECT page_id FROM page WHERE ns = 0) GROUP BY dst",
    "blame_known_authors": f"SELECT page_id, line_no, 'event ' || rev_seq AS line, rev_no, rev_seq, contributor FROM ({_GROWN})",
    "blame_known_contributors": f"WITH g AS ({_GROWN}), c AS (SELECT page_id, contributor, count(*) AS lines, arg_min(rev_seq, line_no) AS first_rev, arg_max(rev_seq, line_no) AS last_rev FROM g GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lines DESC, first_rev, contributor) AS place FROM c",
    "blame_file": f"SELECT rev_seq, contributor, 'event ' || rev_seq AS line FROM ({_GROWN})",
}
