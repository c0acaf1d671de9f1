"""Command line: user statistics, blame and an interactive session over dumps.

    python -m palimpsest.cli userstats --date0=20240131 [--botlist=F] [--pernamespace] [--repeatlimit=20] in out
    python -m palimpsest.cli blame [--from=D] [--to=D] [--wrap=N] [--format=TEXT|HTML] [--firstpage] in out
    python -m palimpsest.cli browse [--fixups=F] [--views=FOLDER] base
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.titles import CATEGORY, NAMESPACES
from palimpsest.operators import blame as b
from palimpsest.operators import links
from palimpsest.operators.selectors import WikiTables
from palimpsest.operators.userstats import user_edit_stats
from palimpsest.plans.session import WikiSession
from palimpsest.sinks import files
from palimpsest.sources import jdbc, plain, resolve, xmldump


def date(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y%m%d" if len(text) == 8 else "%Y%m%d%H%M%S")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    verbs = p.add_subparsers(dest="verb", required=True)
    u = verbs.add_parser("userstats")
    u.add_argument("--date0", type=date, required=True)
    u.add_argument("--botlist")
    u.add_argument("--pernamespace", action="store_true")
    u.add_argument("--repeatlimit", type=int, default=20)
    l = verbs.add_parser("blame")
    l.add_argument("--from", dest="first", type=date)
    l.add_argument("--to", dest="last", type=date)
    l.add_argument("--wrap", type=int)
    l.add_argument("--format", choices=("TEXT", "HTML"), default="TEXT")
    l.add_argument("--firstpage", action="store_true")
    for v in (u, l):
        v.add_argument("input")
        v.add_argument("output")
    s = verbs.add_parser("browse")
    s.add_argument("--fixups")
    s.add_argument("--views")
    s.add_argument("base")
    return p


def open_session(spark: SparkSession, base: str, fixups: str | None = None, views: str | None = None) -> WikiSession:
    """The tables <base>-page, <base>-categorylinks, ... as a session, each read once; missing targets can be selected."""
    raw = lambda t: resolve.read_table(spark, f"{base}-{t}")
    page = links.load_pages(raw("page")).persist()
    missing = {"categorylinks": links.MISSING_CATEGORY, "templatelinks": links.MISSING_TEMPLATE, "pagelinks": links.MISSING_PAGE}
    found = {t: links.resolve(links.load_links(raw(t), t), page, m).persist() for t, m in missing.items()}
    sub, articles = links.split_members(found["categorylinks"], page)
    names = page.where(F.col("ns") == CATEGORY).select(F.col("page_id").alias("from_id"), F.col("title").alias("name"))
    members = articles.select(F.col("title").alias("category"), F.col("from_id").alias("page"))
    if fixups:
        wanted = plain.read_fixups(spark, fixups).join(page.select(F.col("title").alias("page"), "page_id"), "page")
        members = links.apply_fixups(members, wanted.select(F.regexp_replace("category", "^Category:", "").alias("category"), F.col("page_id").alias("page")))[0]
    tables = WikiTables(
        page=page,
        category=page.where(F.col("ns") == CATEGORY).select(F.col("title").alias("cat_id"), "title"),
        subcat=sub.join(names, "from_id").select(F.col("title").alias("parent"), F.col("name").alias("child")),
        catarticle=members,
        templatelink=found["templatelinks"].select(F.col("from_id").alias("page_id"), F.col("ns").alias("template_ns"), F.col("title").alias("template")),
        pagelink=found["pagelinks"].select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("ns").alias("dst_ns"), F.col("title").alias("dst_title")),
        extlink=links.load_links(raw("externallinks"), "externallinks").select(F.col("from_id").alias("page_id"), "url").persist(),
    )
    return WikiSession(spark, tables, (lambda projects: plain.read_page_views(spark, views, projects, page)[0]) if views else None)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verb == "browse":
        session = open_session(spark, a.base, a.fixups, a.views)
        for line in sys.stdin:
            try:
                if (out := session.command(line.strip())) is None:
                    break
                print(out)
            except (ValueError, KeyError, IndexError, PySparkException) as e:
                print(f"error: {e}")
        return 0
    if jdbc.is_url(a.input):
        history, site = jdbc.read_history(spark, a.input), NAMESPACES
    else:
        path = resolve.opened(spark, a.input)
        site = xmldump.read_namespaces(spark, path)
        history = xmldump.read_history(spark, path, site)
    if a.verb == "userstats":
        bots = plain.read_names(spark, a.botlist) if a.botlist else None
        names = xmldump.display_names(history)
        if bots is not None:  # listed by name, known by key; registered users only
            bots = names.where("user_id is not null").join(bots, "name").select(F.col("contributor").alias("name"))
        stats = user_edit_stats(history, a.date0, bots=bots, namespaces=sorted(site), repeat_limit=a.repeatlimit, per_namespace=a.pernamespace)
        files.write_user_stats(stats, names, a.output)
        return 0
    inside = b.between(history, *(F.lit(d).cast("timestamp_ntz") if d else None for d in (a.first, a.last)))
    if a.firstpage:
        inside = b.first_page(inside)
    lines = b.named(b.blame(inside, wrap=a.wrap), xmldump.display_names(history))
    if a.format == "TEXT":
        files.write_blame(lines, a.output)
    elif first := inside.select(F.min("page_id")).first()[0]:
        files.write_blame_html(lines, first, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
