"""Page titles and namespaces as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Built-in namespaces.
NAMESPACES = {
    -2: "Media",
    -1: "Special",
    0: "Main",
    1: "Talk",
    2: "User",
    3: "User_talk",
    4: "Project",
    5: "Project_talk",
    6: "Image",
    7: "Image_talk",
    8: "MediaWiki",
    9: "MediaWiki_talk",
    10: "Template",
    11: "Template_talk",
    12: "Help",
    13: "Help_talk",
    14: "Category",
    15: "Category_talk",
    100: "Portal",
    101: "Portal_talk",
}
MAIN, TEMPLATE, CATEGORY = 0, 10, 14


def _lookup(names: dict[int, str]) -> Column:
    return F.create_map(*(x for i, n in names.items() for x in (F.lit(n.lower()), F.lit(i))))


def _integer(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("int"))


def _pair(ns: Column, title: Column) -> Column:
    return F.struct(ns.cast("int").alias("ns"), title.alias("title"))


def parse_title(full: Column, site: dict[int, str] | None = None) -> Column:
    """struct<ns, title>: one leading colon goes; a prefix counts if it is a site name, an integer or a built-in name.
    An integer that is no namespace of the site means Main, and its prefix is dropped from the title (as is)."""
    full = F.when(full.startswith(":"), F.substr(full, F.lit(2))).otherwise(full)
    colon = F.instr(full, ":")
    prefix, rest = F.substring_index(full, ":", 1), F.substr(full, colon + 1)
    number = _integer(prefix)
    if site is not None:
        number = F.when(number.isNotNull(), F.when(number.isin(*site), number).otherwise(MAIN))
    named = F.element_at(_lookup(NAMESPACES), F.lower(prefix))
    if site:
        named = F.coalesce(F.element_at(_lookup(site), F.lower(prefix)), named)
    ns = F.coalesce(number, named)
    return (
        F.when(colon == 0, _pair(F.lit(MAIN), full))
        .when(colon == 1, _pair(F.lit(MAIN), rest))
        .when(ns.isNull(), _pair(F.lit(MAIN), full))
        .otherwise(_pair(ns, rest))
    )


def parse_engine_title(full: Column) -> Column:
    """The query language's own variant: a leading colon means Main and ends parsing, site names are not known, blanks
    in a prefix stand for underscores. Null where the title is invalid (empty, or nothing after a namespace)."""
    colon = F.instr(full, ":")
    prefix, rest = F.substring_index(full, ":", 1), F.substr(full, colon + 1)
    ns = F.coalesce(_integer(prefix), F.element_at(_lookup(NAMESPACES), F.lower(F.replace(prefix, F.lit(" "), F.lit("_")))))
    return (
        F.when(full == "", None)
        .when(colon == 0, _pair(F.lit(MAIN), full))
        .when(colon == 1, _pair(F.lit(MAIN), rest))
        .when(ns.isNull(), _pair(F.lit(MAIN), full))
        .when(rest != "", _pair(ns, rest))
    )


def namespace_name(ns: Column) -> Column:
    """The built-in name, or the number."""
    return F.coalesce(F.element_at(F.create_map(*(x for i, n in NAMESPACES.items() for x in (F.lit(i), F.lit(n)))), ns.cast("int")), ns.cast("string"))


def display_title(ns: Column, title: Column) -> Column:
    return F.when(ns == MAIN, title).otherwise(F.concat(namespace_name(ns), F.lit(":"), title))


def normalise_name(name: Column) -> Column:
    """Blanks become underscores, the first character upper case."""
    name = F.replace(name, F.lit(" "), F.lit("_"))
    return F.concat(F.upper(F.substr(name, F.lit(1), F.lit(1))), F.substr(name, F.lit(2)))


def url_title(encoded: Column) -> Column:
    """Percent-decoding that leaves + alone, then an upper-case first character."""
    plain = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return F.concat(F.upper(F.substr(plain, F.lit(1), F.lit(1))), F.substr(plain, F.lit(2)))
