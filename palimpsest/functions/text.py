"""Text, date and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def parse_date_time(digits: Column) -> Column:
    """YYYYMMDD or YYYYMMDDHHMMSS; null for anything else."""
    full = F.when(F.length(digits) == 8, F.concat(digits, F.lit("000000"))).when(F.length(digits) == 14, digits)
    return F.when(full.rlike("^[0-9]{14}$"), F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")))


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def split_lines(text: Column) -> Column:
    """The lines of a text, each with its line feed; no empty last line."""
    return F.filter(F.split(text, "(?<=\n)"), lambda x: x != "")


def thousands(x: Column) -> Column:
    """Five decimals with thousands separators."""
    return F.format_number(x, 5)


def has_flag(flags: Column, flag: str) -> Column:
    return F.array_contains(F.split(flags, ","), flag)


def trending_score(earlier: Column, later: Column) -> Column:
    """abs(later - earlier) * ln((later + 1) / (earlier + 1))"""
    return F.abs(later - earlier) * F.ln((later + 1) / (earlier + 1))
