"""Line authorship: which revision each line of a page's last text comes from.

A page's history is folded in order as its rows stream by, so one page is in one task; its memory is its current lines
plus one copy of each distinct text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import html_escape, split_lines
from palimpsest.operators.diff import diff_values

#: Lines of an Arrow batch at least, but for the last.
BATCH = 20_000


def wrapped_lines(text: str, limit: int | None = None) -> list[str]:
    """Pieces that end after a line feed, or after the first white space once `limit` characters are reached."""
    if limit is None:
        *whole, last = text.split("\n")
        return [x + "\n" for x in whole] + ([last] if last else [])
    out, start = [], 0
    for i, c in enumerate(text):
        if c == "\n" or i - start >= limit and c.isspace():
            out.append(text[start : i + 1])
            start = i + 1
    return out + [text[start:]] if start < len(text) else out


def fold(texts: Iterable[str], wrap: int | None = None, index_first: bool = False) -> list[tuple[str, int]]:
    """(line, number of its revision from 0) of the last text.

    A text that equals an earlier one is a revert: the earlier lines come back with their own revisions. The first
    text is not looked up so unless index_first: a revert to it is credited to whoever reverts."""
    lines: list[tuple[str, int]] = []
    keys: list[str] = []
    seen: dict[str, tuple[list[tuple[str, int]], list[str]]] = {}
    for n, text in enumerate(texts):
        if text in seen:
            lines, keys = seen[text]
            continue
        new = wrapped_lines(text, wrap)
        new_keys = [x.strip() for x in new]
        # What begins and ends alike is no part of the diff.
        top, most = 0, min(len(keys), len(new_keys))
        while top < most and keys[top] == new_keys[top]:
            top += 1
        end_a, end_b = len(keys), len(new_keys)
        while end_a > top and end_b > top and keys[end_a - 1] == new_keys[end_b - 1]:
            end_a, end_b = end_a - 1, end_b - 1
        numbers: dict[str, int] = {}
        old, now = ([numbers.setdefault(x, len(numbers)) for x in xs] for xs in (keys[top:end_a], new_keys[top:end_b]))
        out, at = lines[:top], top
        for start_a, start_b, deleted, inserted in diff_values(old, now):
            out += lines[at : top + start_a]
            out += [(x, n) for x in new[top + start_b : top + start_b + inserted]]
            at = top + start_a + deleted
        lines, keys = out + lines[at:], new_keys
        if n or index_first:
            seen[text] = lines, keys
    return lines


def between(history: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Revisions from first to last, both included."""
    if first is not None:
        history = history.where(F.col("ts") >= first)
    return history if last is None else history.where(F.col("ts") <= last)


def blame(history: DataFrame, wrap: int | None = None, index_first: bool = False) -> DataFrame:
    """history: page_id, rev_seq, contributor, text. page_id, line_no, line, rev_no (from 1), rev_seq, contributor; also ts
    and minor of the revision where the history has them."""
    extra = [f for f in history.schema.fields if f.name in ("ts", "minor")]
    kinds = ", ".join(["page_id long, line_no int, line string, rev_no int, rev_seq long, contributor string", *(f"{f.name} {f.dataType.simpleString()}" for f in extra)])
    # The number puts a page's rows into one task, one after the other, without a shuffle where they are so already.
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(F.asc_nulls_last("rev_seq")))
    rows = history.select(F.col("page_id").cast("long").alias("page_id"), F.col("rev_seq").cast("long").alias("rev_seq"), F.col("contributor").cast("string").alias("contributor"), F.col("text").cast("string").alias("text"), *(f.name for f in extra))
    rows = rows.select("page_id", number.alias("rev_no"), F.coalesce("text", F.lit("")).alias("text"), "rev_seq", "contributor", *(f.name for f in extra))
    return rows.mapInArrow(lambda batches: _blamed(batches, wrap, index_first), kinds)


def _blamed(batches: Iterator[pa.RecordBatch], wrap: int | None, index_first: bool) -> Iterator[pa.RecordBatch]:
    """batches: page_id, rev_no, text, and the columns that lines take from their revisions; by page_id and rev_no."""
    names, kinds = ["page_id", "line_no", "line", "rev_no"], [pa.int64(), pa.int32(), pa.string(), pa.int32()]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            if len(names) == 4:
                names.extend(batch.schema.names[3:])
                kinds.extend(batch.schema.types[3:])
            # Times as numbers: they come back as they were in any time zone.
            yield from zip(*((c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist() for c in batch.columns), strict=True)

    def texts(page: Iterator[tuple], revisions: list[tuple]) -> Iterator[str]:
        for row in page:
            revisions.append(row[3:])
            if row[1] != len(revisions):
                raise AssertionError(f"revision {row[1]} of page {row[0]} comes in place {len(revisions)}")
            yield row[2]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = (pa.array(x, pa.int64()).cast(k) if pa.types.is_timestamp(k) else pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True))
        return pa.RecordBatch.from_arrays(list(columns), names=names)

    found: list[tuple] = []
    for page_id, page in groupby(rows(), key=lambda r: r[0]):
        revisions: list[tuple] = []
        for k, (line, n) in enumerate(fold(texts(page, revisions), wrap, index_first), 1):
            found.append((page_id, k, line, n + 1, *revisions[n]))
        if len(found) >= BATCH:
            yield batch(found)
            found = []
    if found:
        yield batch(found)


def first_page(history: DataFrame) -> DataFrame:
    """The revisions of the smallest page_id alone."""
    return history.join(history.agg(F.min("page_id").alias("page_id")), "page_id", "left_semi")


def named(lines: DataFrame, names: DataFrame) -> DataFrame:
    """lines with the names of their contributors; names: contributor, name."""
    known = names.select("contributor", "name")
    return lines.join(known, "contributor", "left").withColumn("contributor", F.coalesce("name", "contributor")).drop("name")


def contributors(lines: DataFrame) -> DataFrame:
    """page_id, contributor, lines, first_rev and last_rev (of its first and last line in the text), place (1 for most
    lines; ties by first_rev, then name); with ts in the lines also first_edit and last_edit, the times of the two."""
    times = [F.min_by("ts", "line_no").alias("first_edit"), F.max_by("ts", "line_no").alias("last_edit")] if "ts" in lines.columns else []
    found = lines.groupBy("page_id", "contributor").agg(F.count("*").alias("lines"), F.min_by("rev_seq", "line_no").alias("first_rev"), F.max_by("rev_seq", "line_no").alias("last_rev"), *times)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("lines"), "first_rev", "contributor"))
    return found.withColumn("place", place)


def reverts(history: DataFrame) -> DataFrame:
    """page_id, rev_seq, to_rev: revisions whose text equals an earlier one of the page; to_rev is the first with it."""
    rows = history.select("page_id", "rev_seq", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.length("text").alias("n")).alias("content"))
    first = F.min("rev_seq").over(Window.partitionBy("page_id", "content"))
    return rows.select("page_id", "rev_seq", first.alias("to_rev")).where("rev_seq > to_rev")


def blame_text(lines: DataFrame) -> DataFrame:
    """value: one printable row per line: number, time and minor mark of its revision (the place in the history where no
    times are known), contributor, the line trimmed."""
    if "ts" in lines.columns:
        minor = F.when(F.col("minor"), "m").otherwise(" ") if "minor" in lines.columns else F.lit(" ")
        time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return lines.select(F.format_string("%8d\t  %-20s\t%s %-30s\t%s", "rev_no", time, minor, "contributor", F.regexp_replace("line", r"^\s+|\s+$", "")).alias("value"))
    return lines.select(F.format_string("%8d\t%-20s\t%-30s\t%s", "rev_no", F.col("rev_seq").cast("string"), "contributor", F.regexp_replace("line", "\n$", "")).alias("value"))


def blame_html(lines: DataFrame, page_id: int) -> str:
    """The lines of one page as HTML, with a legend of its contributors; a span for each run of lines of one revision."""
    own = lines.where(F.col("page_id") == page_id)
    legend = contributors(own).select("place", html_escape(F.col("contributor")).alias("name"), "lines").orderBy("place").collect()
    place = {r["name"]: r["place"] for r in legend}
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss") if "ts" in lines.columns else F.lit(None).cast("string")
    rows = own.select("line_no", "rev_no", html_escape(F.col("contributor")).alias("name"), html_escape(F.col("line")).alias("line"), when.alias("ts")).orderBy("line_no").collect()
    body = []
    for (number, name, ts), run in groupby(rows, key=lambda r: (r["rev_no"], r["name"], r["ts"])):
        title = " ".join(x for x in (str(number), ts) if x)
        body.append(f'<span class="u{place[name]}" title="{title}">{"".join(r["line"] for r in run)}</span>')
    items = "".join(f'<li class="u{r["place"]}">{r["name"]}: {r["lines"]}</li>' for r in legend)
    return f"<html><body><ul>{items}</ul><pre>{''.join(body)}</pre></body></html>"


def last_text_lines(history: DataFrame) -> DataFrame:
    """page_id, line_no, line of the last revisions, natively."""
    last = history.groupBy("page_id").agg(F.max_by("text", "rev_seq").alias("text"))
    return last.select("page_id", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
