"""SQL table dumps: INSERT statements of several rows each, one statement per line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = set("0123456789.-+e")
# What a backslash sequence means to the database.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def split_insert(line: str, escape_mode: str = "literal", null_literal: str | None = None) -> list[list[str | None]]:
    """The rows of one INSERT statement. escape_mode literal: a backslash gives the character after it; mysql: its
    meaning. A column list before VALUES is skipped. Carriage returns are dropped."""
    line = line.replace("\r", "")
    at = line.find("VALUES")
    at = line.find("(", at if at >= 0 else 0)
    rows: list[list[str | None]] = []
    while 0 <= at < len(line):
        row, at = [], at + 1
        while True:
            while line[at] in " ,":
                at += 1
            if line[at] == ")":
                break
            if line[at] == "'":
                piece, at = [], at + 1
                while True:
                    start = at
                    while line[at] not in "'\\":
                        at += 1
                    piece.append(line[start:at])
                    if line[at] == "\\":
                        c = line[at + 1]
                        piece.append(_ESCAPES.get(c, c) if escape_mode == "mysql" else c)
                        at += 2
                    elif line[at + 1 : at + 2] == "'":
                        piece.append("'")
                        at += 2
                    else:
                        at += 1
                        break
                row.append("".join(piece))
            elif line.startswith("NULL", at):
                row.append(null_literal)
                at += 4
            else:
                start = at
                while line[at] in _NUMBER:
                    at += 1
                if at == start:
                    raise ValueError(f"unexpected character {line[at]!r} at {at}")
                row.append(line[start:at])
        rows.append(row)
        at = at + 2 if line[at + 1 : at + 2] == "," else -1
        while 0 <= at < len(line) and line[at] == " ":
            at += 1
    return rows


def read_dump(spark: SparkSession, path: str, escape_mode: str = "literal", null_literal: str | None = None) -> DataFrame:
    """values array<string>: all rows of all statements. Other lines do not count; plain or gzip files."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for line in f["value"]:
                yield pd.DataFrame({"values": split_insert(line, escape_mode, null_literal)})

    lines = spark.read.option("lineSep", "\n").text(path).where(F.col("value").startswith("INSERT INTO"))
    return lines.mapInPandas(run, "values array<string>")
