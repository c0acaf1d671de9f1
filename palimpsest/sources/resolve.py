"""Where an input is and what it holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.storage import shared_dir
from palimpsest.sources import jdbc, sevenzip, sqldump, xmldump

# Endings that are tried in turn.
ENDINGS = ("", ".sql.gz", ".sql", ".gz", ".xml", ".xml.7z")


# First bytes by kind.
def kind_of(head: bytes) -> str | None:
    """gzip, 7z, sql, xml, text or None, from the first bytes."""
    for mark, kind in ((b"\x1f\x8b", "gzip"), (b"7z\xbc\xaf", "7z"), (b"--", "sql"), (b"<m", "xml")):
        if head.startswith(mark):
            return kind
    return "text" if head and all(b >= 32 or b in b"\t\r\n" for b in head) else None


def find(spark: SparkSession, base: str) -> str:
    """base with the first ending that exists, in any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for ending in ENDINGS:
        path = hadoop.Path(base + ending)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isFile():
            return base + ending
    raise FileNotFoundError(base)


def opened(spark: SparkSession, base: str) -> str:
    """The file of base as Spark can read it: an archive is unpacked once into the shared folder, by one task."""
    path = find(spark, base)
    if not path.endswith(".7z"):
        return path
    out = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    sevenzip.read_7z(spark, path).select(F.col("line").alias("value")).write.text(out)
    return out


def read_table(spark: SparkSession, location: str, **options) -> DataFrame:
    """A live table (database url), or values array<string> of a dump file."""
    return jdbc.read_table(spark, location) if jdbc.is_url(location) else sqldump.read_dump(spark, opened(spark, location), **options)


def read_history(spark: SparkSession, location: str) -> DataFrame:
    if jdbc.is_url(location):
        return jdbc.read_history(spark, location)
    path = opened(spark, location)
    return xmldump.read_history(spark, path, xmldump.read_namespaces(spark, path))
