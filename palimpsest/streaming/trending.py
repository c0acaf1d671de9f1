"""Streaming: daily page views, kept up to date as count files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "project string, title string, ts timestamp, views long"
STATE = "title string, day date, views long"
EVERY = 16


def read_views(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """title, day, views; rows that come later than `late` after the newest do not count."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "title").agg(F.sum("views").alias("views")).select("title", F.to_date("w.start").alias("day"), "views")


def maintain(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes what changed under table/batch=<n>; the row of the highest batch per title and day holds. After every EVERY
    batches the whole state goes to table/upto=<n>, and what the state before that one holds is deleted, so a reader finds
    at most twice EVERY batches. Batches and states are rewritten whole if repeated, so a restart changes nothing."""

    def upsert(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")
        if batch % EVERY == EVERY - 1:
            current(spark, table, batch).write.mode("overwrite").parquet(f"{table}/upto={batch}")
            before = max((n for n in _written(spark, table, "upto") if n < batch), default=-1)
            _delete(spark, [f"{table}/batch={n}" for n in _written(spark, table, "batch") if n <= before])
            _delete(spark, [f"{table}/upto={n}" for n in _written(spark, table, "upto") if n < before])

    return daily(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """title, day, views of the newest batch of each; with before, from the newest whole state of an earlier batch."""
    base = max((n for n in _written(spark, table, "upto") if before is None or n < before), default=-1)
    paths = [(base, f"{table}/upto={base}")] if base >= 0 else []
    paths += [(n, f"{table}/batch={n}") for n in _written(spark, table, "batch") if n > base]
    rows = spark.createDataFrame([], f"{STATE}, batch long")
    for n, path in paths:
        rows = rows.unionByName(spark.read.schema(STATE).parquet(path).withColumn("batch", F.lit(n).cast("long")))
    return rows.groupBy("title", "day").agg(F.max_by("views", "batch").alias("views"))


def _written(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind (batch or upto)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{table}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
