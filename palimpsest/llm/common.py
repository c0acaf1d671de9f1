"""What the training-data operators share: table access, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a worker's memory at about 40 times this.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one in HOT of all rows, so at most HOT keys are; its rows are dealt to SALT tasks.
HOT, SALT = 500, 64


def skew_join(rows: DataFrame, side: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with side on key; rows of hot keys are dealt out by a hash of the column spread, and only the rows of
    side with these keys are copied. rows is read twice, so it is best a table."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("count") > max(total // HOT, 1000)).select(key).collect()]
    if not hot:
        return rows.join(side.hint("merge"), key, how)
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("salt_", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALT))).otherwise(0).cast("int"))
    copied = side.withColumn("salt_", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied.hint("merge"), [key, "salt_"], how).drop("salt_")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> pa.LargeStringArray:
    """The column as a large string array without nulls (null: empty)."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def text_buffer(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): bytes of row i are bytes[offsets[i]:offsets[i+1]]; offsets start at 0."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Slices of the batch whose texts have about limit bytes together; a longer text stands alone, whole."""
    texts = strings(batch.column(column))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end


def literal_table(spark: SparkSession, columns: tuple[str, ...], rows: tuple[tuple, ...]) -> DataFrame:
    """A small fixed table as literals of the plan."""
    structs = [F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, row, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
