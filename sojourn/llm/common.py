"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: Arrow batches that carry texts or sets to Python workers: memory of a task doesn't depend on how long the rows are.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: What this process has written between steps: paths, and names of bucketed tables.
WRITTEN: list[tuple[str, str | None]] = []


def forget(spark: SparkSession) -> int:
    """Delete the tables between steps that this process wrote; call it when results that read them are written. How many went."""
    for path, name in WRITTEN:
        if name:
            spark.sql(f"drop table if exists {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    n = len(WRITTEN)
    WRITTEN.clear()
    return n


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    WRITTEN.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Write df to the shared folder in buckets of key and read it back: a grouping by key then needn't move it again."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    WRITTEN.append((f"{shared_dir(spark)}/{name}", name))
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text_or_empty(name))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 200, most: int = 32 << 20) -> DataFrame:
    """A broadcast hint only if the counted rows, of so many bytes each, are within `most` bytes; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def least_hashes(df: DataFrame, order: Column, count: int, most: int) -> DataFrame:
    """The `most` rows of df, which has `count` rows, that come first by `order`, an evenly spread hash; with the hash as `n`. What
    can't be among them is dropped where it lies, so the sort sees about twice as many rows, however many tasks there are."""
    limit = int(-(2**63) + 2**64 * min(1.0, (2 * most + 100) / max(count, 1))) - 1
    return df.withColumn("n", order).where(F.col("n") <= F.lit(max(limit, -(2**63)))).orderBy("n").limit(most)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and where each row starts (one more than rows). Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Rows in runs of at most `most` bytes, one row at least."""
    out, i, n = [], 0, len(starts) - 1
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out
