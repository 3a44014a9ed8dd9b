"""Distances of vectors that share a key: every query with every row of its key, in blocks.

Rows of a key are dealt into parts, and these into blocks of vectors; queries go to each part of their key. A block of queries and one
of rows make a table of distances, coordinate by coordinate, so sums are added in the vectors' order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distances of all rows of one matrix from all of another, and where they hold even if lengths differ.
Distance = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Arrow batches to Python workers: a row holds two blocks.
BATCH_BYTES = 4 << 20


def weighted_l2(w: Callable[[int], float]) -> Distance:
    """Length of (a - b) * w; the weight of coordinate i is inside the square."""

    def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            out += ((a[:, i, None] - b[None, :, i]) * w(i)) ** 2
        return np.sqrt(out), np.zeros(out.shape, bool)

    return apart


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def cosine_distance(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 - cosine; 1 if either has no length."""
    n = np.sqrt(dots(a, a))[:, None] * np.sqrt(dots(b, b))[None, :]
    return np.where(n == 0, 1.0, 1 - dots(a[:, None], b[None]) / np.where(n == 0, 1.0, n)), n == 0


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros, and their lengths; -1 for null and those that hold a null."""
    flat, lengths = vectors.flatten(), vectors.value_lengths().fill_null(0).to_numpy()
    out, row = np.zeros((len(lengths), lengths.max(initial=0))), np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.cast(pa.float64()).fill_null(0.0).to_numpy()
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    known[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    return out, np.where(known, lengths, -1)


def key_distances(queries: DataFrame, rows: DataFrame, on: str, key: str, vector: str, distance: Distance, block: int = 512, part_rows: int = 4096) -> DataFrame:
    """a, b, distance: each query with each row of its key `on`; both sides carry on, key and vector. Null where a vector is null, holds a
    null, or the two differ in length (the distance may say otherwise)."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    rows, queries = (df.where(F.col(on).isNotNull()).select(on, F.col(key).alias("_k"), F.col(vector).alias("_v")) for df in (rows, queries))

    def blocks(df: DataFrame, by: list[str]) -> DataFrame:
        listed = df.groupBy(on, *by).agg(F.collect_list(F.struct("_k", "_v")).alias("_l"))
        return listed.select(on, *by, F.col("_l._k").alias("_keys"), F.col("_l._v").alias("_vectors"))

    sizes = rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).select(on, F.ceil(F.col("_n") / part_rows).alias("_parts"))
    most = sizes.agg(F.sum("_parts")).first()[0] or 1  # one number
    slot = lambda n: F.pmod(F.xxhash64("_k", F.lit(n)), F.lit(-(-part_rows // n)))
    dealt = rows.join(sizes, on).withColumn("_part", F.pmod(F.xxhash64("_k"), F.col("_parts"))).withColumn("_block", slot(block))
    counts = queries.groupBy(on).agg(F.count(F.lit(1)).alias("_m")).select(on, F.ceil(F.col("_m") / (block // 2)).alias("_blocks"))
    asked = blocks(queries.join(counts, on).withColumn("_query", F.pmod(F.xxhash64("_k"), F.col("_blocks"))), ["_query"])
    asked = asked.join(sizes, on).select(on, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.col("_keys").alias("_a"), F.col("_vectors").alias("_x"))
    tasks = min(max(32, most), 4096)
    met = asked.repartition(tasks, on, "_part").hint("merge").join(blocks(dealt, ["_part", "_block"]).repartition(tasks, on, "_part"), [on, "_part"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, b, y in zip(*(batch.column(i) for i in range(4))):
                (p, m), (q, n) = _matrix(x.values), _matrix(y.values)
                wide = max(p.shape[1], q.shape[1])
                p, q = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (p, q))
                found, sure = distance(p, q)
                known = (sure | (m[:, None] == n[None, :])) & (m[:, None] >= 0) & (n[None, :] >= 0)
                i, j = np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p))
                out = [a.values.take(pa.array(i)), b.values.take(pa.array(j)), pa.array(found.ravel(), mask=~known.ravel())]
                yield pa.RecordBatch.from_arrays(out, ["a", "b", "distance"])

    kind = dict(rows.dtypes)["_k"]
    return met.select("_a", "_x", F.col("_keys").alias("_b"), F.col("_vectors").alias("_y")).mapInArrow(measured, f"a {kind}, b {kind}, distance double")
