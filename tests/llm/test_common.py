import os

import pyarrow as pa
from pyspark.sql import functions as F

from sojourn.llm import common


def test_least_hashes_are_those_of_a_full_sort(spark):
    df = spark.range(20_000).repartition(7)
    want = [r.id for r in df.orderBy(F.xxhash64("id")).limit(300).collect()]
    assert [r.id for r in common.least_hashes(df, F.xxhash64("id"), 20_000, 300).collect()] == want
    assert common.least_hashes(df, F.xxhash64("id"), 20_000, 30_000).count() == 20_000
    assert common.least_hashes(df.limit(0), F.xxhash64("id"), 0, 5).count() == 0


def test_tables_between_steps_can_be_deleted(spark):
    kept = common.WRITTEN[:]
    common.WRITTEN.clear()
    common.materialize(spark.range(5), "some")
    common.bucketed(spark.range(5), "other", "id")
    paths = [p.removeprefix("file:") for p, _ in common.WRITTEN]
    assert all(os.path.isdir(p) for p in paths)
    assert common.forget(spark) == 2 and not any(os.path.exists(p) for p in paths) and common.WRITTEN == []
    common.WRITTEN.extend(kept)


def test_batches_are_bounded_by_bytes(spark):
    common.bound_batches(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    sizes = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).coalesce(1).mapInArrow(run, "n long").collect()
    assert max(r.n for r in sizes) < 3 * common.BATCH_BYTES and len(sizes) > 5
