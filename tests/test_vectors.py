"""Distances in blocks against the column expressions, and that pairs don't carry their vectors."""

import random

import pytest
from pyspark.sql import functions as F

from sojourn.functions import numeric
from sojourn.operators import vectors


@pytest.mark.parametrize("name", ["weighted_l2", "cosine_distance"])
def test_blocks_equal_expressions(spark, name):
    rnd = random.Random(3)
    own = lambda: [rnd.uniform(-1, 1) for _ in range(5)]
    rows = [(i, rnd.choice([0, 0, 0, 1, None]), own()) for i in range(60)] + [(90, 0, None), (91, 0, [1.0, None, 2.0, 0.0, 1.0]), (92, 0, [1.0, 2.0]), (93, 0, []), (94, 0, [0.0] * 5), (95, 1, own()), (95, 1, own())]
    df = spark.createDataFrame(rows, "k long, g int, v array<float>").repartition(3)
    queries = df.where("k % 3 = 0")
    distance = vectors.weighted_l2(lambda i: 1.0 + i % 3) if name == "weighted_l2" else vectors.cosine_distance
    got = vectors.key_distances(queries, df, "g", "k", "v", distance, block=4, part_rows=16)
    pairs = queries.select("g", F.col("k").alias("a"), F.col("v").alias("x")).join(df.select("g", F.col("k").alias("b"), F.col("v").alias("y")), "g")
    w = F.transform("x", lambda _, i: (1 + i % 3).cast("double"))
    plain = numeric.weighted_l2(F.col("x"), F.col("y"), w) if name == "weighted_l2" else numeric.cosine_distance(F.col("x"), F.col("y"))
    want = pairs.select("a", "b", plain.alias("distance"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, [1.0])], "k long, g int, v array<float>")
    assert vectors.key_distances(df.limit(0), df, "g", "k", "v", vectors.cosine_distance).count() == 0
    assert vectors.key_distances(df, df.limit(0), "g", "k", "v", vectors.cosine_distance).count() == 0


def test_pair_queries_have_no_pair_by_pair_expressions(spark):
    from sojourn.plans import catalog, catalog_more  # noqa: F401  registers the queries

    for name in ("weighted_l2", "cosine_pairs"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "MapInArrow" in plan
