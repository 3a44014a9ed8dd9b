"""Combinations are made from lists, by many tasks, however many members a group has."""

from itertools import combinations

from pyspark.sql import functions as F

from sojourn.operators import lookup


def test_combinations_of_a_group_are_shared_by_tasks(spark):
    members = spark.range(200, numPartitions=1).select(F.lit(1).alias("g"), (F.col("id") * 7 % 200).alias("k"))
    got = lookup.combinations(members, "g", "k", 3)
    m = F.col("members")
    tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if((m[0] < m[1]) & (m[1] < m[2])).alias("up")).collect()
    assert sum(t.n for t in tasks) == sum(t.up for t in tasks) == 200 * 199 * 198 // 6
    assert got.select(F.hash("members").alias("h")).distinct().count() > 1_300_000
    assert max(t.n for t in tasks) < 800_000


def test_combinations_of_few_members_and_of_few_lists(spark):
    rows = [(g, k) for g, n in ((1, 7), (2, 3), (3, 2)) for k in range(n)] + [(None, 1), (4, None)]
    members = spark.createDataFrame(rows, "g int, k int").repartition(3)
    for k in (1, 2, 3):
        want = sorted((g, c) for g, n in ((1, 7), (2, 3), (3, 2)) for c in combinations(range(n), k))
        for most in (1, 30, 32_768):
            got = lookup.combinations(members, "g", "k", k, most=most).where("g is not null").collect()
            assert sorted((r.g, tuple(r.members)) for r in got) == want
