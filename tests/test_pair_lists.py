"""Pairs are made from lists, by many tasks, however many rows are alike."""

from pyspark.sql import functions as F

from sojourn.operators import lookup


def test_scored_pairs_of_alike_rows_are_shared_by_tasks(spark):
    rows = spark.range(1500).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.lit(1).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("h", 1500, 2), (None, 1501, 1)], "g string, k long, v int")).repartition(4)
    got = lookup.scored_pairs(rows, rows, "g", "k", ["v"], lambda x, y: x["v"] * 10 + y["v"])
    tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count_if(F.col("b") > F.col("a")).alias("more"), F.countDistinct("a", "b").alias("d")).collect()
    assert (sum(t.n for t in tasks), sum(t.d for t in tasks), sum(t.s for t in tasks), sum(t.more for t in tasks)) == (1500 * 1500 + 1, 1500 * 1500 + 1, 1500 * 1500 * 11 + 22, 1500 * 1499 // 2)
    assert max(t.n for t in tasks) < 1_000_000


def test_every_part_is_compared_with_its_brand(spark, tmp_path):
    from sojourn.plans import catalog, catalog_more  # noqa: F401

    spark.createDataFrame([(k, "b", f"A {k % 2}") for k in (1, 2, 3)] + [(4, "c", "A")], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["jaccard_tokens"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b, r.j) for r in got} == {(1, 2, 0.333333), (2, 1, 0.333333), (1, 3, 1.0), (3, 1, 1.0), (2, 3, 0.333333), (3, 2, 0.333333)} and len(got) == 6


def test_every_customer_is_compared_with_its_nation(spark, tmp_path):
    from sojourn.plans import catalog, stored  # noqa: F401

    spark.createDataFrame([(1, 1), (2, 1), (13, 1), (4, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["vector_conflicts"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(1, 2), (2, 1), (1, 13), (13, 1), (2, 13), (13, 2)} and len(got) == 6
    assert {r.conflict for r in got if {r.a, r.b} == {1, 13}} == {0.0}
