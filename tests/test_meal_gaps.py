"""Meals whose time can't be read: all fail a plan, or those that are asked for."""

import duckdb
from pyspark.sql import functions as F

from sojourn.operators import fine
from sojourn.plans import trips  # noqa: F401  registers the query
from sojourn.plans.catalog import QUERIES, SQL


def test_unread_times(spark):
    points = "Inn, stay from 08:00 to 08:30;Bar A, visit from nine to ten;Bar B, visit from 14:30 to 15:00"
    rows = [(1, "-", "Bar B, P", "Bar A, P"), (2, "Bar A, P", "Bar B, P", "-"), (3, "-", "Bar A, P", "-"), (4, "-", "Bar B, P", "-")]
    days = spark.createDataFrame([(p, 1, 1, *meals, points) for p, *meals in rows], "plan int, day int, days int, breakfast string, lunch string, dinner string, points string")
    ok = lambda **more: {r.plan: r.ok for r in fine.meal_gaps(days, **more).collect()}
    assert ok() == {1: False, 2: False, 3: False, 4: True}
    assert ok(read=["breakfast"]) == {1: True, 2: False, 3: True, 4: True}


def test_dinner_at_the_unread_point(spark, tmp_path):
    """Order 827701 has no breakfast, and its dinner's name stands in the point from nine to ten."""
    spark.range(1).select(F.lit(827701).cast("long").alias("o_orderkey"), F.lit(83870).cast("long").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    duckdb.sql(f"create or replace view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    assert [(r.plan, r.ok) for r in QUERIES["meal_gap_constraint"](spark, str(tmp_path)).collect()] == duckdb.sql(SQL["meal_gap_constraint"]).fetchall() == [(83870, True)]
