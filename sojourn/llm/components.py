"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """Of rows (u, v): link every v, and u itself, with the least of u and its vs. The least is found with a map-side combine and
    joined back, so a node with very many neighbours is no group in one task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return pairs.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    s = _star(down)
    return s.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(s.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each linked node and the least node that it reaches. Nodes are longs; links may repeat or be loops, and links
    with a null are none. Each round is written to the shared folder; rounds go on until every node hangs on its root alone."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    while True:
        now = materialize(small_star(large_star(now).distinct()).distinct(), "links")
        if _is_forest_of_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
