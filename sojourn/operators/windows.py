"""Ordered logic on slots, days and visits, each within a plan or user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions.binding import let
from sojourn.operators.steps import kept


def runs(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values: group, run, value, length."""
    w = Window.partitionBy(*group).orderBy(*order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*group, "run", value).agg(F.count(F.lit(1)).alias("length"))


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def first_repeat(df: DataFrame, group: list[str], order: list[str], value: str, label: Column) -> DataFrame:
    """For each group the label of the first row whose value an earlier row has; null if all differ."""
    again = F.row_number().over(Window.partitionBy(*group, value).orderBy(*order)) > 1
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    marked = df.withColumn("_again", again).withColumn("_place", place).withColumn("_label", label)
    return marked.groupBy(*group).agg(F.min_by(F.when(F.col("_again"), F.col("_label")), F.when(F.col("_again"), F.col("_place"))).alias("repeated"))


def sequence_ok(cities: Column) -> Column:
    """Whether a route is valid: three stops at least, no stop visited again but by the last entry alone, no stop between the ends of a
    single entry. Runs are found by folding; cities is the list of entries."""
    runs_ = F.aggregate(
        cities,
        F.expr("cast(array() as array<struct<city:string,n:int>>)"),
        lambda acc, c: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["city"] == c), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(c.alias("city"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(c.alias("city"), F.lit(1).alias("n"))))),
    )

    def valid(runs_: Column) -> Column:
        names = F.transform(runs_, lambda r: r["city"])
        inner = F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0)))
        ends_apart = F.size(F.array_intersect(inner, F.array(F.try_element_at(names, F.lit(1)), F.try_element_at(names, F.lit(-1))))) == 0
        distinct = F.size(F.array_distinct(inner)) == F.size(inner)
        middle = F.slice(runs_, F.lit(2), F.greatest(F.size(runs_) - 2, F.lit(0)))
        last = F.try_element_at(runs_, F.lit(-1))
        stays_again = (last["n"] > 1) & F.array_contains(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), last["city"])
        return distinct & ends_apart & ~F.coalesce(stays_again, F.lit(False)) & F.forall(middle, lambda r: r["n"] > 1)

    return F.when(F.size(cities) < 3, False).otherwise(let(runs_, valid))


def closed_loop(cities: Column) -> Column:
    return F.try_element_at(cities, F.lit(1)) == F.try_element_at(cities, F.lit(-1))


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null so far."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gaps(df: DataFrame, group: list[str], order: list[str], seconds: Column, name: str) -> DataFrame:
    """Time since the row before; null for the first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_s", seconds).withColumn(name, F.col("_s") - F.lag("_s").over(w)).drop("_s")


def stratified(df: DataFrame, strata: list[str], order: list[str], quota: int, total: int) -> DataFrame:
    """The first `quota` rows of each stratum, filled up in order to `total`. Strata are cut before the last, global step, which sees
    at most `total` rows of each."""
    inside = Window.partitionBy(*strata).orderBy(*order)
    cut = df.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= total)
    every = Window.partitionBy(F.lit(0)).orderBy((F.col("_n") > quota).cast("int"), *order)
    return cut.withColumn("_r", F.row_number().over(every)).where((F.col("_r") <= total) | (F.col("_n") <= quota)).drop("_n", "_r")


def modulo_pick(df: DataFrame, group: list[str], order: list[str], seed: int) -> DataFrame:
    """Row seed mod n of each group's n rows in full order."""
    w = Window.partitionBy(*group)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where(F.col("_i") == F.lit(seed) % F.col("_n")).drop("_i", "_n")


def rounds(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Batch number of each row, from 1."""
    return df.withColumn("round", F.ceil(F.row_number().over(Window.partitionBy(*group).orderBy(*order)) / size).cast("long"))


def first_round(df: DataFrame, group: list[str], ok: Column) -> DataFrame:
    """The first round whose rows so far satisfy an aggregate condition on the prefix: ok is over (group, round)."""
    return df.where(ok).groupBy(*group).agg(F.min("round").alias("round"))


def global_rank(df: DataFrame, keys: list[tuple[Column, bool]], name: str = "rank", range_rows: int = 1_000_000, ranges: int = 32) -> DataFrame:
    """Ordinals from 1 over all rows by keys (column, whether descending), nulls last: rows are dealt by Spark into ranges of some
    `range_rows` (or `ranges` of them, if that is more), written once, ranked within each, and moved by the sizes of the ranges before. Rows of
    equal keys share a range; keys should tell rows apart."""
    order = [k.desc_nulls_last() if down else k.asc_nulls_last() for k, down in keys]
    rows = kept(df, "rows")
    parts = max(ranges, -(-rows.count() // range_rows))
    dealt = kept(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, own).join(starts, "_part").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).select(*(c for c in df.columns if c != name), name)


def ranked(df: DataFrame, order: list, name: str, group: list[str]) -> DataFrame:
    """Ordinals from 1 within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
