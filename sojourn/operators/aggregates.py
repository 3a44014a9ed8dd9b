"""Rates, profiles and rule aggregation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.operators.steps import kept


def unpivoted(df: DataFrame, keys: list[str], checks: list[str]) -> DataFrame:
    """keys, check, ok: one row per check, null where it doesn't apply."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in checks))).alias("_c")).select(*keys, "_c.check", "_c.ok")


def true_false(df: DataFrame, strata: list[str], checks: list[str]) -> DataFrame:
    """passed, failed and applicable rows of each check in each stratum; null counts as neither."""
    return unpivoted(df, strata, checks).groupBy(*strata, "check").agg(F.count_if(F.col("ok")).alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count("ok").alias("applicable"), F.count(F.lit(1)).alias("rows"))


def pass_rates(df: DataFrame, checks: list[str]) -> DataFrame:
    """micro: passed over applicable checks. macro: rows that pass all that apply. One row."""
    marks = [F.col(c) for c in checks]
    total = lambda f: sum((f(m) for m in marks), F.lit(0))
    passed, there = total(lambda m: F.coalesce(m.cast("int"), F.lit(0))), total(lambda m: m.isNotNull().cast("int"))
    every = F.lit(True)
    for m in marks:
        every &= F.coalesce(m, F.lit(True))
    return df.agg((F.sum(passed) / F.greatest(F.sum(there), F.lit(1))).alias("micro"), F.avg(every.cast("double")).alias("macro"), F.count(F.lit(1)).alias("rows"))


def gated_rates(plans: DataFrame, soft: list[str], hard: list[str], gate: list[str], delivered: str) -> DataFrame:
    """Delivery, micro and macro rates of soft and of hard checks, and the final pass rate. Hard checks count only where the gate's
    checks pass; soft ones only for delivered plans. Micro denominators count strata-free applicable checks of evaluated plans."""
    open_ = F.col(delivered)
    for g in gate:
        open_ &= F.coalesce(F.col(g), F.lit(False))
    rows = plans.select(F.col(delivered).alias("_d"), *(F.when(F.col(delivered), F.col(c)).alias(c) for c in soft), *(F.when(open_, F.col(c)).alias(c) for c in hard), open_.alias("_open"))

    def micro(names: list[str]) -> Column:
        good = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in names), F.lit(0))
        there = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
        return F.sum(good) / F.greatest(F.sum(there), F.lit(1))

    def every(names: list[str], on: str) -> Column:
        out = F.col(on)
        for c in names:
            out &= F.coalesce(F.col(c), F.lit(True))
        return out

    s, h = every(soft, "_d"), every(hard, "_open")
    return rows.agg(F.avg(F.col("_d").cast("double")).alias("delivery"), micro(soft).alias("soft_micro"), F.avg(s.cast("double")).alias("soft_macro"), micro(hard).alias("hard_micro"), F.avg(h.cast("double")).alias("hard_macro"), F.avg((s & h).cast("double")).alias("final"))


def fixed_denominator(df: DataFrame, split: Column, passed: Column, constants: dict[str, int]) -> DataFrame:
    """Rates over published sizes of splits instead of counted rows."""
    sizes = F.create_map(*(F.lit(x) for kv in constants.items() for x in kv))
    return df.groupBy(split.alias("split")).agg(F.count_if(passed).alias("passed")).withColumn("rate", F.col("passed") / F.coalesce(sizes[F.col("split")], F.col("passed")))


def budget_band(df: DataFrame, group: list[str], price: str, factor: float) -> DataFrame:
    """Least, most and mean price times a stay; NaN is no price."""
    p = F.when(~F.isnan(F.col(price)), F.col(price))
    return df.groupBy(*group).agg((F.min(p) * factor).alias("low"), (F.max(p) * factor).alias("high"), (F.avg(p) * factor).alias("mean"))


def covers(got: Column, wanted: Column) -> Column:
    """struct(ok, missing): whether all wanted values are there, and the first that isn't; nulls if nothing is wanted."""
    left = F.array_except(wanted, got)
    return F.when(F.size(wanted) > 0, F.struct((F.size(left) == 0).alias("ok"), F.get(left, F.lit(0)).alias("missing")))


def values_at(df: DataFrame, group: list[str], value: str, places: Callable[[Column], dict[str, Column]], few: int = 100_000, cuts: int = 256, passes: int = 8) -> DataFrame:
    """group, name, at: of each group the value at each place from 0 in ascending order; places(n) names them by the group's n rows.

    A pass cuts what is open of a group into `cuts` ranges of about as many rows, by a sketch that is merged over tasks; the range of
    the place and those beside it stay open, if an exact count of what lies below and within confirms that it is there. When what is
    open has at most `few` different values, or after so many passes, they are put in order by their counts. Nulls don't count; ties are exact."""
    rows = kept(df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v")), "values")
    kind = dict(rows.dtypes)["_v"]
    whole = rows.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("long").alias("p")) for k, p in places(F.col("_n")).items())))
    state = whole.select(*group, "_lo", "_hi", "_n", named.alias("_t")).select(*group, "_t.name", "_t.p", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_open"))
    state = kept(state, "places")
    open_rows = lambda s: rows.join(s, group).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    wide = (F.col("_open") > few) & (F.col("_lo") < F.col("_hi"))
    shares = F.array(*(F.lit(i / cuts) for i in range(cuts + 1)))
    for _ in range(passes):
        if state.where(wide).isEmpty():
            break
        sketch = open_rows(state.where(wide)).groupBy(*group, "name").agg(F.percentile_approx("_v", shares, F.lit(20 * cuts)).alias("_q"))
        at = F.floor((F.col("p") - F.col("_below")) * cuts / F.col("_open")).cast("int")
        pick = lambda i: F.get("_q", F.greatest(F.lit(0), F.least(F.lit(cuts), i)))
        asked = state.where(wide).join(sketch, [*group, "name"]).withColumn("_a", pick(at - 1).cast(kind)).withColumn("_z", pick(at + 2).cast(kind)).drop("_q")
        asked = kept(asked, "brackets")
        counts = open_rows(asked).groupBy(*group, "name").agg(F.count_if(F.col("_v") < F.col("_a")).alias("_under"), F.count_if(F.col("_v").between(F.col("_a"), F.col("_z"))).alias("_in"))
        inside = F.col("p").between(F.col("_below") + F.col("_under"), F.col("_below") + F.col("_under") + F.col("_in") - 1)
        moved = asked.join(counts, [*group, "name"]).select(*group, "name", "p", *(F.when(inside, a).otherwise(b).alias(c) for c, a, b in (("_lo", F.col("_a"), F.col("_lo")), ("_hi", F.col("_z"), F.col("_hi")), ("_below", F.col("_below") + F.col("_under"), F.col("_below")), ("_open", F.col("_in"), F.col("_open")))))
        state = kept(moved.unionByName(state.where(~wide)), "places")
    counts = open_rows(state).groupBy(*group, "name", "p", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*group, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("_to", upto).where((F.col("p") < F.col("_to")) & (F.col("p") >= F.col("_to") - F.col("_c"))).select(*group, "name", F.col("_v").alias("at"))


def _spread_out(found: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    return found.groupBy(*group).agg(*(F.max(F.when(F.col("name") == n, F.col("at"))).alias(n) for n in names))


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """Quantiles that are values: the one at place round(share * (n - 1)), half to even, in order; without group, one row."""
    if not group:
        return nearest_rank(df.withColumn("_all", F.lit(0)), ["_all"], value, shares).drop("_all")
    names = [f"q{int(p * 100)}" for p in shares]
    found = values_at(df, group, value, lambda n: {k: F.bround(F.lit(p) * (n - 1)) for k, p in zip(names, shares)})
    rest = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return rest.join(_spread_out(found, group, names), group).select(*group, "n", "mean", "least", "most", *names)


def variation(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Population deviation over the mean, in percent, and its class."""
    cv = F.stddev_pop(value) / F.avg(value) * 100
    return df.groupBy(*group).agg(cv.alias("cv")).withColumn("kind", F.when(F.col("cv") < 20, "consistent").when(F.col("cv") <= 40, "moderate").otherwise("varied"))


def diversity(df: DataFrame, group: list[str], items: Column) -> DataFrame:
    """Distinct over all items of lists."""
    return df.select(*group, F.explode(items).alias("_i")).groupBy(*group).agg((F.count_distinct("_i") / F.count("_i")).alias("ratio"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column).limit(n)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, least, most, mean, distinct, and a count of rows: all columns in one pass."""
    a = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg), ("rows", F.count))))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{n}").alias(n) for n in ("least", "most", "mean", "rows"))) for c in columns))).alias("p")).select("p.*")


def keyword_coverage(df: DataFrame, text: str, groups: dict[str, list[str]], group: list[str]) -> DataFrame:
    """Percent of texts that have one of each list's words, and a class: high from 50, medium from 20."""
    low = F.lower(F.col(text))
    hit = lambda words: reduce(lambda a, w: a | low.contains(w), words, F.lit(False))
    marks = df.select(*group, *(hit(w).alias(n) for n, w in groups.items()))
    out = unpivoted(marks, group, list(groups)).groupBy(*group, "check").agg((F.avg(F.col("ok").cast("double")) * 100).alias("percent"))
    return out.withColumn("level", F.when(F.col("percent") >= 50, "high").when(F.col("percent") >= 20, "medium").otherwise("low"))


def bands(df: DataFrame, group: list[str], value: str, limits: list[tuple[str, float, float]]) -> DataFrame:
    """Rows in each band; bands may overlap and are counted each on its own."""
    return df.groupBy(*group).agg(*(F.count_if((F.col(value) >= lo) & (F.col(value) < hi)).alias(n) for n, lo, hi in limits))


def weighted_mean(value: Column, weight: Column) -> Column:
    """The plain mean if there is no weight. An aggregate."""
    return F.coalesce(F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0)), F.avg(value))


def aggregate_rules(rules: DataFrame) -> DataFrame:
    """Rules (group, attr, operator, number, items, flag, priority) as one per group, attr and operator: the least of upper bounds, the
    most of lower ones, the weighted mean of equalities, the intersection of allowed lists or, if that is empty, their union with a
    conflict, the union of banned lists, the majority of flags."""
    both = F.aggregate(F.slice("_lists", F.lit(2), F.size("_lists")), F.get(F.col("_lists"), F.lit(0)), F.array_intersect)
    union = F.array_sort(F.array_distinct(F.flatten("_lists")))
    a = rules.groupBy("group", "attr", "operator").agg(F.min("number").alias("_min"), F.max("number").alias("_max"), weighted_mean(F.col("number"), F.col("priority")).alias("_mean"), F.collect_list("items").alias("_lists"), (F.count_if("flag") * 2 > F.count("flag")).alias("_major"))
    op = F.col("operator")
    a = a.withColumn("_both", F.array_sort(both))
    number = F.when(op == "<=", F.col("_min")).when(op == ">=", F.col("_max")).when(op == "==", F.col("_mean"))
    items = F.when(op == "in", F.when(F.size("_both") > 0, F.col("_both")).otherwise(union)).when(op == "not_in", union)
    return a.select("group", "attr", "operator", number.alias("number"), items.alias("items"), F.when(op == "bool", F.col("_major")).alias("flag"), ((op == "in") & (F.size("_both") == 0)).alias("conflict"))


def mean_without(value: Column, sentinel: float = -1) -> Column:
    """An aggregate."""
    return F.avg(F.when(value != sentinel, value))


def attempts(df: DataFrame, tries: str, first_ok: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(first_ok).cast("double")).alias("first_pass"), F.avg(tries).alias("mean_attempts"), F.avg(F.col(tries) - 1).alias("mean_retries"))


def repeated_lines(df: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """Lines of texts with counts, the earliest first."""
    lines = df.select(F.col(key).alias("_k"), F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line")).where(F.trim("line") != "")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("_k", "_p")).alias("_at")).orderBy("_at").limit(n).select("line", "rows")


def satisfaction(df: DataFrame, group: list[str], alpha: str, ok: str) -> DataFrame:
    """Satisfied share by importance."""
    return df.groupBy(*group).agg((F.sum(F.when(F.col(ok), F.col(alpha)).otherwise(0)) / F.nullif(F.sum(alpha), F.lit(0))).alias("satisfaction"))


def applicable(df: DataFrame, strata: list[str], checks: list[str]) -> DataFrame:
    """How often each check applies in a stratum, and its rows."""
    return df.groupBy(*strata).agg(*(F.count(c).alias(c) for c in checks), F.count(F.lit(1)).alias("rows"))


def delivery(days: DataFrame, plan: str, least: int = 0) -> DataFrame:
    """The share of plans with more than `least` days. One row."""
    return days.groupBy(plan).agg(F.count(F.lit(1)).alias("_n")).agg(F.avg((F.col("_n") > least).cast("double")).alias("delivery"))


def elsewhere(df: DataFrame, key: str, value: str, own: str, name: str) -> DataFrame:
    """How many different values a key has besides its own."""
    return df.where(F.col(value) != F.col(own)).groupBy(key).agg(F.count_distinct(value).alias(name))


def within_limits(df: DataFrame, key: str, value: str, least: float, most: float, mean: float) -> DataFrame:
    """Whether all of a key's values reach `least`, none passes `most`, and their mean is within `mean`."""
    return df.groupBy(key).agg((F.min(value) >= least).alias("floor_ok"), (F.max(value) <= most).alias("cap_ok"), (F.avg(value) <= mean).alias("mean_ok"))


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """Quantiles between values, by linear interpolation; without group, one row."""
    if not group:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, shares).drop("_all")
    names = [f"q{int(p * 100)}" for p in shares]
    places = lambda n: {f"{k}_{e}": f(F.lit(p) * (n - 1)) for k, p in zip(names, shares) for e, f in (("a", F.floor), ("b", F.ceil))}
    found = _spread_out(values_at(df, group, value, places), group, [f"{k}_{e}" for k in names for e in "ab"])
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    wide = found.join(sizes, group)
    part = lambda p: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
    return wide.select(*group, *((F.col(f"{k}_a") + part(p) * (F.col(f"{k}_b") - F.col(f"{k}_a"))).alias(k) for k, p in zip(names, shares)))


def ratios(df: DataFrame, group: list[str], conditions: dict[str, Column]) -> DataFrame:
    """The share of rows where each condition holds; rows where it is null don't count."""
    return df.groupBy(*group).agg(*(F.avg(c.cast("double")).alias(n) for n, c in conditions.items()))


def with_total(df: DataFrame, strata: list[str], rates: dict[str, Column]) -> DataFrame:
    """Rates of each stratum and, with nulls, of all rows."""
    return df.rollup(*strata).agg(*(F.avg(c.cast("double")).alias(n) for n, c in rates.items()), F.count(F.lit(1)).alias("rows"))


def stops(df: DataFrame, group: str, route: str) -> DataFrame:
    """How often a group's commonest route comes again."""
    return df.groupBy(group, route).agg(F.count(F.lit(1)).alias("_n")).groupBy(group).agg((F.max("_n") - 1).alias("stops"))
