"""Operators that split hot groups, against plain versions, with groups dealt over many parts."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sojourn.operators import aggregates, greedy, groups, lookup, personas, retrieval, windows


def test_containing_by_grams(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abAé% ") for _ in range(n))
    texts = [(i, rnd.choice(["hot", "hot", "hot", "cold"]), word(rnd.randint(0, 9))) for i in range(150)] + [(900, "hot", None), (901, None, "ab")]
    names = [(i, rnd.choice(["hot", "cold", "none"]), word(rnd.randint(0, 5))) for i in range(120)] + [(800, "hot", None), (801, None, "a"), (802, "hot", ""), (802, "hot", "")]
    left = spark.createDataFrame(names, "n int, city string, name string").repartition(3)
    right = spark.createDataFrame(texts, "t int, city string, text string").repartition(3)
    got = lookup.containing(left, right, ["city"], "text", "name")
    assert got.columns == ["city", "n", "name", "t", "text"]
    want = [(c, i, n, j, t) for i, c, n in names for j, d, t in texts if c is not None and c == d and n is not None and t is not None and n in t]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    other = lookup.containing(right, left, ["city"], "text", "name")
    assert other.columns == ["city", "t", "text", "n", "name"] and other.count() == len(want)


def test_containing_sends_no_side_to_all_tasks(spark):
    """The runs of a small file's texts are many times the file, which planning doesn't see."""
    left, right = (spark.range(9).select("id", F.lit("c").alias("city"), F.col("id").cast("string").alias(c)) for c in ("name", "text"))
    plan = lookup.containing(left, right.withColumnRenamed("id", "t"), ["city"], "text", "name")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("tolerance", [0.0, 0.1, 3.0, 100.0])
def test_band(spark, tolerance):
    rnd = random.Random(2)
    rows = lambda n: [(i, rnd.choice("xxy"), rnd.choice([None, 0.1, 0.2, 0.3, -0.1, rnd.uniform(-20, 20), float(rnd.randint(-9, 9))])) for i in range(n)]
    a, b = rows(90), rows(80)
    got = lookup.within_band(spark.createDataFrame(a, "i int, g string, x double"), spark.createDataFrame(b, "j int, g string, y double"), ["g"], F.col("x"), F.col("y"), tolerance)
    want = [(g, i, x, j, y) for i, g, x in a for j, h, y in b if g == h and x is not None and y is not None and abs(x - y) <= tolerance]
    assert got.columns == ["g", "i", "x", "j", "y"] and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_pair(spark, seed):
    rnd, rows = random.Random(seed), []
    for g in range(6):
        n = [1, 2, 40, 300, 300, 120][g]
        spread = [1, 1, 1000, 1e-3, 5, 1e6][g]
        for i in range(n):
            rows.append((g, i, rnd.gauss(0, spread), rnd.choice([0.0, rnd.gauss(0, spread)])))
    rows += [(6, 1, 1.0, 1.0), (6, 2, 1.0, 1.0), (6, 3, 5.0, 5.0), (7, 1, None, 1.0), (7, 2, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double").repartition(5)
    for coordinates in (["x", "y"], ["x"]):
        got = {r.g: r.least for r in lookup.nearest_pair(df, "g", "k", coordinates, crowd=4, part_rows=50).collect()}
        for g in range(7):
            own = [(r[2:4] if len(coordinates) == 2 else r[2:3]) for r in rows if r[0] == g]
            want = min((sum((p - q) ** 2 for p, q in zip(a, b)) ** 0.5 for a, b in combinations(own, 2)), default=None)
            assert got[g] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-300)), (g, coordinates)


def plain_turns(rows, k, worth, apart, first=None):
    chosen, left = [], list(rows)
    while left and len(chosen) < k:
        if not chosen and first is not None:
            best = next(r for r in left if r[0] == first)
        else:
            best = min(left, key=lambda r: (-(worth(r[1], min(apart(r[2], c[2]) for c in chosen)) if chosen else r[1]), r[0]))
        chosen.append(best)
        left.remove(best)
    return [r[0] for r in chosen]


@pytest.mark.parametrize("led", [False, True])
def test_choices_in_turn_over_parts(spark, led):
    rnd = random.Random(3)
    pools = {g: [(k, round(rnd.random(), 2), [round(rnd.random(), 1), round(rnd.random(), 1)]) for k in range(n)] for g, n in enumerate([1, 3, 60, 400])}
    df = spark.createDataFrame([(g, *r) for g, rows in pools.items() for r in rows], "g int, k int, s double, v array<double>").repartition(7)
    firsts = {2: 17, 3: 301} if led else {}
    lead = spark.createDataFrame(list(firsts.items()), "g int, k int") if led else None
    distance = lambda a, b: F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])
    got = greedy.chosen_in_turn(df, "g", "k", "s", "v", 5, lambda s, x: 0.5 * s + 0.5 * x, distance, lead, part_rows=30, sent=2).orderBy("place").collect()
    for g, rows in pools.items():
        want = plain_turns(rows, 5, lambda s, x: 0.5 * s + 0.5 * x, lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]), firsts.get(g))
        assert [r.k for r in got if r.g == g] == want


@pytest.mark.parametrize("strategy", ["adaptive", "budget_war", "pace_war"])
def test_conflicting_groups(spark, strategy):
    rnd, trips = random.Random(4), [(1, 1, 2, 900.0, 4, 5, 2), (2, 2, 0, 200.0, 2, 3, 1), (3, 1, 1, 100.0, 1, 3, 1)]
    vector = lambda: [round(rnd.random(), 2) for _ in range(6)] + [float(rnd.random() < 0.3) for _ in range(16)]
    pool = [(t, i, vector(), rnd.choice([0, 1, 2, 3]), rnd.choice([0, 1, 2, None])) for t, n in ((1, 120), (2, 70)) for i in range(n)]
    p = spark.createDataFrame(pool, "trip int, key int, v array<double>, budget int, season int")
    t = spark.createDataFrame(trips, "trip int, trip_budget int, trip_season int, budget double, people int, days int, cities int")
    for prefilter in (0, -1, 12):
        got = retrieval.conflicting_groups(p, t, 4, 0.6, strategy, prefilter, part_rows=25).orderBy("place").collect()
        assert {r.trip for r in got} == {1, 2}
        fit = personas.relevance(F.col("v"), F.col("budget"), F.col("season"), F.col("trip_budget"), F.col("trip_season"), F.col("days") < 4, F.col("cities") > 1)
        loose = personas.relevance(F.col("v"), F.col("budget"), F.col("season"), F.col("trip_budget"), F.col("trip_season"), F.col("days") < 4, F.col("cities") > 1, strategy != "budget_war")
        w = personas.adaptive_weights(F.col("b"), F.col("people"), F.col("days")) if strategy == "adaptive" else personas.weights(strategy)
        rows = p.join(t.withColumnRenamed("budget", "b"), "trip").select("trip", "key", "v", fit.alias("fit"), loose.alias("loose"), w.alias("w")).collect()
        for trip in (1, 2):
            own = sorted((r for r in rows if r.trip == trip), key=lambda r: (-r.loose, r.key))[: {0: 40, -1: None, 12: 12}[prefilter]]
            names = [r.key for r in got if r.trip == trip]
            assert names[0] in [r.key for r in sorted(own, key=lambda r: (-r.fit, r.key))[:10]]
            pairs = spark.createDataFrame([(r.key, r.v, r.w) for r in own], "k int, v array<double>, w array<double>")
            far = {(r.a, r.b): r.c for r in pairs.alias("x").crossJoin(pairs.alias("y")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), personas.conflict(F.col("x.v"), F.col("y.v"), F.col("x.w")).alias("c")).collect()}
            assert names == plain_turns([(r.key, r.fit, r.key) for r in own], 4, lambda s, x: 0.6 * s + (1 - 0.6) * x, lambda a, b: far[a, b], names[0])


@pytest.mark.parametrize("seed", range(2))
def test_exact_best_combination(spark, seed):
    rnd, rows = random.Random(seed), []
    for g, n in ((1, 12), (2, 4), (3, 2), (4, 10)):
        for m in range(n):
            for f in range(6):
                if rnd.random() < 0.7:
                    rows.append((g, m, f"c{f % 3}.{f}", rnd.randint(0, 2), rnd.choice([3, 5, 6, 8, 8, 9 if g < 4 else 10])))
    df = spark.createDataFrame(rows, "g int, m int, field string, value int, alpha int").repartition(4)
    order = lambda rows: sorted((r.g, list(r.members), round(r.score, 9)) for r in rows)
    whole = order(groups.best_combination(df, "g", "m", 3, most=10_000).collect())
    assert order(groups.best_combination(df, "g", "m", 3, most=6, exact=True).collect()) == whole and len(whole) >= 2


def test_quantiles_of_one_large_group(spark):
    rnd = random.Random(5)
    values = {"hot": [rnd.choice([rnd.gauss(0, 1), rnd.gauss(1e6, 1), 7.0, 1e300, -1e-300]) for _ in range(4000)], "same": [3.0] * 50, "one": [1.5], "two": [1.0, 2.0]}
    rows = [(g, v) for g, own in values.items() for v in own] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    places = lambda n: {f"p{i}": F.floor(F.lit(p) * (n - 1)) for i, p in enumerate(shares)}
    got = {(r.g, r.name): r["at"] for r in aggregates.values_at(df, ["g"], "x", places, few=20, cuts=8, passes=6).collect()}
    assert got == {(g, f"p{i}"): sorted(own)[int(p * (len(own) - 1))] for g, own in values.items() for i, p in enumerate(shares)}
    near = aggregates.nearest_rank(df, [], "x", [0.5]).first()
    every = sorted(v for own in values.values() for v in own)
    assert near.n == len(every) and near.q50 == every[round(0.5 * (len(every) - 1))] and near.least == every[0]
    linear = {r.g: r.q25 for r in aggregates.quantiles(df.where("g <> 'hot'"), ["g"], "x", [0.25]).collect()}
    assert linear == {"same": 3.0, "one": 1.5, "two": 1.25}


def test_ranks_in_ranges_by_size(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, 1, 2, 3, 4, 4, 4]), rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, a int, b double").repartition(9)
    got = {r.i: r.place for r in windows.global_rank(df, [(F.col("a"), True), (F.col("b"), False), (F.col("i"), False)], "place", range_rows=50, ranges=2).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert got == {r[0]: n for n, r in enumerate(want, 1)}
    assert windows.global_rank(df.limit(0), [(F.col("a"), False)], "place").collect() == []
