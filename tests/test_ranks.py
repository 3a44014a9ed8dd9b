"""Ranks over all rows, and texts that hold passages, against plain Python."""

import random

from pyspark.sql import functions as F

from sojourn.operators import lookup, windows


def test_global_rank_over_sampled_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(50)]), rnd.choice(["a", "b", None]), i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "x int, s string, id int").repartition(5)
    got = windows.global_rank(df, [(F.col("x"), True), (F.col("s"), False), (F.col("id"), False)]).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or "", r[2]))
    assert sorted((r.id, r["rank"]) for r in got) == sorted((r[2], i + 1) for i, r in enumerate(order))
    assert windows.global_rank(df.limit(0), [(F.col("id"), False)]).collect() == []


def test_holding(spark):
    texts = ["one two three four five six", "x one two three four five six, seven", "none", "", None, "a b", "three  four five"]
    passages = ["two three four", "three four five six", "a b", "b", "one two three four five six", "e two th", "four\tfive"]
    a = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    b = spark.createDataFrame(list(enumerate(passages)), "j int, passage string")
    got = {(r.i, r.j) for r in lookup.holding(a, b, "text", "passage").select("i", "j").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if t is not None and p in t}


def test_combinations_by_place(spark):
    import itertools

    from sojourn.operators import groups

    rows = [(g, m) for g, n in ((1, 6), (2, 3), (3, 2), (4, 40)) for m in range(n)]
    got = groups.some_combinations(spark.createDataFrame(rows, "g int, m int"), "g", "m", 3, 500).collect()
    by = {g: [tuple(r.members) for r in got if r.g == g] for g in (1, 2, 3, 4)}
    assert sorted(by[1]) == list(itertools.combinations(range(6), 3)) and by[2] == [(0, 1, 2)] and by[3] == []
    assert len(set(by[4])) == 500 and set(by[4]) <= set(itertools.combinations(range(40), 3))
