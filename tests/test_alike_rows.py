"""Rows that are alike are scored, and combined, once."""

import random

from pyspark.sql import functions as F

from sojourn.operators import groups, lookup


def test_scored_pairs(spark):
    rnd, calls = random.Random(1), spark.sparkContext.accumulator(0)
    rows = [(rnd.choice("xxy"), k, rnd.choice([None, [1], [1, 2], [3]]), rnd.choice([None, 1])) for k in range(120)]
    df = spark.createDataFrame(rows, "g string, k int, v array<int>, n int").repartition(5)

    @F.udf("int")
    def size(v, w):
        calls.add(1)
        return len(v or []) * 10 + len(w or [])

    got = lookup.scored_pairs(df.where("k % 5 = 0"), df, "g", "k", ["v", "n"], lambda x, y: size(x["v"], y["v"])).collect()
    assert sorted(map(tuple, got)) == sorted((g, a, b, len(v or []) * 10 + len(w or [])) for g, a, v, _ in rows if a % 5 == 0 for h, b, w, _ in rows if g == h)
    assert calls.value <= 2 * 8 * 8 < len(got)


def test_combinations_of_alike_members(spark, monkeypatch):
    """Of 40 members with three sorts of wishes few sets are tried, and the best one has the smallest members."""
    sets, plain = [], groups.scores_of
    monkeypatch.setattr(groups, "scores_of", lambda s, *more: (sets.append(s.count()), plain(s, *more))[1])
    rows = [(1, m, f"c{i}.f{i}", (m * (i + 1)) % 3, 4 + m % 3 + i) for m in range(40) for i in range(2)]
    df = spark.createDataFrame(rows, "g int, m int, field string, value int, alpha int").repartition(4)
    whole = groups.best_combination(df, "g", "m", 3, most=10_000).collect()
    sets.clear()
    got = groups.best_combination(df, "g", "m", 3, most=6, exact=True).collect()
    assert [(r.g, r.members, round(r.score, 9)) for r in got] == [(r.g, r.members, round(r.score, 9)) for r in whole]
    assert max(sets) <= 10
