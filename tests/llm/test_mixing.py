import heapq
import random

import pytest
from pyspark.sql import functions as F

from sojourn.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int"


def filled(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing the excess again and again; sizes in the order of sources."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    rnd = random.Random(1)
    sources = {"b": 400, "a": 30, "é": 3, "z": 200, "c": 1, None: 50}
    rows = [(i, " \n".join(["w"] * rnd.choice([0, 1, 5, 80, 900])), s, 1) for i, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    rows += [(5, None, "b", 1), (5, None, "b", 1), (None, "one two", "b", 1), (7, "long " * 30_000, "b", 1)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), shard_docs=60).collect()
    assert len(out) == len(rows)
    order = sorted((s for s in sources if s is not None)) + [None]
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in order}
    want = filled(sizes)
    for s in order:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= 16 * 1.5
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), shard_docs=60).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken, r.copies))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a", 1)], SCHEMA)).collect()] == [0]


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_sainte_lague_is_highest_quotients(spark, seats):
    votes = [0, 1, 1, 5, 53, 53, 340, 1000, 12]
    heap = [(-v, i, 0) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    want = [0] * len(votes)
    for _ in range(seats):
        _, i, k = heapq.heappop(heap)
        want[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
    df = spark.createDataFrame(list(enumerate(votes)), "p int, v long").withColumn("g", F.lit(1)).withColumn("n", F.lit(seats))
    got = mixing.sainte_lague(df, ["g"], ["p"], "v", "n", "won").orderBy("p").collect()
    assert [r.won for r in got] == want
