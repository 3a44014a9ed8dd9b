import json

import pytest
from pyspark.sql import functions as F

from sojourn.functions import numeric, text
from sojourn.operators import aggregates as agg
from sojourn.operators import groups, leaderboard, lookup, personas, preferences, search, windows
from sojourn.sources import tables
from sojourn.streaming import resume

CASES = [
    ("accommodation_price", "Under $80", [70.0, 85.0], [], True), ("accommodation_price", "Over $80", [70.0], [], False), ("accommodation_price", "$80-$90", [100.0], [], False), ("accommodation_price", "$80-$90", [], [], True),
    ("accommodation_price", "odd", [1.0], [], True), ("restaurant_rating", "4", [4.0, 3.9], [], False), ("restaurant_rating", "0", [1.0], [], True), ("room_type", "Private room", [], ["private room", "Shared"], False),
    ("room_type", "any", [], ["x"], True), ("house_rules", "must allow pets;must forbid smoking", [], ["pets ok", "quiet"], True), ("house_rules", "must forbid pets", [], ["pets ok"], False), ("minimum_nights", "very flexible", [5.0, 4.0], [], True),
    ("minimum_nights", "somewhat flexible (max 2)", [5.0, 3.0], [], False), ("cuisine", "must: thai; banned: greek", [], ["Thai, French"], True), ("cuisine", "must: thai", [], ["Greek"], False), ("cuisine", "banned: greek", [], ["Greek"], False),
    ("ambiance", "fine-dining", [], ["Le French Place"], True), ("ambiance", "lively", [], ["Quiet"], False), ("proximity", "within 2 km", [1.9, 9.0], [], True), ("proximity", "within 2 km", [2.1], [], False),
    ("flight_price", "super saver", [250.0], [], False), ("flight_price", "economy standard", [250.0], [], True), ("flight_price", "business", [250.0], [], False), ("layovers", "direct_only", [], ["A-B", "A-B"], False),
    ("layovers", "one_stop", [], ["A-B", "A-B", "B-A"], True), ("baggage", "checked_bag", [100.0], [], False), ("baggage", "carry_on_only", [100.0], [], True), ("departure", "Morning (06:00-12:00)", [], ["06:10", "12:00"], False),
    ("arrival", "evening/night", [], ["18:00"], True), ("arrival", "evening", [], ["odd"], True), ("intercity_duration", "under 2 hours", [2.5], [], False), ("intercity_duration", "2-4 hours", [3.5], [], True),
    ("flight_duration", "300", [200.0, 101.0], [], False), ("flight_distance", "300", [200.0, 101.0], [], True), ("clustering", "clustered", [1.0, 1.05, 2.0, 2.05], [], True), ("clustering", "scattered", [1.0, 1.05, 2.0, 2.05], [], False),
    ("cuisine_diversity", "diverse", [], ["Thai, Greek", "French"], True), ("cuisine_diversity", "consistent", [], ["Thai, Greek"], False), ("price_consistency", "consistent", [10.0, 30.0], [], False), ("price_consistency", "high variation ok", [10.0, 30.0], [], True),
    ("dining_frequency", "2 meals/day", [3.0, 6.0], [], True), ("dining_frequency", "3 meals/day", [3.0, 6.0], [], False), ("maximum_occupancy", "3", [2.0], [], False), ("review_score", "4.5", [4.6], [], True), ("restaurant_price", "Under $20", [25.0], [], False), ("accommodation_rating", "3", [3.0], [], True),
]


def test_preferences(spark):
    rows = [(i, k, w, n, t) for i, (k, w, n, t, _) in enumerate(CASES)]
    got = {r.trip: r.ok for r in preferences.judged(spark.createDataFrame(rows, "trip int, kind string, wish string, numbers array<double>, texts array<string>")).collect()}
    assert [CASES[i][:4] for i, c in enumerate(CASES) if got[i] != c[4]] == []
    assert {c[0] for c in CASES} == set(preferences.CHECKS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    check = lambda c: one(spark, c)
    assert tuple(check(text.name_city(F.lit("Bar A, B, Peoria(Illinois)")))) == ("Bar A, B", "Peoria")
    assert tuple(check(text.name_city(F.lit("nothing")))) == ("-", "-")
    assert tuple(check(text.from_to(F.lit("from A City to B Town, 10:00")))) == ("A City", "B Town")
    assert check(text.ground_cost(text.distance_km(F.lit("1,234 km")), F.lit("self-driving"))) == 61
    assert check(text.literal_list(F.lit("['a', None, 'b']"))) == ["a", None, "b"]
    assert check(text.until_sentinel(F.array(*map(F.lit, ["\n", "a", "\n", "b", "S", "c"])), F.lit("S"))) == ["a", "\n", "b"]
    assert check(text.money(F.lit("say $ 1,200 or $5"))) == 1200


def test_numeric_functions(spark):
    assert one(spark, numeric.round_hundreds(F.lit(250.0))) == 200
    assert one(spark, numeric.party_units(F.lit(6), F.lit("Taxi"))) == 2
    assert one(spark, numeric.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 1.0


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "x int")
    assert agg.nearest_rank(df, [], "x", [0.5]).first().q50 == 3


def test_rules(spark):
    rows = [("g", "a", "<=", 5.0, None, None, 1), ("g", "a", "<=", 3.0, None, None, 1), ("g", "b", "==", 1.0, None, None, 3), ("g", "b", "==", 5.0, None, None, 1), ("g", "c", "in", None, ["x", "y"], None, 1), ("g", "c", "in", None, ["y"], None, 1),
            ("g", "d", "in", None, ["x"], None, 1), ("g", "d", "in", None, ["y"], None, 1), ("g", "e", "bool", None, None, True, 1), ("g", "f", "not_in", None, ["q"], None, 1)]
    df = spark.createDataFrame(rows, "group string, attr string, operator string, number double, items array<string>, flag boolean, priority int")
    got = {r.attr: r for r in agg.aggregate_rules(df).collect()}
    assert (got["a"].number, got["b"].number, got["c"]["items"], got["d"]["items"], got["d"].conflict, got["e"].flag, got["f"]["items"]) == (3.0, 2.0, ["y"], ["x", "y"], True, True, ["q"])


def test_mmr_as_step_by_step(spark):
    rows = [(1, i, float((i * 7) % 5), [float(i % 3), float(i % 5), 1.0]) for i in range(20)]
    got = personas.spread(spark.createDataFrame(rows, "g int, k int, s double, v array<double>"), "g", "k", "s", "v", 4).orderBy("place").collect()
    import numpy as np

    v = {k: np.array(x) / np.linalg.norm(x) for _, k, _, x in rows}
    left, chosen = sorted(rows, key=lambda r: (-r[2], r[1])), []
    while len(chosen) < 4:
        best = max(left, key=lambda r: (r[2] if not chosen else 0.6 * r[2] - 0.4 * max(v[r[1]] @ v[c] for c in chosen), 0))
        chosen.append(best[1])
        left.remove(best)
    assert [r.k for r in got] == chosen


def test_groups(spark):
    w = [(1, m, f, v, a) for m, f, v, a in [(1, "a.x", "1", 5), (2, "a.x", "2", 5), (1, "b.y", "1", 6), (2, "b.y", "2", 8), (3, "a.x", "1", 9), (3, "b.y", "1", 9), (4, "a.x", "2", 9), (4, "b.y", "1", 1)]]
    df = spark.createDataFrame(w, "g int, m int, field string, value string, alpha int")
    best = groups.best_combination(df, "g", "m", 2).first()
    assert best.members == [1, 2] and best.score == pytest.approx(2 + 4 + 0.5 * 1.224745, abs=1e-4)
    rounds = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "g int, m int, round int")
    assert groups.solvable_by_round(rounds, df, "g", "m").first().round == 2
    cons = spark.createDataFrame([(1, "price", "<=", 5.0, None), (2, "price", "<=", 50.0, None), (3, "odd", "<=", 5.0, None), (4, "kind", "in", None, "z"), (5, "price", "~", 20.0, None)], "id int, field string, op string, number double, item string")
    got = {r.id: r.errors for r in groups.validated(cons, spark.createDataFrame([("price", 10.0, 90.0)], "field string, lo double, hi double"), spark.createDataFrame([("kind", ["x"])], "field string, items array<string>")).collect()}
    assert got == {1: ["infeasible"], 2: [], 3: ["invalid field"], 4: ["invalid item"], 5: ["invalid op"]}


def test_itinerary_is_best_within_budget(spark):
    items = [(1, "hotel", 1, 50.0, 90), (1, "hotel", 2, 20.0, 30), (1, "meal", 3, 30.0, 60), (1, "meal", 4, 10.0, 25), (1, "meal", 5, 5.0, 1), (2, "hotel", 1, 50.0, 30), (2, "meal", 3, 30.0, 20), (3, "hotel", 1, 500.0, 1), (3, "meal", 1, 1.0, 1)]
    df = spark.createDataFrame(items, "trip int, kind string, item int, cost double, preference int")
    budgets = spark.createDataFrame([(1, 65.0), (2, 100.0), (3, 10.0)], "trip int, budget double")
    got = search.itinerary(df, budgets, {"hotel": 1, "meal": 1}).collect()
    assert sorted((r.trip, r.kind, r.item, r.status) for r in got if r.trip < 3) == [(1, "hotel", 1, "optimal"), (1, "meal", 4, "optimal"), (2, "hotel", 1, "optimal"), (2, "meal", 3, "optimal")]
    assert [r.status for r in got if r.trip == 3] == ["infeasible"]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a b", 3.0), (2, "c", 9.0)], "k int, name string, price double")
    assert [r.k for r in df.where(lookup.parse_predicate("price <= 5, name contains b")).collect()] == [1]
    with pytest.raises(ValueError):
        lookup.parse_predicate("nothing")
    assert lookup.profile_columns(["a", "b", "c"], deny=("b",)) == ["a", "c"]
    rounds = windows.rounds(df, [], ["k"], 1).orderBy("k").collect()
    assert [r.round for r in rounds] == [1, 2]


def test_leaderboard(spark, tmp_path):
    board = spark.createDataFrame([("a", 0.5, 1), ("b", None, 1)], "model string, score double, updated int")
    up = leaderboard.upsert(board, spark.createDataFrame([("a", 0.1, 1), ("c", 0.9, 2)], board.schema), ["model"], "updated")
    standing = leaderboard.standing(up, ["score"], "updated")
    assert [(r.model, r["rank"]) for r in standing.orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    shown = leaderboard.markdown(standing, ["model", "score"], "rank")
    (tmp_path / "b.md").write_text("# Board\n\n" + shown)
    assert [tuple(r) for r in leaderboard.parse_markdown(spark.read.text(str(tmp_path / "b.md")), ["model", "score"]).collect()] == [("c", "0.9"), ("a", "0.1"), ("b", "")]


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,price,city,note\nA,3,X,\nB,,X,n\nC,5,Y,n\n")
    path = str(tmp_path / "r.csv")
    assert [r.name for r in tables.complete_csv(spark, path, ["name", "price"]).collect()] == ["C"]
    assert [r.name for r in tables.projected_csv(spark, path, ["name", "price"]).orderBy("row_id").collect()] == ["A", "C"]
    assert tables.raw_csv(spark, path, {"name": "title"}).where("title = 'B'").count() == 1
    (tmp_path / "e.csv").write_text("when\n01-02-2024\n2024-01-01\n99-99-2024\n")
    assert [str(r.when) for r in tables.dated(tables.raw_csv(spark, str(tmp_path / "e.csv")), "when").collect()] == ["2024-02-01"]
    (tmp_path / "p.jsonl").write_text('{"id": "a", "v": 1}\n\nbroken\n{"id": "a", "v": 2}\n{"id": "b", "v": 3}\n')
    assert sorted((r.id, r.v) for r in tables.tolerant_json(spark, str(tmp_path / "p.jsonl"), "id string, v int", "id").collect()) == [("a", 2), ("b", 3)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        tables.strict_json(spark, str(tmp_path / "p.jsonl"), "id string, v int").collect()
    (tmp_path / "q.jsonl").write_text('{"query": "x", "level": "easy", "z": 1}\n{"level": "hard"}\n{"id": "k", "query": "y"}\n')
    got = tables.examples(spark, str(tmp_path / "q.jsonl"), "q", ["query", "level"]).collect()
    assert [(r.id, r.query, r.level, r.metadata) for r in got] == [("q_00000", "x", "easy", {"z": "1"}), ("k", "y", None, {})]
    (tmp_path / "c.tsv").write_text("Rome\tLazio\nOstia\tLazio\n")
    assert tables.fanned(tables.pairs(spark, str(tmp_path / "c.tsv")), "state", "city").first().citys == ["Ostia", "Rome"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text(json.dumps({"a": 1}, indent=1))
    assert [(r.a, r.file) for r in tables.documents(spark, str(tmp_path / "d"), "a int").collect()] == [(1, "1.json")]
    assert {r.table for r in tables.catalogue(spark, {"r": path, "gone": str(tmp_path / "no.csv")}).collect()} == {"r"}
    df = spark.createDataFrame([(2,), (1,)], "a int")
    assert [(r.document, r.body) for r in tables.numbered_documents(df, ["a"], "plan").orderBy("document").collect()] == [("plan_1.json", '{"a":1}'), ("plan_2.json", '{"a":2}')]
    tables.write_rows(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and tables.first_rows(df, ["a"], 1).first().a == 1


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, 1.0) for i in range(10)], "id int, k int, v double").withColumn("ts", F.timestamp_seconds(F.col("id") * 600))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = resume.append_log(stream, lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "log"), str(tmp_path / "ck"))
        q.awaitTermination()
    log = resume.committed(spark, str(tmp_path / "log"), "id long, k long, v double, ts timestamp, done boolean")
    assert log.count() == 10 and resume.not_done(df.unionByName(df.withColumn("id", F.lit(99)).limit(1)), log, "id").count() == 1
    q = resume.windowed(stream, "ts", ["k"], "v", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, resume.windowed(df, "ts", ["k"], "v", "1 hour").collect()))


def test_log_holds_each_batch_once(spark, tmp_path, monkeypatch):
    """A batch whose write succeeds but which fails before the checkpoint knows is written again; half-written batches don't count."""
    from pyspark.sql import DataFrameWriter

    schema, log = "id long", str(tmp_path / "log")
    spark.range(10).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write, fails = DataFrameWriter.parquet, [True]

    def fail_after(self, path, *rest, **more):
        write(self, path, *rest, **more)
        if "/log/" in path and fails:
            fails.clear()
            raise RuntimeError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", fail_after)
    with pytest.raises(Exception, match="lost"):
        resume.append_log(stream, lambda b: b, log, str(tmp_path / "ck")).awaitTermination()
    assert resume.committed(spark, log, schema).count() == 5
    for _ in range(2):
        resume.append_log(stream, lambda b: b, log, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in resume.committed(spark, log, schema).collect()) == list(range(10))
    spark.range(90, 95).write.parquet(f"{log}/batch=00000000000000000077")
    (tmp_path / "log/batch=00000000000000000077/_SUCCESS").unlink()
    assert resume.committed(spark, log, schema).count() == 10
    assert resume.resumed(spark.range(8, 12), log, schema, "id").count() == 2
    assert resume.committed(spark, str(tmp_path / "none"), schema).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_itinerary_misses_no_candidate(spark, seed):
    """Against all choices, with binding budgets and many items that are neither among the best nor among the cheapest."""
    import random
    from itertools import combinations, product

    rnd, quotas = random.Random(seed), {"hotel": 1, "meal": 2}
    items = [(trip, kind, i, float(rnd.randint(1, 60)), rnd.randint(0, 90)) for trip in (1, 2, 3) for kind, n in (("hotel", 60), ("meal", 40)) for i in range(n)]
    items += [(4, "hotel", i, 30.0 + i, 300 + 10 * i) for i in range(20)] + [(4, "hotel", 100 + i, 1.0 + i / 10, 2) for i in range(20)] + [(4, "hotel", 200, 20.0, 100), (4, "meal", 1, 2.0, 3), (4, "meal", 2, 2.0, 3), (5, "hotel", 1, 1.0, 1)]
    budgets = {1: 12.0, 2: 25.0, 3: 2.0, 4: 25.0, 5: 99.0}
    df = spark.createDataFrame(items, "trip int, kind string, item int, cost double, preference int")
    got = search.itinerary(df, spark.createDataFrame(list(budgets.items()), "trip int, budget double"), quotas).collect()
    for trip, budget in budgets.items():
        own = {k: [(i, c, 100 * p - 100 * c) for t, kind, i, c, p in items if (t, kind) == (trip, k)] for k in quotas}
        values = [h[2] + a[2] + b[2] for h, (a, b) in product(own["hotel"], combinations(own["meal"], 2)) if h[1] + a[1] + b[1] <= budget]
        rows = [r for r in got if r.trip == trip]
        assert {r.status for r in rows} == {"optimal" if values else "infeasible"}
        if values:
            picked = [next(x for x in own[r.kind] if x[0] == r.item) for r in rows]
            assert sorted(r.kind for r in rows) == ["hotel", "meal", "meal"] and len({(r.kind, r.item) for r in rows}) == 3
            assert sum(x[1] for x in picked) <= budget and sum(x[2] for x in picked) == max(values)


def test_spread_sees_beyond_ten_times_k(spark):
    rows = [(1, i, 1.0 - i / 1e4, [1.0, 0.0]) for i in range(80)] + [(1, 80, 0.99, [0.0, 1.0])]
    got = personas.spread(spark.createDataFrame(rows, "g int, k int, s double, v array<double>"), "g", "k", "s", "v", 2).orderBy("place").collect()
    assert [r.k for r in got] == [0, 80]


def test_conflicts_of_all_pairs_of_a_nation(spark, tmp_path):
    from sojourn.plans import catalog, catalog_more  # noqa: F401

    spark.createDataFrame([(1, k) for k in (3, 10, 200, 5000)] + [(2, 4)], "c_nationkey int, c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["persona_conflicts"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(3, 10), (3, 200), (3, 5000), (10, 200), (10, 5000), (200, 5000)}
