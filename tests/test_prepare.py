"""Records in preparation: notebooks, artefacts, resumed runs, nested rows, wishes that rule candidates out, and whole-group choices."""

import pytest
from pyspark.sql import functions as F

from sojourn.operators import fine, personas, prepare


def test_notebook(spark):
    book = prepare.Notebook(spark, "test_notes")
    assert book.write(spark.range(3), "three") == 0 and book.write(spark.range(5), "five") == 1
    book.update(0, spark.range(4), "four")
    assert book.list() == [{"index": 0, "note": "four"}, {"index": 1, "note": "five"}] and book.read(0).count() == 4
    book.reset()
    assert book.list() == []
    with pytest.raises(IndexError):
        book.read(0)


def test_artefacts_and_resumed_runs(spark, tmp_path):
    paths = prepare.write_artefacts({"rules": spark.range(2), "plan": spark.range(3)}, str(tmp_path / "out"))
    assert {k: spark.read.json(p).count() for k, p in paths.items()} == {"rules": 2, "plan": 3}
    prepare.check_resumable({"model": "a", "x": 1}, {"model": "a", "x": 2}, spark.range(3), spark.range(3), "id", ("model",))
    with pytest.raises(ValueError, match="model"):
        prepare.check_resumable({"model": "a"}, {"model": "b"}, spark.range(3), spark.range(3), "id", ("model",))
    with pytest.raises(ValueError, match="examples"):
        prepare.check_resumable({}, {}, spark.range(3), spark.range(4), "id", ())


def test_nested_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", 4)], "id int, org string, people_number int")
    (row,) = prepare.nth_row(df, [(F.col("id"), False)], 1, ["org", "people_number"], ["id"]).collect()
    assert row.meta.org == "b" and row.references.id == 2 and row.row.people_number == 3
    assert prepare.nth_row(df, [(F.col("id"), False)], 9, ["org"], ["id"]).collect() == []
    assert prepare.condensed(df, ["org", "people_number"], ["id"]).first().initial_info.org == "a"
    assert prepare.moved_after(df, ["people_number"], "none").columns == ["people_number", "id", "org"]


def test_wishes_rule_candidates_out(spark):
    found = spark.createDataFrame([(1, "outbound", "f", None), (1, "hotel", "h", "No pets"), (1, "hotel", "i", "Smoking allowed"), (1, "restaurant", "r", "Thai"), (2, "outbound", "f", None), (2, "restaurant", "r", "Thai")], "trip int, kind string, item string, category string")
    wishes = spark.createDataFrame([(1, ["Thai"], "smoking", "No Flights please")], "trip int, forbidden array<string>, house_rule string, ban string")
    assert sorted((r.trip, r.item) for r in prepare.allowed(found, wishes).collect()) == [(1, "i"), (2, "f"), (2, "r")]


def test_fine_lodgings_and_points(spark):
    home = "Inn, Old, Peoria(Illinois)"
    point = "Inn, Old, stay from 08:00 to 08:30;Bar, visit from 09:00 to 10:00;Inn, Old, stay from 20:00 to 21:00"
    rows = [(1, 1, 3, home, "-", "-", "Bar, Peoria", "-", "-", point), (1, 2, 3, "-", "-", "-", "-", "-", "-", point), (2, 1, 3, home, "Flight Number: F1, Departure Time: 05:00, Arrival Time: 07:45", "-", "-", "-", "-", point), (3, 1, 3, home, "-", "-", "-", "-", "Show, Peoria", point + ";Show")]
    days = spark.createDataFrame(rows, "plan int, day int, days int, accommodation string, transportation string, attraction string, breakfast string, dinner string, event string, points string").withColumn("lunch", F.lit("-"))
    got = {r.plan: (r.ok, r.reason) for r in fine.poi_sequence(days).collect()}
    assert got[1] == (True, None) and "flight" in got[2][1] and not got[3][0]
    names = {(r.plan, r.day): (r.home, r.before) for r in fine.lodgings_in_turn(days).collect()}
    assert names[1, 1] == ("Inn, Old", None) and names[1, 2] == ("Inn", "Inn, Old")


def test_orders_of_points(spark):
    rows = [(1, d, list(k)) for d, k in ((1, "xyz"), (2, "xzy"), (3, "xx"))]
    noted = spark.createDataFrame(rows, "plan int, day int, kinds array<string>")
    (same,) = fine.ordering_scores(noted, noted).collect()
    between = spark.range(1).select(fine.sequence_distance(F.array(*map(F.lit, "xyz")), F.array(*map(F.lit, "xzy"))).alias("d")).first().d
    assert between == 1.0 or between == 2.0
    assert same.score == pytest.approx(1 - 2 * between / 5 / 3)
    empty = F.array().cast("array<string>")
    ends = spark.range(1).select(fine.sequence_distance(empty, empty).alias("a"), fine.sequence_distance(empty, F.array(F.lit("x"))).alias("b")).first()
    assert ends.a == 0.0 and ends.b == float("inf")


def test_choices_over_whole_groups(spark):
    """Without a cut the passes choose as the grouped search does over all of a group."""
    rows = [(g, i, float((i * 7) % 11), [float((i * k) % 5) / 4 for k in range(1, 23)]) for g in range(2) for i in range(30)]
    pool = spark.createDataFrame(rows, "g int, k int, s double, v array<double>")
    one = sorted(map(tuple, personas.opponents(pool, "g", "k", "s", "v", [1.0] * 22, 4, candidates=0).collect()))
    assert one == sorted(map(tuple, personas.opponents(pool, "g", "k", "s", "v", [1.0] * 22, 4, candidates=30).collect())) and len(one) == 8
    two = sorted(map(tuple, personas.spread(pool, "g", "k", "s", "v", 4, candidates=0).collect()))
    assert two == sorted(map(tuple, personas.spread(pool, "g", "k", "s", "v", 4).collect()))
