"""What plans name is looked up once for each different name, however often plans and the sandbox repeat it."""

import datetime

import pytest
from pyspark.sql import functions as F

from sojourn.operators import constraints, evaluate, fine, lookup

N = 40


@pytest.fixture
def met(monkeypatch):
    """Rows of both sides of each containment."""
    seen, plain = [], lookup.containing

    def counted(left, right, *args):
        seen.append((left.count(), right.count()))
        return plain(left, right, *args)

    monkeypatch.setattr(lookup, "containing", counted)
    return seen


def table(spark):
    """Two names in one city, many rows each; the first row of the file is the answer."""
    rows = [(i, "accommodation" if i % 2 else "restaurant", f"{'L' if i % 2 else 'R'}1", "c0", 10 + i, 1 + i % 3, "No pets" if i == 1 else "", "Shared room" if i == 1 else "Private room", f"K{i}") for i in range(N)]
    return spark.createDataFrame(rows, "row_id int, kind string, name string, city string, price int, occupancy int, house_rules string, room_type string, cuisines string")


def days(spark):
    rows = [(p, 1, "c0", "-", "R1, c0", "R1, c0", "R, c0", "-", "L1, c0") for p in range(N)]
    return spark.createDataFrame(rows, "plan int, day int, current_city string, transportation string, breakfast string, lunch string, dinner string, attraction string, accommodation string")


def test_names_meet_once(spark, met):
    d, t = days(spark), table(spark)
    asked = d.select("plan", F.lit(2).alias("people_number"), F.lit("pets").alias("house_rule"), F.lit("shared room").alias("room_type"), F.lit("c9").alias("org"), F.array(F.lit("K0")).alias("cuisine"))
    rooms, food = t.where("kind = 'accommodation'"), t.where("kind = 'restaurant'")
    assert {r.ok for r in constraints.room_rule(d, asked, rooms).collect()} == {False}
    assert {r.ok for r in constraints.room_type(d, asked, rooms).collect()} == {True}
    values = constraints.cuisine_values(d, asked, food).collect()
    assert len(values) == 3 * N and {tuple(r["values"]) for r in values} == {("K0",)}
    flights = spark.createDataFrame([], "row_id int, flight_number string, origin string, dest string, price int")
    far = spark.createDataFrame([], "origin string, destination string, km double")
    assert {r.cost for r in constraints.plan_cost(d, asked, t, flights, far).collect()} == {10 * 2 * 3 + 11 * 1}
    assert {r.ok for r in constraints.within_sandbox(d, t, flights).collect()} == {True}
    stay = constraints.minimum_nights(d, rooms.withColumn("minimum_nights", F.lit(3)))
    assert {r.ok for r in stay.collect()} == {True}
    assert len(met) == 6 and max(max(m) for m in met) <= 3


def test_events_meet_once(spark, met):
    date = lambda n: datetime.date(2024, 1, 1 + n)
    events = spark.createDataFrame([(i, "E1", "c0", date(i % 5), f"s{i}") for i in range(N)], "row_id int, name string, city string, date date, segment string")
    d = days(spark).select("*", F.lit(1).alias("days"), F.lit("E1, c0").alias("event"), F.lit("-").alias("points"))
    asked = spark.createDataFrame([(p, [date(3), date(4)] if p % 2 else [date(9), date(9)]) for p in range(N)], "plan int, dates array<date>")
    assert sorted((r.plan, r["values"]) for r in fine.event_types(d, asked, events).collect()) == [(p, ["s3"]) for p in range(N) if p % 2]
    assert met == [(1, 5)]


def test_facts_of_names_are_few(spark, met):
    t = table(spark)
    none = lambda schema: spark.createDataFrame([], schema)
    events = spark.createDataFrame([(i, "E1", "c0", f"2024-01-0{1 + i % 5}", f"s{i}") for i in range(N)], "row_id int, name string, city string, date string, segment string")
    rooms = t.where("kind = 'accommodation'").withColumn("minimum_nights", F.lit(1))
    box = evaluate.Sandbox(t.where("kind = 'restaurant'"), rooms, none("row_id int, name string, city string, price int, subcategories string"), none("row_id int, flight_number string, origin string, dest string, price int"), none("origin string, destination string, km double"), none("city string, state string"), events, none("poi string, city string, stop string, stop_distance double"))
    keys = spark.createDataFrame([("event", "E1", "c0", ""), ("restaurant", "R", "c0", ""), ("accommodation", "L1", "c0", "")], "look string, x string, y string, z string")
    got = {r.look: r for r in evaluate.known(keys, box).collect()}
    assert [(i.a, i.b) for i in got["event"]["items"]] == [(f"s{i}", f"2024-01-0{1 + i}") for i in range(5)] and got["event"].n == N
    assert (got["restaurant"].n, got["restaurant"].price, got["restaurant"].words) == (N // 2, 10.0, "K0")
    assert (got["accommodation"].n, got["accommodation"].room) == (N // 2, "Shared room")
    assert max(max(m) for m in met) <= 7
