import pytest
from pyspark.sql import functions as F

from sojourn.operators import aggregates as agg
from sojourn.operators import constraints as c
from sojourn.operators import windows

DAYS = "plan long, day int, current_city string, transportation string, breakfast string, lunch string, dinner string, attraction string, accommodation string, points string"
GOOD = [
    (1, 1, "from Rome to Peoria", "Flight Number: F1, from Rome to Peoria", "-", "Bar A, Peoria", "Bar B, Peoria", "Zoo, Peoria;", "Inn, Peoria", "Inn, stay from 20:00 to 22:00;"),
    (1, 2, "Peoria", "-", "Bar C, Peoria", "Bar D, Peoria", "Bar E, Peoria", "Park, Peoria;Lake, Peoria;", "Inn, Peoria", "Park, visit; Inn, stay;"),
    (1, 3, "from Peoria to Rome", "Flight Number: F2, from Peoria to Rome", "Bar F, Peoria", "-", "-", "-", "-", ""),
]
BAD = [
    (2, 1, "Peoria", "-", "Bar A, Peoria", "Bar A, Peoria", "Ghost, Peoria", "Zoo, Peoria;Zoo, Peoria;", "Hostel, Peoria", "Zoo, visit;"),
    (2, 2, "Peoria", "Self-driving, from Peoria to Rome", "Bar B, Rome", "-", "-", "-", "-", ""),
    (2, 3, "Rome", "Taxi, from Rome to Peoria", "-", "-", "-", "-", "-", ""),
]


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame(GOOD + BAD, DAYS)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "Rome", "Peoria", 3, 1, 2, 5000.0, "smoking", "entire room", "no self-driving", ["Thai"]), (2, "Rome", "Peoria", 3, 1, 2, 10.0, "pets", "private room", "no self-driving", ["Greek", "Thai"]), (3, "Rome", "Peoria", 3, 1, 1, 0.0, None, None, None, None)]
    return spark.createDataFrame(rows, "plan long, org string, dest string, days int, visiting_city_number int, people_number int, budget double, house_rule string, room_type string, transportation string, cuisine array<string>")


def ok(df):
    return {r.plan: r.ok for r in df.collect()}


def lodgings(spark):
    return spark.createDataFrame([(1, "Inn", "Peoria", 2, "No pets", "Entire home/apt"), (2, "Hostel", "Peoria", 3, "No pets & No parties", "Shared room"), (3, "Inn", "Rome", 9, "", "Shared room")], "row_id int, name string, city string, minimum_nights int, house_rules string, room_type string")


def test_slot_checks(days):
    s = c.slots(days, keep_tail=False)
    assert s.where("plan = 1 and kind = 'attraction'").count() == 3
    assert ok(c.no_repeats(s, c.MEALS)) == {1: True, 2: False}
    assert ok(c.no_repeats(s, ["attraction"])) == {1: True, 2: False}
    assert ok(c.transportation(days)) == {1: True, 2: False}
    assert ok(c.within_city(days)) == {1: True, 2: False}


def test_cities(spark, days, queries):
    states = spark.createDataFrame([("Rome", "Lazio"), ("Peoria", "Illinois")], "city string, state string")
    assert ok(c.reasonable_cities(days, queries, states)) == {1: True, 2: False}
    assert ok(c.visiting_cities(days, queries)) == {1: True, 2: True}
    routes = [(["O", "A", "A", "O"], True), (["O", "A", "O"], False), (["O", "A"], False), (["O", "A", "A", "B", "B", "A", "A", "O"], False), (["O", "A", "A", "B", "B", "O"], True)]
    df = spark.createDataFrame(routes, "r array<string>, want boolean").select(windows.sequence_ok(F.col("r")).alias("ok"), "want")
    assert all(r.ok == r.want for r in df.collect())


def test_sandbox_and_presence(spark, days, queries):
    entities = spark.createDataFrame([("restaurant", f"Bar {x}", "Peoria") for x in "ABCDEF"] + [("attraction", a, "Peoria") for a in ("Zoo", "City Park", "Lake")] + [("accommodation", "Inn", "Peoria"), ("accommodation", "Hostel", "Peoria")], "kind string, name string, city string")
    flights = spark.createDataFrame([("F1", "Rome", "Peoria"), ("F2", "Peoria", "Rome")], "flight_number string, origin string, dest string")
    got = {r.plan: r for r in c.within_sandbox(days, entities, flights).collect()}
    assert got[1].ok and not got[2].ok and "restaurant" in got[2].reason
    assert ok(c.not_absent(days, queries)) == {1: True, 2: False}
    assert ok(c.minimum_nights(days, lodgings(spark))) == {1: True, 2: False}


def test_wishes(spark, days, queries):
    lod = lodgings(spark)
    assert ok(c.room_rule(days, queries, lod)) == {1: True, 2: False, 3: None}
    assert ok(c.room_type(days, queries, lod)) == {1: True, 2: False, 3: None}
    assert ok(c.transport_ban(days, queries)) == {1: True, 2: False}
    restaurants = spark.createDataFrame([(1, "Bar A", "Peoria", "Greek, Thai"), (2, "Bar A", "Peoria", "French")], "row_id int, name string, city string, cuisines string")
    values = c.cuisine_values(days, queries, restaurants)
    assert ok(c.covered(values, queries, "cuisine")) == {1: True, 2: True, 3: None}


def test_cost(spark, days, queries):
    prices = spark.createDataFrame([(i, "restaurant", f"Bar {x}", "Peoria", 10.0, None) for i, x in enumerate("ABCDEF")] + [(9, "accommodation", "Inn", "Peoria", 100.0, 2), (10, "accommodation", "Hostel", "Peoria", 20.0, 1)], "row_id int, kind string, name string, city string, price double, occupancy int")
    flights = spark.createDataFrame([(1, "F1", 200.0), (2, "F1", 1.0), (3, "F2", 300.0)], "row_id int, flight_number string, price double")
    distances = spark.createDataFrame([("Peoria", "Rome", 1234.0)], "origin string, destination string, km double")
    costs = c.plan_cost(days, queries, prices, flights, distances)
    got = {r.plan: r for r in costs.collect()}
    assert got[1].cost == 6 * 10 * 2 + 2 * 100 + 2 * 200 + 2 * 300 and got[1].evaluable
    assert got[2].cost == 2 * 2 * 10 + 2 * 20 + 61 and not got[2].evaluable  # the taxi's leg has no distance
    assert ok(c.within_budget(costs, queries)) == {1: True, 2: False, 3: True}
    wide = c.together({"cost": c.within_budget(costs, queries), "bans": c.transport_ban(days, queries)}, queries)
    rows = wide.select(F.lit(True).alias("d"), F.col("bans.ok").alias("bans"), F.col("cost.ok").alias("cost"))
    rates = agg.gated_rates(rows, ["bans"], ["cost"], ["bans"], "d").first()
    assert rates.delivery == 1 and rates.soft_micro == 0.5 and rates.hard_micro == 1


def test_times_and_stops(spark):
    meals = spark.createDataFrame([(1, 1, 0, 8.0), (1, 1, 1, 12.0), (1, 1, 2, 18.0), (2, 1, 0, 8.0), (2, 1, 1, 10.0), (3, 1, 0, 8.0), (3, 1, 2, 9.0)], "plan int, day int, meal int, start double")
    assert ok(c.meal_gaps(meals)) == {1: True, 2: False, 3: True}
    assert ok(c.flight_margin(spark.createDataFrame([(1, 600, 560), (2, 600, 620)], "plan int, edge int, flight int"))) == {1: True, 2: False}
    points = spark.createDataFrame([(1, "Zoo", "P", "Main", 100.0), (2, "Zoo", "P", "Main", 110.0), (3, "Pub", "P", "x", 1.0)], "plan int, poi string, city string, stop_name string, distance double")
    stops = spark.createDataFrame([("Zoo", "P", "Main St", 103.0)], "poi string, city string, stop string, stop_distance double")
    assert ok(c.stop_near(points, stops)) == {1: True, 2: False, 3: False}
