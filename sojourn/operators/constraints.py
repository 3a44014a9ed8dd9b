"""Constraints on itineraries: slots in a long table, each check one row per plan with ok (null: doesn't apply) and a reason.

A plan day is a row (plan, day, current_city, transportation, breakfast, lunch, dinner, attraction, accommodation and, in the finer
form, event, points). '-' and '' are empty slots. Tables of the sandbox carry row_id, their place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions import numeric, text
from sojourn.operators import lookup, windows

MEALS = ["breakfast", "lunch", "dinner"]


def filled(c: Column) -> Column:
    return F.coalesce(~F.trim(c).isin("", "-"), F.lit(False))


def slots(days: DataFrame, keep_tail: bool = True) -> DataFrame:
    """plan, day, place, kind, value, name, city of filled slots; attractions one each. keep_tail: whether what stands after the last
    semicolon of attractions counts."""
    sights = F.split(F.col("attraction"), ";")
    if not keep_tail:
        sights = F.slice(sights, F.lit(1), F.greatest(F.size(sights) - 1, F.lit(0)))
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    every = F.concat(F.array(*(item(m, F.col(m)) for m in MEALS)), F.transform(F.coalesce(sights, F.array().cast("array<string>")), lambda a: F.struct(F.lit("attraction").alias("kind"), F.trim(a).alias("value"))), F.array(item("accommodation", F.col("accommodation"))))
    out = days.select("plan", "day", F.posexplode(every).alias("place", "s")).select("plan", "day", "place", "s.kind", "s.value").where(filled(F.col("value")))
    nc = text.name_city(F.col("value"))
    return out.select("*", nc["name"].alias("name"), nc["city"].alias("city"))


def result(df: DataFrame, ok: Column, reason: Column) -> DataFrame:
    return df.select("plan", ok.alias("ok"), F.when(~ok, reason).alias("reason"))


def first_fault(days: DataFrame, faults: list[tuple[Column, str]], plans: DataFrame) -> DataFrame:
    """The reason of the earliest day's first fault; plans without one are ok."""
    reason = F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in faults))
    bad = days.withColumn("_r", reason).where(F.col("_r").isNotNull()).groupBy("plan").agg(F.min(F.struct("day", "_r")).alias("_b"))
    j = plans.select("plan").join(bad, "plan", "left")
    return result(j, F.col("_b").isNull(), F.format_string("day %s: %s", F.col("_b.day"), F.col("_b._r")))


def day_cities(days: DataFrame) -> DataFrame:
    """plan, cities: the route, two entries for a day of travel."""
    ft = text.from_to(F.col("current_city"))
    plain = lambda c: F.trim(text.before_parenthesis(c))
    own = F.when(ft["origin"].isNotNull(), F.array(plain(ft["origin"]), plain(ft["destination"]))).otherwise(F.array(plain(F.col("current_city"))))
    return days.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("day", own.alias("c")))).alias("_d")).select("plan", F.flatten(F.col("_d.c")).alias("cities"))


def reasonable_cities(days: DataFrame, queries: DataFrame, states: DataFrame) -> DataFrame:
    """queries (plan, org, dest, days), states (city, state): starts at the origin, a closed loop, a valid sequence, known cities, and
    for more than three days cities between in the state asked for."""
    routes = day_cities(days).join(queries, "plan")
    inside = F.slice(F.col("cities"), F.lit(2), F.greatest(F.size("cities") - 2, F.lit(0)))
    known = routes.select("plan", F.explode(F.array_distinct("cities")).alias("city")).join(states, "city", "left")
    strange = known.groupBy("plan").agg(F.count_if(F.col("state").isNull()).alias("strange"), F.map_from_entries(F.collect_list(F.struct("city", F.coalesce("state", F.lit("")).alias("state")))).alias("of"))
    r = routes.join(strange, "plan").withColumn("away", (F.col("days") > 3) & F.exists(inside, lambda c: (c != F.col("org")) & (F.col("of")[c] != F.col("dest"))))
    tests = [(F.try_element_at(F.col("cities"), F.lit(1)) != F.col("org"), "the trip doesn't start at the origin"), (~windows.closed_loop(F.col("cities")), "the trip isn't a closed loop"), (~windows.sequence_ok(F.col("cities")), "the city sequence is invalid"), (F.col("strange") > 0, "a city is unknown"), (F.col("away"), "a city is outside the state")]
    reason = F.coalesce(*(F.when(bad, why) for bad, why in tests))
    return result(r.withColumn("_r", reason), F.col("_r").isNull(), F.col("_r"))


def no_repeats(slot_rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Restaurants, attractions or events: no value twice in a plan."""
    rows = slot_rows.where(F.col("kind").isin(*kinds))
    first = windows.first_repeat(rows, ["plan"], ["day", "place"], "value", F.concat_ws(" ", F.lit("repeated on day"), F.col("day"), F.col("kind")))
    return result(first, F.col("repeated").isNull(), F.col("repeated"))


def minimum_nights(days: DataFrame, lodgings: DataFrame) -> DataFrame:
    """lodgings (row_id, name, city, minimum_nights): a stay is as long as its only match asks; several or no matches are let pass."""
    stays = windows.runs(days, ["plan"], ["day"], "accommodation").where(filled(F.col("accommodation")))
    nc = text.name_city(F.col("accommodation"))
    stays = stays.select("plan", "run", "length", nc["name"].alias("_n"), nc["city"].alias("city"))
    alike = lodgings.groupBy("city", "name").agg(F.count(F.lit(1)).alias("_m"), F.max("minimum_nights").alias("_least"))
    met = lookup.containing(stays.select("city", "_n").distinct(), alike, ["city"], "name", "_n", 3, False).groupBy("city", "_n").agg(F.sum("_m").alias("m"), F.max("_least").alias("least"))
    hits = stays.join(met, ["city", "_n"])
    bad = hits.where((F.col("m") == 1) & (F.col("length") < F.col("least"))).groupBy("plan").agg(F.min("run").alias("run"))
    return result(days.select("plan").distinct().join(bad, "plan", "left"), F.col("run").isNull(), F.format_string("stay %s is too short", "run"))


def transportation(days: DataFrame) -> DataFrame:
    """The first day names a transport, and kinds that exclude each other aren't mixed."""
    kinds = days.groupBy("plan").agg(F.collect_set(text.transport_kind(F.col("transportation"))).alias("k"), F.min_by(filled(F.col("transportation")), "day").alias("first"))
    has = lambda k: F.array_contains("k", k)
    mixed = (has("Self-driving") & has("Flight")) | (has("Taxi") & has("Self-driving"))
    return result(kinds, F.col("first") & ~mixed, F.when(~F.col("first"), "no transport on the first day").otherwise("transports that exclude each other"))


def within_city(days: DataFrame, keep_tail: bool = True) -> DataFrame:
    """Each slot names a city of its day."""
    ft = text.from_to(F.col("current_city"))
    own = days.select("plan", "day", F.when(ft["origin"].isNotNull(), F.array(ft["origin"], ft["destination"])).otherwise(F.array("current_city")).alias("allowed"))
    rows = slots(days, keep_tail).join(own, ["plan", "day"])
    bad = rows.where(~F.exists("allowed", lambda c: F.contains(F.col("value"), F.trim(text.before_parenthesis(c)))))
    first = bad.groupBy("plan").agg(F.min(F.struct("day", "place", "kind")).alias("b"))
    return result(days.select("plan").distinct().join(first, "plan", "left"), F.col("b").isNull(), F.format_string("day %s: %s is elsewhere", F.col("b.day"), F.col("b.kind")))


def within_sandbox(days: DataFrame, entities: DataFrame, flights: DataFrame, keep_tail: bool = True, distances: DataFrame | None = None) -> DataFrame:
    """entities (kind: restaurant, attraction, accommodation; name, city), flights (flight_number, origin, dest), distances (origin,
    destination, km): what a plan names is there. Names are found within a city, flights by number and cities, and where distances
    are given, cars and taxis by a known one."""
    kind = F.when(F.col("kind").isin(*MEALS), "restaurant").otherwise(F.col("kind"))
    named = slots(days, keep_tail).withColumn("kind", kind).select("plan", "day", "kind", F.col("name").alias("_n"), "city")
    found = lookup.names_within(named, entities, ["kind", "city"], "name", "_n")
    lost = named.join(found, ["kind", "city", "_n"], "left_anti").select("plan", "day", "kind")
    ft = text.from_to(F.col("transportation"))
    legs = days.where(F.col("transportation").contains("Flight Number")).select("plan", "day", text.flight_number(F.col("transportation")).alias("flight_number"), ft["origin"].alias("origin"), ft["destination"].alias("dest"))
    gone = lookup.unknown(legs, flights, ["flight_number", "origin", "dest"]).select("plan", "day", F.lit("flight").alias("kind"))
    if distances is not None:
        low = F.lower("transportation")
        drives = days.where(low.rlike("self-driving|taxi") & ~low.contains("flight number")).select("plan", "day", *(F.coalesce(F.trim(text.before_parenthesis(ft[c])), F.lit("-")).alias(c) for c in ("origin", "destination")))
        far = drives.join(distances.where("km is not null").select("origin", "destination"), ["origin", "destination"], "left_anti")
        gone = gone.unionByName(far.select("plan", "day", F.lit("ground").alias("kind")))
    first = lost.unionByName(gone).groupBy("plan").agg(F.min(F.struct("day", "kind")).alias("b"))
    return result(days.select("plan").distinct().join(first, "plan", "left"), F.col("b").isNull(), F.format_string("day %s: unknown %s", F.col("b.day"), F.col("b.kind")))


SLOTS = ["transportation", *MEALS, "attraction", "accommodation"]


def not_absent(days: DataFrame, queries: DataFrame, fields: list[str] = SLOTS) -> DataFrame:
    """queries (plan, org, days, visiting_city_number): as many days and cities as asked, no field missing, transport on days of travel,
    attractions on the others, lodging but for the last day, meals on days without travel, and half of the slots of all days filled;
    a day's number and city count as filled, too. With points among the fields: never none, and each stop with a distance."""
    d = days.join(queries.select("plan", F.col("days").alias("n")), "plan").where("day <= n")
    full = sum((filled(F.col(c)).cast("int") for c in [*fields, "current_city"]), F.lit(1))
    city, empty = F.col("current_city"), lambda c: ~filled(F.col(c))
    null = F.lit(False)
    for c in fields:
        null |= F.col(c).isNull()
    faults = [
        (null, "a field is missing"), (city.rlike("from |to ") & empty("transportation"), "no transport"), (~city.rlike("from | to ") & empty("attraction"), "no attraction"),
        ((F.col("day") != F.col("n")) & empty("accommodation"), "no lodging"), ((empty("breakfast") | empty("lunch") | empty("dinner")) & ~city.rlike("from "), "no meal"),
    ]
    if "points" in fields:
        stops = F.filter(F.split("points", ";"), lambda p: p.contains("nearest transit:"))
        bare = F.exists(stops, lambda p: p.rlike(r"nearest transit:.*,\s*-?\s*(m.*)?$"))
        faults = [faults[0], (filled(F.col("points")) & bare, "a stop without a distance"), *faults[1:], (empty("points"), "no points")]
    each = first_fault(d, faults, days.select("plan").distinct())
    sums = d.groupBy("plan").agg(F.sum(full).alias("full"))
    got = days.groupBy("plan").agg(F.count(F.lit(1)).alias("got"))
    cities = visiting_cities(days, queries).select("plan", F.col("ok").alias("cities"))
    j = each.join(got, "plan").join(sums, "plan", "left").join(cities, "plan").join(queries.select("plan", F.col("days").alias("n")), "plan")
    tests = [(F.col("got") != F.col("n"), F.lit("wrong number of days")), (~F.col("cities"), F.lit("wrong number of cities")), (~F.col("ok"), F.col("reason")), (F.coalesce("full", F.lit(0)) * 2 < F.col("n") * len(fields), F.lit("too many empty slots"))]
    reason = F.coalesce(*(F.when(bad, why) for bad, why in tests))
    return result(j.withColumn("_r", reason), F.col("_r").isNull(), F.col("_r"))


def visiting_cities(days: DataFrame, queries: DataFrame) -> DataFrame:
    """As many cities besides the origin as asked for."""
    n = day_cities(days).join(queries, "plan").withColumn("n", F.size(F.array_except(F.array_distinct("cities"), F.array("org"))))
    return result(n, F.col("n") == F.col("visiting_city_number"), F.format_string("%s cities", "n"))


def meal_gaps(visits: DataFrame, least: float = 4.0) -> DataFrame:
    """visits (plan, day, meal 0-2, start hour): meals that follow each other are so many hours apart; a missing meal breaks no rule."""
    w = Window.partitionBy("plan", "day").orderBy("meal")
    g = visits.withColumn("gap", F.when(F.col("meal") - F.lag("meal").over(w) == 1, F.col("start") - F.lag("start").over(w)))
    a = g.groupBy("plan").agg(F.min("gap").alias("gap"))
    return result(a, F.coalesce(F.col("gap") >= least, F.lit(True)), F.lit("meals too close"))


def flight_margin(legs: DataFrame, least: int = 30) -> DataFrame:
    """legs (plan, edge minutes of the first or last visit, flight minutes): so many minutes apart, whichever comes first."""
    a = legs.groupBy("plan").agg(F.min(F.abs(F.col("edge") - F.col("flight"))).alias("gap"))
    return result(a, F.col("gap") >= least, F.lit("too close to a flight"))


def stop_near(points: DataFrame, stops: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """points (plan, poi, city, stop_name, distance), stops (poi, city, stop, stop_distance): the stated stop is the table's."""
    j = points.join(stops, ["poi", "city"], "left")
    ok = F.coalesce(F.contains("stop", "stop_name") & (F.abs(F.col("distance") - F.col("stop_distance")) <= tolerance), F.lit(False))
    a = j.groupBy("plan", "poi").agg(F.bool_or(ok).alias("ok")).groupBy("plan").agg(F.bool_and("ok").alias("_ok"), F.min(F.when(~F.col("ok"), F.col("poi"))).alias("bad"))
    return result(a, F.col("_ok"), F.col("bad"))


#: What a house rule forbids, by the wish.
FORBIDDEN = {"smoking": "No smoking", "parties": "No parties", "children under 10": "No children under 10", "visitors": "No visitors", "pets": "No pets"}


def lodging_of(days: DataFrame, lodgings: DataFrame, values: list[str]) -> DataFrame:
    """Each filled lodging slot with the first row of the file that has its name in its city."""
    nc = text.name_city(F.col("accommodation"))
    own = days.where(filled(F.col("accommodation"))).select("plan", "day", nc["name"].alias("_n"), nc["city"].alias("city"))
    first = lookup.first_containing(own, lodgings, ["city"], "name", "_n", "row_id", values)
    return own.join(first, ["city", "_n"], "left").select("plan", "day", "found.*")


def room_rule(days: DataFrame, queries: DataFrame, lodgings: DataFrame) -> DataFrame:
    """Null without a wish; else no lodging's rules forbid it. Lodgings that aren't found forbid nothing."""
    rules = F.create_map(*(F.lit(x) for kv in FORBIDDEN.items() for x in kv))
    own = lodging_of(days, lodgings, ["house_rules"])
    j = queries.select("plan", F.col("house_rule").alias("w")).join(own, "plan", "left")
    a = j.groupBy("plan").agg(F.bool_and(~F.coalesce(F.contains("house_rules", rules[F.col("w")]), F.lit(False))).alias("_ok"), F.max("w").alias("w"))
    return result(a, F.when(F.col("w").isNotNull(), F.col("_ok")), F.concat(F.lit("the lodging forbids "), F.col("w")))


#: The room types that answer a wish, in the coarser and the finer table of lodgings.
ROOMS = {"not shared room": ["Entire home/apt", "Private room"], "shared room": ["Shared room"], "private room": ["Private room"], "entire room": ["Entire home/apt"]}
FINE_ROOMS = {"not shared room": ["entire_room", "private_room"], "shared room": ["shared_room"], "private room": ["private_room"], "entire room": ["entire_room"]}


def room_type(days: DataFrame, queries: DataFrame, lodgings: DataFrame, rooms: dict[str, list[str]] = ROOMS) -> DataFrame:
    """Null without a wish; else no lodging found is of another type."""
    own = lodging_of(days, lodgings, ["room_type"])
    j = queries.select("plan", F.col("room_type").alias("w")).join(own, "plan", "left")
    allowed = F.lit(True)
    for wish, kinds in rooms.items():
        allowed = F.when(F.col("w") == wish, F.col("room_type").isin(*kinds)).otherwise(allowed)
    a = j.groupBy("plan").agg(F.bool_and(F.coalesce(allowed, F.lit(True))).alias("_ok"), F.max("w").alias("w"))
    return result(a, F.when(F.col("w").isNotNull(), F.col("_ok")), F.concat(F.lit("not a "), F.col("w")))


def transport_ban(days: DataFrame, queries: DataFrame) -> DataFrame:
    """'no flight' or 'no self-driving'; case counts in the plan's text."""
    j = days.join(queries.select("plan", F.col("transportation").alias("w")), "plan")
    t = days["transportation"]
    used = F.when(F.col("w") == "no flight", t.contains("Flight")).when(F.col("w") == "no self-driving", t.contains("Self-driving"))
    a = j.groupBy("plan").agg(F.bool_or(used).alias("u"), F.max("w").alias("w"))
    return result(a, F.when(F.col("w").isNotNull(), ~F.coalesce("u", F.lit(False))), F.col("w"))


def covered(days_values: DataFrame, queries: DataFrame, wanted: str) -> DataFrame:
    """days_values (plan, values array): all wanted cuisines, attraction or event types of the plan occur; null if none is wanted."""
    got = days_values.groupBy("plan").agg(F.flatten(F.collect_list("values")).alias("got"))
    j = queries.select("plan", F.col(wanted).alias("w")).join(got, "plan", "left")
    missing = F.array_except(F.col("w"), F.coalesce("got", F.array().cast("array<string>")))
    return result(j, F.when(F.size(F.coalesce("w", F.array().cast("array<string>"))) > 0, F.size(missing) == 0), F.get(missing, F.lit(0)))


def cuisine_values(days: DataFrame, queries: DataFrame, restaurants: DataFrame) -> DataFrame:
    """plan, values: cuisines of the plan's meals by the first row found. A meal in the city of origin hides the day's later meals."""
    rows = slots(days).where(F.col("kind").isin(*MEALS)).join(queries.select("plan", "org"), "plan")
    home = F.min(F.when(F.col("city") == F.col("org"), F.col("place"))).over(Window.partitionBy("plan", "day"))
    rows = rows.withColumn("_h", home).where(F.col("_h").isNull() | (F.col("place") < F.col("_h"))).select("plan", "day", "place", F.col("name").alias("_n"), "city")
    first = lookup.first_containing(rows, restaurants, ["city"], "name", "_n", "row_id", ["cuisines"])
    return rows.join(first, ["city", "_n"]).select("plan", F.transform(F.split("found.cuisines", ","), lambda x: F.trim(x)).alias("values"))


def plan_cost(days: DataFrame, queries: DataFrame, prices: DataFrame, flights: DataFrame, distances: DataFrame) -> DataFrame:
    """plan, cost, evaluable. prices (row_id, kind restaurant or accommodation, name, city, price, occupancy), flights (row_id,
    flight_number, price), distances (origin, destination, km). Meals cost each person, rooms what the party needs, flights a seat each,
    cars and taxis their number times the distance's price; a leg without a price makes the plan not evaluable."""
    people = queries.select("plan", "people_number")
    kind = F.when(F.col("kind").isin(*MEALS), "restaurant").otherwise(F.col("kind"))
    rows = slots(days).withColumn("kind", kind).where("kind <> 'attraction'").select("plan", "day", "place", "kind", F.col("name").alias("_n"), "city")
    first = lookup.first_containing(rows, prices, ["kind", "city"], "name", "_n", "row_id", ["price", "occupancy"])
    hit = rows.join(first, ["kind", "city", "_n"]).withColumnRenamed("found", "v")
    units = F.when(F.col("kind") == "accommodation", F.ceil(F.col("people_number") / F.col("v.occupancy"))).otherwise(F.col("people_number"))
    named = hit.join(people, "plan").select("plan", (F.col("v.price") * units).alias("cost"))
    mode, ft = text.transport_kind(F.col("transportation")), text.from_to(F.col("transportation"))
    legs = days.where(filled(F.col("transportation"))).select("plan", mode.alias("mode"), text.flight_number(F.col("transportation")).alias("flight_number"), ft["origin"].alias("origin"), ft["destination"].alias("destination")).join(people, "plan")
    legs = lookup.first_match(legs, flights.withColumnRenamed("price", "fare"), ["flight_number"], "row_id", ["fare"]).join(distances, ["origin", "destination"], "left")
    ground = text.ground_cost(F.col("km"), F.lower("mode")) * numeric.party_units(F.col("people_number"), F.col("mode"))
    travel = legs.select("plan", F.when(F.col("mode") == "Flight", F.col("fare") * F.col("people_number")).otherwise(ground).alias("cost"))
    every = named.unionByName(travel).groupBy("plan").agg(F.sum("cost").alias("cost"), F.bool_and(F.col("cost").isNotNull()).alias("evaluable"))
    return queries.select("plan").join(every, "plan", "left").select("plan", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("evaluable", F.lit(True)).alias("evaluable"))


def within_budget(costs: DataFrame, queries: DataFrame) -> DataFrame:
    j = costs.join(queries.select("plan", "budget"), "plan")
    return result(j, F.col("evaluable") & (F.col("cost") <= F.col("budget")), F.format_string("costs %s", "cost"))


def together(checks: dict[str, DataFrame], plans: DataFrame) -> DataFrame:
    """One row per plan with each check's ok and reason as a struct, for gated rates."""
    out = plans.select("plan")
    for name, c in checks.items():
        out = out.join(c.select("plan", F.struct("ok", "reason").alias(name)), "plan", "left")
    return out


def first_failure(checks: list[str]) -> Column:
    """The name of the first check of `together` that fails, in the given order; null if none does."""
    return F.coalesce(*(F.when(~F.coalesce(F.col(f"{c}.ok"), F.lit(True)), F.lit(c)) for c in checks))
