"""The finer rules on itineraries: days with events and a list of timed points, sandbox lookups for legs, events and transit stops,
what a single day costs, and how alike two orders of points are.

A day is a row (plan, day, days, current_city, transportation, breakfast, lunch, dinner, attraction, accommodation, event, points);
days is how many were asked for, and rows beyond them are not looked at. Checks give one row per plan: ok, reason of the first fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions import text
from sojourn.functions.binding import let
from sojourn.operators import constraints, lookup
from sojourn.operators.constraints import MEALS, filled, first_fault, result

FIELDS = ["transportation", *MEALS, "attraction", "accommodation", "event", "points"]


def before_last_comma(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?s),[^,]*$", ""))


def after_last_comma(s: Column) -> Column:
    return F.trim(F.substring_index(s, ",", -1))


def items(s: Column) -> Column:
    """The parts of a list with semicolons that aren't empty; none of an empty slot."""
    return F.when(filled(s), F.filter(F.split(s, ";"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def asked_days(days: DataFrame) -> DataFrame:
    return days.where(F.col("day") <= F.col("days"))


def lodgings_in_turn(days: DataFrame) -> DataFrame:
    """days with `home` (the lodging so far, without its city: each day that repeats it loses one more part after a comma) and `before`
    (that of the last earlier day that names one)."""
    w = Window.partitionBy("plan").orderBy("day")
    own = F.when(F.col("accommodation") != "-", F.struct("day", "accommodation"))
    d = days.withColumn("_a", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("_p", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def cut(name: Column, parts: Column) -> Column:
        split = F.split(name, ",")
        return F.trim(F.array_join(F.slice(split, F.lit(1), F.greatest(F.size(split) - parts, F.lit(1))), ","))

    home = F.coalesce(cut(F.col("_a.accommodation"), (F.col("day") - F.col("_a.day") + 1).cast("int")), F.lit("abc"))
    return d.withColumn("home", home).withColumn("before", cut(F.col("_p.accommodation"), F.lit(1))).drop("_a", "_p")


def minutes_of(clock: Column) -> Column:
    """Minutes of hh:mm; null if it has no such form."""
    return F.regexp_extract(clock, r"(\d{1,2}):(\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(clock, r"(\d{1,2}):(\d{2})", 2).try_cast("int")


def near_flight(point: Column, flight: Column, pattern: str, least: int = 30) -> Column:
    """Whether a stay or visit of the point has a time (what the pattern finds) within so many minutes of the flight's."""
    timed = F.filter(F.split(point, ","), lambda p: p.rlike("(stay|visit) from"))
    return filled(point) & F.exists(timed, lambda p: F.coalesce(F.abs(minutes_of(F.regexp_extract(p, pattern, 1)) - flight) < least, F.lit(False)))


def poi_sequence(days: DataFrame) -> DataFrame:
    """The points of a day begin and end where the traveller sleeps. On days 3 and 5 of a week, or day 3 of five days, they lead from
    the lodging before to the new one; on other days of such trips their ends are free. Attractions and meals of the day are among
    the points, events are not. Half an hour lies between a flight's arrival and the first point (days 1, 3 of over three and 5 of
    over five), and between the last point of the plan's last day and the departure."""
    d = lodgings_in_turn(asked_days(days.withColumn("_last", F.max("day").over(Window.partitionBy("plan")))))
    points = F.split("points", ";")
    first, last = F.get(points, F.lit(0)), F.try_element_at(points, F.lit(-1))
    day, n, home, inside = F.col("day"), F.col("days"), F.col("home"), lambda x: F.contains("points", x)
    moves = ((n == 7) & day.isin(3, 5)) | ((n == 5) & (day == 3))
    moved = F.contains(first, F.col("before")) & F.contains(last, home)
    sleeps = F.contains(first, home) & ((F.col("accommodation") == "-") | F.contains(last, home))
    missing = lambda c: F.exists(items(F.col(c)), lambda x: ~inside(before_last_comma(x)))
    low = F.lower("transportation")
    flies = low.contains("flight") & low.contains("departure") & low.contains("arrival")
    arrival, departure = (minutes_of(F.regexp_extract("transportation", rf"{k} Time: ([^,]*)", 1)) for k in ("Arrival", "Departure"))
    lands = (day == 1) | ((n > 3) & (day == 3)) | ((n > 5) & (day == 5))
    faults = [
        (moves & F.coalesce(F.col("before") != "", F.lit(False)) & ~moved, "doesn't lead from lodging to lodging"),
        (~n.isin(5, 7) & ~sleeps, "ends away from the lodging"),
        (F.exists(items(F.col("event")), lambda x: inside(before_last_comma(x))), "holds an event"),
        (missing("attraction"), "lacks an attraction"),
        *((filled(F.col(m)) & ~inside(before_last_comma(F.col(m))), f"lacks {m}") for m in MEALS),
        (flies & lands & near_flight(first, arrival, r"from (\d{1,2}:\d{2})"), "starts too soon after the flight"),
        (flies & (day == F.col("_last")) & near_flight(last, departure, r" to (\d{1,2}:\d{2})\s*$"), "ends too late for the flight"),
    ]
    return first_fault(d, faults, days.select("plan").distinct())


def clock(s: Column) -> Column:
    """Hours of 'h:m'; null if it isn't one."""
    parts = F.split(s, ":")
    return F.trim(F.get(parts, F.lit(0))).try_cast("int") + F.trim(F.get(parts, F.lit(1))).try_cast("int") / 60


def meal_times(meal: Column, points: Column) -> Column:
    """struct(from, to), in hours, of the first point with the meal's name; null if none has it, its fields null if they can't be read."""
    named = let(before_last_comma(meal), lambda name: F.get(F.filter(F.split(points, ";"), lambda p: F.contains(p, name) & ~p.isin("", "-")), F.lit(0)))

    def times(own: Column) -> Column:
        parts = F.split(F.coalesce(F.get(F.split(own, "from"), F.lit(1)), F.lit("")), "to")
        read = let(parts, lambda p: F.struct(clock(F.get(p, F.lit(0))).alias("from"), clock(F.substring_index(F.get(p, F.lit(1)), ",", 1)).alias("to")))
        return F.when((meal != "-") & own.isNotNull(), read)

    return let(named, times)


def meals_apart(meals: list[Column], points: Column, least: float) -> Column:
    """For meals in order, two arrays: whether each one's time is there but can't be read, and whether each but the first starts too soon
    after the one before."""

    def judged(times: Column) -> Column:
        each = [F.get(times, F.lit(i)) for i in range(len(meals))]
        unread = [F.coalesce(t.isNotNull() & (t["from"].isNull() | t["to"].isNull()), F.lit(False)) for t in each]
        close = [F.coalesce(b["from"] - a["to"] < least, F.lit(False)) for a, b in zip(each, each[1:])]
        return F.struct(F.array(*unread).alias("unread"), F.array(*close).alias("close"))

    return let(F.array(*(meal_times(m, points) for m in meals)), judged)


def meal_gaps(days: DataFrame, least: float = 4.0, read: list[str] = MEALS) -> DataFrame:
    """From the end of a meal to the start of the next of the day's meals lie so many hours, where both are among the points; a meal of
    `read` among the points whose time can't be read fails the plan."""
    d = asked_days(days).withColumn("_m", meals_apart([F.col(m) for m in MEALS], F.col("points"), least))
    faults = [*((F.col("_m.unread")[i], f"no time of {m}") for i, m in enumerate(MEALS) if m in read), *((F.col("_m.close")[i], f"{a} and {b} too close") for i, (a, b) in enumerate(zip(MEALS, MEALS[1:])))]
    return first_fault(d, faults, days.select("plan").distinct())


def not_absent(days: DataFrame, queries: DataFrame) -> DataFrame:
    """The rule of constraints.not_absent for all eight slots."""
    return constraints.not_absent(days.drop("days"), queries, FIELDS)


def named_slots(days: DataFrame) -> DataFrame:
    """plan, day, kind, _n (name), city of meals, attractions, lodgings and events."""
    slot = lambda kind, c: F.transform(items(F.col(c)) if c in ("attraction", "event") else F.when(filled(F.col(c)), F.array(c)).otherwise(F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    every = F.concat(*(slot("restaurant", m) for m in MEALS), slot("attraction", "attraction"), slot("accommodation", "accommodation"), slot("event", "event"))
    rows = days.select("plan", "day", F.explode(every).alias("s")).select("plan", "day", "s.*")
    return rows.select("plan", "day", "kind", before_last_comma(F.col("v")).alias("_n"), after_last_comma(F.col("v")).alias("city"))


def stop_places(days: DataFrame) -> DataFrame:
    """days with `lies`, the cities where a day's points may lie: on days of moving (3 of 5; 3 and 5 of 7) either end of the last leg so
    far, on the last of 3, 5 or 7 days the city that it leaves, else the city that was named last; null for trips of other lengths."""
    turn = Window.partitionBy("plan").orderBy("day")
    at, own, move = text.from_to(F.col("current_city")), text.from_to(F.col("transportation")), F.lower("transportation")
    plain = lambda c: F.trim(text.before_parenthesis(c))
    end = lambda c: F.when(move.contains("flight number"), F.coalesce(plain(at[c]), own[c])).when(move.rlike("self-driving|taxi"), F.coalesce(plain(at[c]), F.lit("-"))).otherwise(at[c])
    leg = F.last(F.when(filled(F.col("transportation")), F.array(end("origin"), end("destination"))), ignorenulls=True).over(turn)
    one = lambda c: F.when(filled(F.col(c)), F.array(c)).otherwise(F.array().cast("array<string>"))
    named = F.concat(*map(one, MEALS), items(F.col("attraction")), items(F.col("event")), one("accommodation"))
    city = F.last(after_last_comma(F.try_element_at(named, F.lit(-1))), ignorenulls=True).over(turn)
    leaves = F.trim(F.substring_index(F.substring_index("current_city", "from ", -1), " to ", 1))
    n, day = F.col("days"), F.col("day")
    moving = ((n == 5) & (day == 3)) | ((n == 7) & day.isin(3, 5))
    lies = F.when(moving, leg).when(day == n, F.array(leaves)).otherwise(F.array(city))
    return days.withColumn("lies", F.when(n.isin(3, 5, 7), F.coalesce(F.array_compact(lies), F.array().cast("array<string>"))))


def stated_stops(days: DataFrame) -> DataFrame:
    """plan, day, poi, stop_name, distance (null without a comma), lies of points with 'nearest transit: stop, 120m away'."""
    p = F.explode(F.filter(items(F.col("points")), lambda x: x.contains("nearest transit:")))
    rows = stop_places(days).select("plan", "day", "lies", p.alias("p"))
    info = F.trim(F.element_at(F.split("p", "nearest transit:"), 2))
    head = F.trim(F.regexp_replace(F.trim(F.element_at(F.split("p", "nearest transit:"), 1)), r".$", ""))
    far = F.coalesce(F.trim(F.substring_index(after_last_comma(info), "m", 1)).try_cast("double"), F.lit(0.0))
    return rows.select("plan", "day", "lies", before_last_comma(head).alias("poi"), before_last_comma(info).alias("stop_name"), F.when(info.contains(","), far).alias("distance"))


def within_sandbox(days: DataFrame, entities: DataFrame, flights: DataFrame, distances: DataFrame, stops: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """entities (kind: restaurant, attraction, accommodation, event; name, city), flights (flight_number, origin, dest), distances
    (origin, destination, km), stops (poi, city, stop, stop_distance): names are found within their city, flights by number and
    cities, cars and taxis by a known distance, stops by point, city (see stop_places), name and a distance within the tolerance."""
    d = asked_days(days)
    named = named_slots(d)
    found = lookup.names_within(named, entities, ["kind", "city"], "name", "_n")
    lost = named.join(found, ["kind", "city", "_n"], "left_anti").select("plan", "day", "kind")
    at, own = text.from_to(F.col("current_city")), text.from_to(F.col("transportation"))
    plain = lambda c: F.trim(text.before_parenthesis(c))
    legs = d.where(filled(F.col("transportation"))).select("plan", "day", F.lower("transportation").alias("low"), text.flight_number(F.col("transportation")).alias("flight_number"), plain(F.coalesce(at["origin"], own["origin"])).alias("origin"), plain(F.coalesce(at["destination"], own["destination"])).alias("dest"), F.coalesce(plain(at["origin"]), F.lit("-")).alias("a"), F.coalesce(plain(at["destination"]), F.lit("-")).alias("b"))
    flies = F.col("low").contains("flight number")
    gone = legs.where(flies).join(flights, ["flight_number", "origin", "dest"], "left_anti").select("plan", "day", F.lit("flight").alias("kind"))
    drives = legs.where(~flies & F.col("low").rlike("self-driving|taxi"))
    known = distances.where("km is not null").select(F.col("origin").alias("a"), F.col("destination").alias("b"))
    far = drives.join(known, ["a", "b"], "left_anti").select("plan", "day", F.lit("ground").alias("kind"))
    said = stated_stops(d)
    asked = said.where("lies is not null and distance is not null")
    near = F.contains("stop", "stop_name") & (F.abs(F.col("stop_distance") - F.col("distance")) <= tolerance)
    stated = ["lies", "poi", "stop_name", "distance"]
    met = asked.select(*stated).distinct().withColumn("city", F.explode("lies")).join(stops.select("poi", "city", "stop", "stop_distance").distinct(), ["poi", "city"]).where(near).select(*stated).distinct()
    odd = asked.join(met, stated, "left_anti").unionByName(said.where("distance is null")).drop("lies")
    odd = odd.select("plan", "day", F.lit("stop").alias("kind"))
    bad = lost.unionByName(gone).unionByName(far).unionByName(odd).groupBy("plan").agg(F.min(F.struct("day", "kind")).alias("b"))
    return result(days.select("plan").distinct().join(bad, "plan", "left"), F.col("b").isNull(), F.format_string("day %s: unknown %s", F.col("b.day"), F.col("b.kind")))


def event_types(days: DataFrame, queries: DataFrame, events: DataFrame) -> DataFrame:
    """queries (plan, event array, dates array), events (row_id, name, city, date, segment): plan, values: the segments of the plan's
    events, each by the first row of the file with its name in its city between the first and last date asked for."""
    named = named_slots(asked_days(days)).where("kind = 'event'").join(queries.select("plan", "dates"), "plan")
    firsts = events.groupBy("city", "name", "date").agg(F.min_by(F.struct("row_id", "date", "segment"), "row_id").alias("e"))  # no more of a name than there are dates
    met = lookup.containing(named.select("city", "_n").distinct(), firsts, ["city"], "name", "_n", 3, False).groupBy("city", "_n", "date").agg(F.min_by("e", F.col("e.row_id")).alias("e"))
    every = met.groupBy("city", "_n").agg(F.array_sort(F.collect_list("e")).alias("_events"))
    during = F.filter("_events", lambda e: e["date"].between(F.get("dates", F.lit(0)), F.try_element_at("dates", F.lit(-1))))
    first = named.select("plan", "day", "_n", "city", "dates").distinct().join(every, ["city", "_n"]).withColumn("_d", during).where(F.size("_d") > 0)
    return first.select("plan", F.array(F.get("_d", F.lit(0))["segment"]).alias("values"))


def day_costs(days: DataFrame, restaurants: DataFrame, lodgings: DataFrame, flights: DataFrame, distances: DataFrame) -> DataFrame:
    """plan, day, cost, faults: what a day costs its people_number, by exact names and the first row of the file, or why it can't be
    said. restaurants (row_id, name, city, price), lodgings (row_id, name, city, price, occupancy), flights (row_id, flight_number,
    price), distances (origin, destination, km). Meals and rooms without a name and city cost nothing."""
    people, low = F.col("people_number"), F.lower("transportation")
    own, at = text.from_to(F.col("transportation")), text.from_to(F.col("current_city"))
    whole = own["origin"].isNotNull() & own["destination"].isNotNull()
    d = days.withColumn("flight_number", text.flight_number(F.col("transportation"))).withColumn("origin", F.when(whole, own["origin"]).otherwise(at["origin"])).withColumn("destination", F.when(whole, own["destination"]).otherwise(at["destination"]))
    d = lookup.first_match(d, flights.withColumnRenamed("price", "_fare"), ["flight_number"], "row_id", ["_fare"]).join(distances.withColumnRenamed("km", "_km"), ["origin", "destination"], "left")
    parts, faults, moves = [], [], filled(F.col("transportation"))
    mode = F.when(low.contains("flight number"), "flight").when(low.contains("self-driving"), "self-driving").when(low.contains("taxi"), "taxi")
    leg = F.when(mode == "flight", F.col("_fare") * people).otherwise(text.ground_cost(F.col("_km"), mode) * F.when(mode == "taxi", F.ceil(people / 4)).otherwise(F.ceil(people / 5)))
    parts.append(F.when(moves & mode.isNotNull(), leg))
    faults.append(F.when(moves & mode.isNotNull() & leg.isNull(), F.concat(F.lit("transportation: "), mode)))
    for slot, table, units in [*((m, restaurants, people) for m in MEALS), ("accommodation", lodgings, None)]:
        key, values = [f"_{slot}_name", f"_{slot}_city"], ["price"] if units is not None else ["price", "occupancy"]
        nc = text.name_city(F.col(slot))
        d = d.withColumn(key[0], nc["name"]).withColumn(key[1], nc["city"])
        dim = table.select("row_id", F.col("name").alias(key[0]), F.col("city").alias(key[1]), *(F.col(v).alias(f"_{slot}_{v}") for v in values))
        d = lookup.first_match(d, dim, key, "row_id", [f"_{slot}_{v}" for v in values])
        named = filled(F.col(slot)) & (F.col(key[0]) != "-") & (F.col(key[1]) != "-")
        each = F.col(f"_{slot}_price") * (units if units is not None else F.ceil(people / F.col(f"_{slot}_occupancy")))
        parts.append(F.when(named, each))
        faults.append(F.when(named & each.isNull(), F.lit(slot)))
    listed = F.array_compact(F.array(*faults))
    return d.select("plan", "day", F.when(F.size(listed) == 0, sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0.0))).alias("cost"), listed.alias("faults"))


def sequence_distance(a: Column, b: Column) -> Column:
    """The least total of mismatches along a path through both sequences, which may halt in one while the other goes on: 0 for two empty
    ones, infinite if only one is empty."""
    endless = F.lit(float("inf"))
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(endless, F.size(b)))
    step = lambda x, above: F.aggregate(
        F.sequence(F.lit(1), F.size(b)),
        F.array(endless),
        lambda row, j: F.concat(row, F.array(F.when(x == F.element_at(b, j), 0.0).otherwise(1.0) + F.least(F.element_at(above, j + 1), F.element_at(row, -1), F.element_at(above, j)))),
    )
    table = F.aggregate(a, start, lambda above, x: step(x, above))
    return F.when(F.size(b) == 0, F.when(F.size(a) == 0, 0.0).otherwise(endless)).otherwise(F.element_at(table, -1))


def point_kinds(day: dict[str, Column]) -> Column:
    """x, y or z for each point: where the traveller sleeps, a meal, else a sight. day: points, accommodation and meals as columns."""
    has = lambda p, c: F.contains(p, before_last_comma(day[c]))
    return F.transform(F.split(day["points"], ";"), lambda p: F.when(has(p, "breakfast") | has(p, "lunch") | has(p, "dinner"), "y").when(has(p, "accommodation"), "x").otherwise("z"))


def ordering_scores(made: DataFrame, noted: DataFrame) -> DataFrame:
    """made, noted (plan, day, kinds): plan, score: how well the orders of points of a made trip follow those of the noted one. Days 1
    and 2 are compared each with each, day 3 with day 3; the total over (n - 1)^2 + 1 for n noted days, over the longer sequence of
    the second days, is taken from 1."""
    days = noted.groupBy("plan").agg(F.count(F.lit(1)).alias("n"))
    a = made.select("plan", F.col("day").alias("i"), F.col("kinds").alias("a"))
    pairs = a.join(noted.select("plan", F.col("day").alias("j"), F.col("kinds").alias("b")), "plan").where("(i < 3 and j < 3) or (i = 3 and j = 3)")
    second = F.max(F.when((F.col("i") == 2) & (F.col("j") == 2), F.greatest(F.size("a"), F.size("b"))))
    total = pairs.groupBy("plan").agg(F.sum(sequence_distance(F.col("a"), F.col("b"))).alias("total"), second.alias("longest"), F.max("i").alias("_i")).where("_i = 3").join(days, "plan")
    return total.select("plan", (1 - F.col("total") / ((F.col("n") - 1) * (F.col("n") - 1) + 1) / F.col("longest")).alias("score"))
