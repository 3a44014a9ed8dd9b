"""Whole evaluations: plans, queries and the sandbox's tables in; every check of every plan, and the six rates, out.

What plans name (slots, legs, cities of the route, transit stops) becomes one long table, which is joined once with one table of what
the sandbox knows about each different name. One aggregation by plan then folds those rows, the plan's days and its query into a row,
and all checks are expressions on it: a plan's rows are shuffled once, however many checks there are.

days: a row per day (plan, day from 1, current_city, transportation, breakfast, lunch, dinner, attraction, accommodation; in the finer
form event and points, too). queries: plan, level, days, org, dest, people_number, budget, visiting_city_number and the wishes
house_rule, cuisine (array), room_type, transportation; in the finer form event, attraction and dates (arrays), too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import text
from sojourn.functions.binding import let
from sojourn.operators import constraints, fine, lookup, windows
from sojourn.operators.constraints import MEALS
from sojourn.operators.steps import kept

SOFT = ["reasonable_city", "restaurants", "attractions", "minimum_nights", "transport", "within_city", "within_sandbox", "not_absent"]
HARD = ["cost", "room_rule", "cuisine", "room_type", "transport_ban"]
FINE_SOFT = ["reasonable_city", "restaurants", "attractions", "transport", "events", "meal_gaps", "poi_sequence", "within_city", "within_sandbox", "not_absent"]
FINE_HARD = [*HARD, "event_type", "attraction_type"]
#: The wish that each hard check answers; cost is asked of every plan.
WISHES = {"room_rule": "house_rule", "cuisine": "cuisine", "room_type": "room_type", "transport_ban": "transportation", "event_type": "event", "attraction_type": "attraction"}
#: A day that isn't planned, and the wishes that count at a level.
NOT_NEEDED = "You don't need to fill in the information for this or later days."
COUNTED = {"medium": ["room_rule", "cuisine", "room_type", "event_type", "attraction_type"], "hard": list(WISHES)}


@dataclass
class Sandbox:
    """restaurants (row_id, name, city, price, cuisines text), lodgings (row_id, name, city, price, occupancy, minimum_nights,
    house_rules, room_type), attractions (row_id, name, city and, in the finer form, subcategories text), flights (row_id,
    flight_number, origin, dest, price), distances (origin, destination, km), states (city, state), and in the finer form events
    (row_id, name, city, date, segment) and stops (poi, city, stop, stop_distance). row_id is a row's place in its file."""

    restaurants: DataFrame
    lodgings: DataFrame
    attractions: DataFrame
    flights: DataFrame
    distances: DataFrame
    states: DataFrame
    events: DataFrame | None = None
    stops: DataFrame | None = None

    @property
    def finer(self) -> bool:
        return self.stops is not None


def given(c: Column) -> Column:
    return F.coalesce((c != "") & (c != "-"), F.lit(False))


def bare(c: Column) -> Column:
    return text.before_parenthesis(c)


KEY = ["look", "x", "y", "z"]
NOTHING = "array<struct<a: string, b: string>>"
KNOWN = "look string, x string, y string, z string, n long, price double, occupancy double, nights double, words string, room string, items array<struct<a: string, b: string>>"


def named(s: Column, finer: bool) -> Column:
    """struct(name, city) of a slot."""
    if not finer:
        return text.name_city(s)
    parts = text.name_city_last_comma(s)
    return F.struct(parts["name"].alias("name"), F.when(s.contains(","), F.trim(bare(parts["city"]))).otherwise("-").alias("city"))


def flies(s: Column) -> Column:
    return F.lower(s).contains("flight number")


def legs(day: Column, finer: bool) -> tuple[Column, Column]:
    """The ends of a day's leg as the sandbox is asked for them, and as the cost is."""
    own, at = text.from_to(day["transportation"]), text.from_to(day["current_city"])
    whole = own["origin"].isNotNull() & own["destination"].isNotNull()
    costed = F.struct(*(F.when(whole, own[c]).otherwise(at[c]).alias(c) for c in ("origin", "destination")))
    if not finer:
        return F.struct(*(bare(costed[c]).alias(c) for c in ("origin", "destination"))), costed
    missing = at["origin"].isNull() | at["destination"].isNull()
    asked = [F.when(~missing, bare(at[c])).when(flies(day["transportation"]), own[c]).alias(c) for c in ("origin", "destination")]
    return F.struct(*asked), costed


def route(day: Column) -> Column:
    """The cities that a day's current_city names: two, one, or a null that no sandbox knows."""
    city = day["current_city"]
    ends = text.from_to(city)
    return F.when(city.contains("from"), F.array(bare(ends["origin"]), bare(ends["destination"]))).otherwise(F.array(bare(city)))


def sights(s: Column, finer: bool) -> Column:
    """The parts of a list with semicolons; the coarser form leaves out what follows the last one."""
    parts = F.split(s, ";")
    if not finer:
        parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when(given(s), parts).otherwise(F.array().cast("array<string>"))


def stated_stop(p: Column) -> Column:
    """struct(poi, stop, far, whole) of a point with 'nearest transit: stop, 120m away'; whole: it has the comma."""
    parts = F.split(p, "nearest transit:")
    head, info = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    far = F.coalesce(F.trim(F.substring_index(fine.after_last_comma(info), "m", 1)).try_cast("double"), F.lit(0.0))
    return F.struct(fine.before_last_comma(F.regexp_replace(head, r"(?s).$", "")).alias("poi"), fine.before_last_comma(info).alias("stop"), far.alias("far"), info.contains(",").alias("whole"))


def things(days: DataFrame, finer: bool) -> DataFrame:
    """plan, day, place, kind, value and what to look it up by (look, x, y, z) of everything that plans name."""
    day = F.struct(*(F.col(c) for c in days.columns if c != "plan"))
    none, empty = F.lit(""), F.lit("")

    def thing(kind: str, look: str, value: Column, x: Column, y: Column, z: Column = empty, place: Column = F.lit(0)) -> Column:
        parts = {"kind": F.lit(kind), "look": F.lit(look), "value": value, "x": F.coalesce(x, none), "y": F.coalesce(y, none), "z": z, "place": place.cast("int")}
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    def slot(kind: str, look: str, values: Column, first: int, of: Column | None = None) -> Column:
        def one(v: Column, i: Column) -> Column:
            n = named(v, finer) if look != "event" else F.struct(fine.before_last_comma(v).alias("name"), fine.after_last_comma(v).alias("city"))
            return let(n, lambda n: thing(kind, look, v, n["name"], n["city"], place=i + first))

        return F.transform(values, one)

    single = lambda c: F.when(given(F.col(c)), F.array(c)).otherwise(F.array().cast("array<string>"))
    asked, costed = legs(day, finer)
    moves = given(F.col("transportation"))
    number, ground = text.flight_number(F.col("transportation")), F.lower("transportation").rlike("self-driving|taxi") & ~flies(F.col("transportation"))
    every = [
        *(slot(m, "restaurant", single(m), i) for i, m in enumerate(MEALS)),
        slot("attraction", "attraction", sights(F.col("attraction"), finer), 10),
        slot("accommodation", "accommodation", single("accommodation"), 1_000_000),
        F.transform(route(day), lambda c, i: thing("city", "city", c, c, empty, place=i)),
        F.when(moves & flies(F.col("transportation")), F.array(thing("flight", "flight", F.col("transportation"), number, empty))),
        F.when(moves & ground, F.array(*(thing(k, "ground", F.col("transportation"), *(F.coalesce(bare(e[c]), F.lit("-")) for c in ("origin", "destination"))) for k, e in (("ground", asked), ("fare", costed))))),
    ]
    if finer:
        every.append(slot("event", "event", sights(F.col("event"), True), 500_000))
        stops = F.transform(F.filter(F.split("points", ";"), lambda p: p.contains("nearest transit:")), stated_stop)
        every.append(F.when(given(F.col("points")), F.transform(F.filter(stops, lambda s: s["whole"]), lambda s, i: thing("stop", "stop", s["poi"], s["poi"], s["stop"], s["far"].cast("string"), i))))
    none_of = F.array().cast("array<struct<kind: string, look: string, value: string, x: string, y: string, z: string, place: int>>")
    rows = days.select("plan", "day", F.explode(F.concat(*(F.coalesce(e, none_of) for e in every))).alias("t"))
    return rows.select("plan", "day", "t.*")


def known(rows: DataFrame, box: Sandbox, tolerance: float = 5.0) -> DataFrame:
    """What the sandbox says of each different thing: n matches, values of the first in its file, items (routes of a flight, the state
    of a city, cities of a stop, segments and dates of an event). A row for each thing that is there."""
    keys = rows.select(*KEY).distinct()
    none = lambda kind: F.lit(None).cast(kind)

    def entity(kind: str, table: DataFrame, **values: str) -> DataFrame:
        kinds = {"price": "double", "occupancy": "double", "nights": "double", "words": "string", "room": "string", "segment": "string", "date": "string"}
        return table.select(F.lit(kind).alias("look"), "row_id", "name", F.col("city").alias("y"), *((F.col(values[k]) if k in values else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))

    places = entity("restaurant", box.restaurants, price="price", words="cuisines")
    places = places.unionByName(entity("accommodation", box.lodgings, price="price", occupancy="occupancy", nights="minimum_nights", words="house_rules", room="room_type"))
    places = places.unionByName(entity("attraction", box.attractions, **({"words": "subcategories"} if box.finer else {})))
    if box.finer:
        places = places.unionByName(entity("event", box.events, segment="segment", date="date"))
    # of equal names in a city (and equal dates of events) only the first row counts, and how many there are
    rows_at = places.groupBy("look", "y", "name", "date").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "price", "words", "occupancy", "nights", "room", "segment")).alias("f"))
    met = lookup.containing(keys.where(F.col("look").isin("restaurant", "accommodation", "attraction", "event")), rows_at, ["look", "y"], "name", "x")
    met = met.groupBy(*KEY, "date").agg(F.sum("n").alias("n"), F.min("f").alias("f"))
    dated = F.array_sort(F.collect_list(F.when(F.col("look") == "event", F.struct("f.row_id", "f.segment", "date"))))
    items = F.transform(dated, lambda e: F.struct(e["segment"].alias("a"), e["date"].alias("b")))
    out = met.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("f").alias("v"), items.alias("items")).select(*KEY, "n", *(f"v.{c}" for c in ("price", "occupancy", "nights", "words", "room")), "items")

    def fact(table: DataFrame, look: str, x: str | Column, y: str | Column, n: Column, price: Column, items: Column) -> DataFrame:
        by = table.groupBy(F.lit(look).alias("look"), F.lit("").alias("z"), (F.col(x) if isinstance(x, str) else x).alias("x"), (F.col(y) if isinstance(y, str) else y).alias("y"))
        rows = by.agg(n.alias("n"), price.cast("double").alias("price"), items.cast(NOTHING).alias("items"))
        return rows.select(*KEY, "n", "price", none("double").alias("occupancy"), none("double").alias("nights"), none("string").alias("words"), none("string").alias("room"), "items")

    rows_of = F.count(F.lit(1))
    cheapest = F.min_by("price", F.struct("row_id", "price"))
    out = out.unionByName(fact(box.flights, "flight", "flight_number", F.lit(""), rows_of, cheapest, F.collect_set(F.struct(F.col("origin").alias("a"), F.col("dest").alias("b")))))
    out = out.unionByName(fact(box.distances.where("km is not null"), "ground", "origin", "destination", rows_of, F.min("km"), F.array()))
    out = out.unionByName(fact(box.states, "city", "city", F.lit(""), rows_of, F.lit(None), F.array(F.struct(F.min("state").alias("a"), F.lit("").alias("b")))))
    if box.finer:
        near = F.contains("stop", "y") & (F.abs(F.col("stop_distance") - F.col("z").cast("double")) <= tolerance)
        stops = keys.where("look = 'stop'").join(box.stops.select(F.col("poi").alias("x"), "city", "stop", "stop_distance").distinct(), "x").where(near)
        cities = stops.groupBy(*KEY).agg(F.collect_set(F.struct(F.col("city").alias("a"), F.lit("").alias("b"))).alias("items"))
        out = out.unionByName(cities.select(*KEY, F.lit(1).cast("long").alias("n"), *(none(t).alias(c) for c, t in (("price", "double"), ("occupancy", "double"), ("nights", "double"), ("words", "string"), ("room", "string"))), "items"))
    return out


DAY = ["current_city", "transportation", *MEALS, "attraction", "accommodation"]
QUERY = ["level", "days", "org", "dest", "people_number", "budget", "visiting_city_number", "house_rule", "cuisine", "room_type", "transportation"]


def folded(days: DataFrame, queries: DataFrame, box: Sandbox) -> DataFrame:
    """A row per query: plan, q (the query), every (all days), d (those asked for), s (what they name, with what is known of it).
    This is the evaluation's one shuffle by plan."""
    days = days.select("plan", "day", *DAY, *(["event", "points"] if box.finer else []))
    rows = kept(things(days, box.finer), "things")  # read for the different things, and for all
    rows = rows.join(known(rows, box), KEY, "left")
    own = rows.select("plan", F.struct("day", "place", "kind", "value", "x", "y", F.coalesce("n", F.lit(0)).alias("n"), "price", "occupancy", "nights", "words", "room", "items").alias("s"))
    each = days.select("plan", F.struct(*days.columns[1:]).alias("d"))
    asked = queries.select("plan", F.struct(*QUERY, *(["event", "attraction", "dates"] if box.finer else [])).alias("q"))
    union = own.unionByName(each, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    by = union.groupBy("plan").agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("d")).alias("every"), F.max("q").alias("q")).where(F.col("q").isNotNull())
    within = lambda rows: F.filter(rows, lambda r: r["day"] <= F.col("q.days"))
    return by.select("plan", "q", "every", within(F.col("every")).alias("d"), within(F.col("s")).alias("s"))


def of_kind(*kinds: str) -> Column:
    return F.filter("s", lambda s: s["kind"].isin(*kinds))


def all_different(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def reasonable_city() -> Column:
    """Starts at the origin, ends where it began, stays in each city in one go, in cities that are known and, for more than three days, in
    the state asked for but at both ends."""
    q, cities = F.col("q"), of_kind("city")
    names = F.transform(cities, lambda c: c["value"])
    state = lambda c: F.get(c["items"], F.lit(0))["a"]
    inside = F.slice(cities, F.lit(2), F.greatest(F.size(cities) - 2, F.lit(0)))
    away = (q["days"] > 3) & F.exists(inside, lambda c: F.coalesce(state(c) != q["dest"], F.lit(True)))
    strange = F.exists(cities, lambda c: state(c).isNull())
    return starts_well() & F.coalesce(F.get(names, F.lit(0)) == F.try_element_at(names, F.lit(-1)), F.lit(False)) & windows.sequence_ok(names) & ~strange & ~away


def starts_well() -> Column:
    """Where the first day travels, it leaves from the origin."""
    first = F.get("d", F.lit(0))
    return ~first["current_city"].contains("from") | F.coalesce(F.get(route(first), F.lit(0)) == F.col("q.org"), F.lit(False))


def minimum_nights() -> Column:
    """No stay is shorter than its lodging asks, where just one lodging has that name in its city."""
    runs = F.aggregate(
        "d",
        F.array().cast("array<struct<value: string, nights: int>>"),
        lambda seen, d: F.when(
            F.coalesce(F.try_element_at(seen, F.lit(-1))["value"] == d["accommodation"], F.lit(False)),
            F.concat(F.slice(seen, F.lit(1), F.size(seen) - 1), F.array(F.struct(d["accommodation"].alias("value"), (F.try_element_at(seen, F.lit(-1))["nights"] + 1).alias("nights")))),
        ).otherwise(F.concat(seen, F.array(F.struct(d["accommodation"].alias("value"), F.lit(1).alias("nights"))))),
    )
    short = lambda r: F.exists(of_kind("accommodation"), lambda s: (s["value"] == r["value"]) & (s["n"] == 1) & (r["nights"] < s["nights"]))
    return ~F.exists(runs, lambda r: F.coalesce(short(r), F.lit(False)))


def transport() -> Column:
    """The first day has a transport, and none excludes another."""
    kinds = F.transform(F.filter("d", lambda d: given(d["transportation"])), lambda d: text.transport_kind(d["transportation"]))
    has = lambda k: F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), k)
    return given(F.get("every", F.lit(0))["transportation"]) & ~F.coalesce((has("Self-driving") & has("Flight")) | (has("Taxi") & has("Self-driving")), F.lit(False))


def within_city(finer: bool) -> Column:
    """What a day names lies where the day is: transports name all its cities, lodgings the last one, the rest any. In the coarser form a
    day without travel is held against the letters of its city, one by one, as the published rates were; the finer form refuses it."""

    def allowed(day: Column) -> Column:
        city = day["current_city"]
        if finer:
            return let(text.from_to(city), lambda e: F.array(e["origin"], e["destination"]))
        letters = let(bare(city), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1))))
        return F.when(city.contains("from"), let(text.from_to(city), lambda e: F.array(bare(e["origin"]), bare(e["destination"])))).otherwise(letters)

    def elsewhere(day: Column, cities: Column) -> Column:
        inside = lambda v, c: F.coalesce(v.contains(c), F.lit(False))
        drives = F.lit(False)
        if finer:
            drives = day["transportation"].contains("Self-driving") | day["transportation"].contains("Taxi")
        lost = given(day["transportation"]) & ~drives & F.exists(cities, lambda c: ~inside(day["transportation"], c))
        anywhere = lambda v: ~F.exists(cities, lambda c: inside(v, c))
        for m in MEALS:
            lost |= given(day[m]) & anywhere(day[m])
        lost |= F.exists(sights(day["attraction"], finer), anywhere)
        lost |= given(day["accommodation"]) & ~inside(day["accommodation"], F.try_element_at(cities, F.lit(-1)))
        return (~day["current_city"].contains("from") | lost) if finer else lost

    return ~F.exists("d", lambda d: F.coalesce(let(allowed(d), lambda c: elsewhere(d, c)), F.lit(True)))


def stops_known() -> Column:
    """Stops are those of the table at the point's city: on the last of 3, 5 or 7 days the city that the day leaves, on days of moving
    (3 of 5; 3 and 5 of 7) either end of the last leg so far, else the city that was named last."""
    spots = ["accommodation", "event", "attraction", *MEALS]
    blank = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("city", "origin", "destination")), F.lit(False).alias("bad"))

    def leg(was: Column, day: Column) -> Column:
        """The ends of the last leg so far."""
        asked, at, low = legs(day, True)[0], text.from_to(day["current_city"]), F.lower(day["transportation"])
        drives = low.contains("self-driving") | low.contains("taxi")
        ends = F.when(~given(day["transportation"]), F.struct(was["origin"].alias("origin"), was["destination"].alias("destination"))).when(flies(day["transportation"]), asked)
        driven = let(asked, lambda e: F.struct(F.coalesce(e["origin"], F.lit("-")).alias("origin"), F.coalesce(e["destination"], F.lit("-")).alias("destination")))
        return ends.when(drives, driven).otherwise(F.struct(at["origin"].alias("origin"), at["destination"].alias("destination")))

    def after(was: Column, day: Column, end: Column, city: Column) -> Column:
        n, i = F.col("q.days"), day["day"]
        leaves = F.trim(F.substring_index(F.substring_index(day["current_city"], "from ", -1), " to ", 1))
        moving = ((n == 5) & (i == 3)) | ((n == 7) & i.isin(3, 5))
        lies = F.array_compact(F.when(moving, F.array(end["origin"], end["destination"])).when((i == n) & n.isin(3, 5, 7), F.array(leaves)).otherwise(F.array(city)))
        stops = F.filter("s", lambda s: (s["day"] == i) & (s["kind"] == "stop"))
        known_there = lambda s, cities: F.coalesce(F.exists(s["items"], lambda c: F.coalesce(F.array_contains(cities, c["a"]), F.lit(False))), F.lit(False))
        lost = n.isin(3, 5, 7) & let(lies, lambda cities: F.exists(stops, lambda s: ~known_there(s, cities)))
        listed = F.filter(F.split(day["points"], ";"), lambda p: p.contains("nearest transit:"))
        broken = given(day["points"]) & F.exists(listed, lambda p: ~F.get(F.split(p, "nearest transit:"), F.lit(1)).contains(","))
        return F.struct(city.alias("city"), end["origin"].alias("origin"), end["destination"].alias("destination"), (was["bad"] | F.coalesce(lost | broken, F.lit(False))).alias("bad"))

    def step(was: Column, day: Column) -> Column:
        own = F.filter("s", lambda s: (s["day"] == day["day"]) & s["kind"].isin(*spots))
        city = F.coalesce(F.try_element_at(own, F.lit(-1))["y"], was["city"])
        return let(F.struct(leg(was, day).alias("leg"), city.alias("city")), lambda x: after(was, day, x["leg"], x["city"]))

    return ~F.aggregate("d", blank, step)["bad"]


def within_sandbox(finer: bool) -> Column:
    """Names are found in their city, flights by number and ends, cars and taxis by a known distance; in the finer form stops, too, and
    no meal or lodging may be missing from a day."""
    kinds = [*MEALS, "attraction", "accommodation", "ground", *(["event"] if finer else [])]
    lost = F.exists("s", lambda s: s["kind"].isin(*kinds) & (s["n"] == 0))

    def astray(day: Column) -> Column:
        ends, number = legs(day, finer)[0], text.flight_number(day["transportation"])
        own = F.filter("s", lambda s: (s["day"] == day["day"]) & (s["kind"] == "flight"))
        found = F.exists(own, lambda s: F.exists(s["items"], lambda r: (r["a"] == ends["origin"]) & (r["b"] == ends["destination"])))
        return given(day["transportation"]) & flies(day["transportation"]) & (number.isNull() | ~F.coalesce(found, F.lit(False)))

    ok = ~lost & ~F.exists("d", astray)
    if finer:
        absent = lambda d: d["breakfast"].isNull() | d["lunch"].isNull() | d["dinner"].isNull() | d["accommodation"].isNull()
        ok &= ~F.exists("d", absent) & stops_known()
    return ok


def not_absent(finer: bool) -> Column:
    """As many days and cities as asked for; no field missing; transports on days of travel, sights and meals on others, a lodging but
    on the last day; half of the slots filled, where a day's number and city count as filled."""
    q, fields = F.col("q"), ["transportation", *MEALS, "attraction", "accommodation", *(["event", "points"] if finer else [])]
    planned = F.size(F.filter("d", lambda d: d["current_city"] != NOT_NEEDED)) == q["days"]
    cities = F.array_distinct(F.transform(of_kind("city"), lambda c: F.coalesce(c["value"], F.lit(""))))
    many = F.size(F.filter(cities, lambda c: c != q["org"])) == q["visiting_city_number"]

    def fault(d: Column) -> Column:
        city, no = d["current_city"], lambda c: d[c].isin("", "-")
        travels = city.contains("from ")
        bad = (travels | city.contains("to ")) & no("transportation")
        bad |= ~travels & ~city.contains(" to ") & no("attraction")
        bad |= (d["day"] != q["days"]) & no("accommodation")
        bad |= (no("breakfast") | no("lunch") | no("dinner")) & ~travels
        for c in fields:
            bad |= d[c].isNull()
        if finer:
            infos = F.transform(F.filter(F.split(d["points"], ";"), lambda p: p.contains("nearest transit:")), lambda p: F.trim(F.get(F.split(p, "nearest transit:"), F.lit(1))))
            far = lambda i: F.trim(F.substring_index(fine.after_last_comma(i), "m", 1))
            bad |= no("points") | F.exists(infos, lambda i: i.contains(",") & far(i).isin("", "-"))
        return F.coalesce(bad, F.lit(True))

    full = lambda d: sum((given(d[c]).cast("int") for c in ["current_city", *fields]), F.lit(1))
    filled = F.aggregate("d", F.lit(0), lambda n, d: n + full(d))
    return planned & starts_well() & many & ~F.exists("d", fault) & (filled * 2 >= q["days"] * len(fields))


def meal_gaps(least: float = 4.0) -> Column:
    """fine.meal_gaps on one plan's days."""

    def bad(d: Column) -> Column:
        return let(fine.meals_apart([d[m] for m in MEALS], d["points"], least), lambda m: F.exists(F.concat(m["unread"], m["close"]), lambda x: x))

    return ~F.exists("d", bad)


def poi_sequence() -> Column:
    """fine.poi_sequence on one plan's days. The lodging loses a part after a comma on each day that repeats it, and the departure counts
    on the last day of the whole plan."""
    blank = F.struct(F.lit("abc").alias("home"), F.lit(None).cast("string").alias("before"), F.lit(False).alias("bad"))

    def step(was: Column, day: Column) -> Column:
        home = fine.before_last_comma(F.when(day["accommodation"] != "-", day["accommodation"]).otherwise(was["home"]))
        return let(home, lambda h: at_home(was, day, h))

    def at_home(was: Column, day: Column, home: Column) -> Column:
        new = day["accommodation"] != "-"
        inside = lambda x: F.coalesce(day["points"].contains(x), F.lit(False))
        points = F.split(day["points"], ";")
        first, last = F.get(points, F.lit(0)), F.try_element_at(points, F.lit(-1))
        n, i, before = F.col("q.days"), day["day"], was["before"]
        moves = ((n == 7) & i.isin(3, 5)) | ((n == 5) & (i == 3))
        bad = moves & F.coalesce(before != "", F.lit(False)) & ~(first.contains(before) & last.contains(home))
        bad |= ~n.isin(5, 7) & ~(first.contains(home) & (~new | last.contains(home)))
        bad |= F.exists(fine.items(day["event"]), lambda x: inside(fine.before_last_comma(x)))
        bad |= F.exists(fine.items(day["attraction"]), lambda x: ~inside(fine.before_last_comma(x)))
        for m in MEALS:
            bad |= given(day[m]) & ~inside(fine.before_last_comma(day[m]))
        low = F.lower(day["transportation"])
        timed = low.contains("flight") & low.contains("departure") & low.contains("arrival")
        arrival, departure = (fine.minutes_of(F.regexp_extract(day["transportation"], rf"{k} Time: ([^,]*)", 1)) for k in ("Arrival", "Departure"))
        lands = (i == 1) | ((n > 3) & (i == 3)) | ((n > 5) & (i == 5))
        bad |= timed & lands & fine.near_flight(first, arrival, r"from (\d{1,2}:\d{2})")
        bad |= timed & (i == F.size("every")) & fine.near_flight(last, departure, r" to (\d{1,2}:\d{2})\s*$")
        return F.struct(home.alias("home"), F.when(new, home).otherwise(before).alias("before"), (was["bad"] | F.coalesce(bad, F.lit(True))).alias("bad"))

    return ~F.aggregate("d", blank, step)["bad"]


def cost_of(q: Column) -> Column:
    """What a plan costs its party; null if a drive has no price. Meals are paid by person, rooms by party, flights by seat, cars by five
    and taxis by four; what isn't found costs nothing."""
    people = q["people_number"]

    def one(s: Column) -> Column:
        low = F.lower(s["value"])
        drive = F.when(low.contains("self-driving"), F.floor(s["price"] * 0.05) * F.ceil(people / 5)).otherwise(F.floor(s["price"]) * F.ceil(people / 4))
        each = F.when(s["kind"] == "accommodation", s["price"] * F.ceil(people / s["occupancy"])).otherwise(s["price"] * people)
        return F.when(s["kind"] == "fare", drive.cast("double")).otherwise(F.coalesce(each, F.lit(0.0)))

    return F.aggregate(of_kind(*MEALS, "accommodation", "flight", "fare"), F.lit(0.0), lambda total, s: total + one(s))


def no_lodging(wish: Column, broken: Callable[[Column], Column]) -> Column:
    """Null without the wish; else whether no lodging that is found breaks it."""
    return F.when(wish.isNotNull(), ~F.exists(of_kind("accommodation"), lambda s: (s["n"] > 0) & F.coalesce(broken(s), F.lit(False))))


def room_rule() -> Column:
    rules = F.create_map(*(F.lit(x) for kv in constraints.FORBIDDEN.items() for x in kv))
    wish = F.col("q.house_rule")
    return no_lodging(wish, lambda s: s["words"].contains(F.try_element_at(rules, wish)))


def room_type(rooms: dict[str, list[str]]) -> Column:
    wish = F.col("q.room_type")

    def broken(s: Column) -> Column:
        out = F.lit(False)
        for name, kinds in rooms.items():
            out = F.when(wish == name, ~s["room"].isin(*kinds)).otherwise(out)
        return out

    return no_lodging(wish, broken)


def transport_ban() -> Column:
    wish = F.col("q.transportation")
    used = lambda t: F.when(wish == "no flight", t.contains("Flight")).when(wish == "no self-driving", t.contains("Self-driving"))
    return F.when(wish.isNotNull(), ~F.exists("d", lambda d: given(d["transportation"]) & F.coalesce(used(d["transportation"]), F.lit(False))))


def answered(wishes: Column, has: Callable[[Column], Column]) -> Column:
    """Null without wishes; else whether each is answered."""
    return F.when(F.size(wishes) > 0, F.size(F.array_distinct(F.filter(wishes, lambda w: F.coalesce(has(w), F.lit(False))))) == F.size(wishes))


def cuisine() -> Column:
    """A meal in the city of origin hides the rest of its day's meals."""
    meals = of_kind(*MEALS)
    hidden = lambda s: F.exists(meals, lambda t: (t["day"] == s["day"]) & (t["place"] <= s["place"]) & (t["y"] == F.col("q.org")))
    return answered(F.col("q.cuisine"), lambda w: F.exists(meals, lambda s: (s["n"] > 0) & s["words"].contains(w) & ~hidden(s)))


def attraction_type() -> Column:
    return answered(F.col("q.attraction"), lambda w: F.exists(of_kind("attraction"), lambda s: (s["n"] > 0) & s["words"].contains(w) & (s["y"] != F.col("q.org"))))


def event_type() -> Column:
    """An event's segment is that of its first row between the dates asked for."""
    dates = F.col("q.dates")
    during = lambda s: F.filter(s["items"], lambda e: e["b"].between(F.get(dates, F.lit(0)), F.try_element_at(dates, F.lit(-1))))
    return answered(F.col("q.event"), lambda w: F.exists(of_kind("event"), lambda s: F.get(during(s), F.lit(0))["a"] == w))


def checked(days: DataFrame, queries: DataFrame, box: Sandbox) -> DataFrame:
    """A row per query: plan, level, days, delivered, gate, the soft checks (null unless delivered), the hard ones (null unless the gate
    is open; null without the wish), cost, and wished: the hard checks whose wish is stated. The gate is open for delivered plans
    that are complete and within the sandbox. In the finer form a plan of fewer than three days isn't delivered."""
    finer = box.finer
    soft = {"reasonable_city": reasonable_city(), "restaurants": all_different(F.transform(of_kind(*MEALS), lambda s: s["value"])), "attractions": all_different(F.transform(of_kind("attraction"), lambda s: s["value"])), "transport": transport(), "within_city": within_city(finer), "within_sandbox": within_sandbox(finer), "not_absent": not_absent(finer)}
    hard = {"room_rule": room_rule(), "cuisine": cuisine(), "room_type": room_type(constraints.FINE_ROOMS if finer else constraints.ROOMS), "transport_ban": transport_ban()}
    if finer:
        soft |= {"events": all_different(F.transform(of_kind("event"), lambda s: s["value"])), "meal_gaps": meal_gaps(), "poi_sequence": poi_sequence()}
        hard |= {"event_type": event_type(), "attraction_type": attraction_type()}
    else:
        soft["minimum_nights"] = minimum_nights()
    rows = folded(days, queries, box)
    rows = rows.withColumn("delivered", F.size("every") > (2 if finer else 0))
    order = FINE_SOFT if finer else SOFT
    rows = rows.select("*", *(F.when(F.col("delivered"), F.coalesce(soft[c], F.lit(False))).alias(c) for c in order), cost_of(F.col("q")).alias("total"))
    rows = rows.withColumn("gate", F.coalesce(F.col("not_absent") & F.col("within_sandbox"), F.lit(False)))
    hard["cost"] = F.coalesce(F.col("total") <= F.col("q.budget"), F.lit(False))
    judged = [F.when(F.col("gate"), hard[c]).alias(c) for c in (FINE_HARD if finer else HARD)]
    wished = F.array_compact(F.array(*(F.when(F.col(f"q.{w}").isNotNull(), F.lit(c)) for c, w in WISHES.items() if finer or c not in ("event_type", "attraction_type"))))
    return rows.select("plan", "q.level", "q.days", "delivered", "gate", *order, *judged, F.col("total").alias("plan_cost"), wished.alias("wished"))


def detail(checks: DataFrame, finer: bool = False) -> DataFrame:
    """level, days, check, hard, passed, failed, total: what is counted of each check among the plans of a level and number of days. Total
    is all its plans, or for a wish those that state it, where a plan was judged by the check at all and the level counts it; else 0."""
    soft, hard = (FINE_SOFT, FINE_HARD) if finer else (SOFT, HARD)
    one = lambda c, h: F.struct(F.lit(c).alias("check"), F.lit(h).alias("hard"), F.col(c).alias("ok"), (F.col("gate") if h else F.col("delivered")).alias("judged"), (F.array_contains("wished", c) if c in WISHES else F.lit(True)).alias("asked"))
    rows = checks.select("level", "days", F.explode(F.array(*(one(c, False) for c in soft), *(one(c, True) for c in hard))).alias("o")).select("level", "days", "o.*")
    counts = rows.groupBy("level", "days", "check", "hard").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("asked").alias("_n"), F.bool_or("judged").alias("_j"))
    counted = ~F.col("check").isin(*WISHES)
    for level, names in COUNTED.items():
        counted |= (F.col("level") == level) & F.col("check").isin(*names)
    return counts.select("level", "days", "check", "hard", "passed", "failed", F.when(F.col("_j") & counted, F.col("_n")).otherwise(0).alias("total"))


def rates(checks: DataFrame, finer: bool = False, sizes: dict[str, int] | None = None) -> DataFrame:
    """One row of six rates. sizes gives published denominators by the rate's name instead of what is counted."""
    soft, hard = (FINE_SOFT, FINE_HARD) if finer else (SOFT, HARD)
    every = lambda names: F.forall(F.array(*names), lambda c: F.coalesce(c, F.lit(True)))
    good, meets = F.col("gate") & every(soft), F.col("gate") & every(hard)
    passed = lambda names: sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in names), F.lit(0))
    sums = {"n": F.count(F.lit(1)), "delivered": F.count_if("delivered"), "soft": F.sum(passed(soft)), "hard": F.sum(passed(hard)), "good": F.count_if(good), "meets": F.count_if(meets), "both": F.count_if(good & meets), "gated": F.count_if("gate")}
    asked = {c: F.count_if(F.array_contains("wished", c)) for c in hard if c in WISHES}
    cells = checks.groupBy("level", "days").agg(*(v.alias(k) for k, v in sums.items()), *(v.alias(f"asked_{c}") for c, v in asked.items()))
    wishes = F.lit(0)
    for level, names in COUNTED.items():
        wishes = F.when(F.col("level") == level, sum((F.col(f"asked_{c}") for c in names if c in asked), F.lit(0))).otherwise(wishes)
    soft_n = F.sum(F.when(F.col("delivered") > 0, F.col("n") * len(soft)).otherwise(0))
    hard_n = F.sum(F.when(F.col("gated") > 0, F.col("n") + wishes).otherwise(0))
    total = cells.agg(*(F.sum(k).alias(k) for k in sums), soft_n.alias("soft_n"), hard_n.alias("hard_n"))
    parts = {"delivery": ("delivered", "n"), "soft_micro": ("soft", "soft_n"), "soft_macro": ("good", "n"), "hard_micro": ("hard", "hard_n"), "hard_macro": ("meets", "n"), "final": ("both", "n")}
    under = lambda name, n: F.lit((sizes or {}).get(name)) if name in (sizes or {}) else F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))
    return total.select(*((F.coalesce(a, F.lit(0)) / under(name, F.col(n))).alias(name) for name, (a, n) in ((k, (F.col(x), y)) for k, (x, y) in parts.items())))


def evaluate(days: DataFrame, queries: DataFrame, box: Sandbox, sizes: dict[str, int] | None = None) -> DataFrame:
    """The six rates of plans: delivery, soft_micro, soft_macro, hard_micro, hard_macro, final. Queries without a plan count as not
    delivered, plans without a query aren't looked at. The finer form is judged where the sandbox has stops."""
    return rates(checked(days, queries, box), box.finer, sizes)
