"""Whole evaluations: customers ask for trips of three, five or seven days, and their orders are the days of the plans.

Texts and the sandbox are SQL expressions that Spark and the comparing SQL both read, so both sides judge the same plans. Most days
keep the rules; orders whose number divides by some prime break one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators import evaluate
from sojourn.plans.catalog import Tables, query

LEG = "(case when n = 7 and day > 4 then 3 when n >= 5 and day > 2 then 2 else 1 end)"
MOVES = "(day = 1 or day = n or (n = 5 and day = 3) or (n = 7 and (day = 3 or day = 5)))"
LEAVES = f"(case when day = 1 then plan when day = n then plan + {LEG} else plan + {LEG} - 1 end) % 5"
COMES = f"(case when day = n and day > 1 then plan else plan + {LEG} end) % 5"
HERE = f"(plan + {LEG}) % 5"
ENDS = f"'from c', {LEAVES}, ' to c', {COMES}"
STAYS = f"'from c', {HERE}, ' to c', {HERE}"
MEAL = {"breakfast": "(day * 3 + plan) % 23", "lunch": "case when k % 37 = 0 then 99 when k % 41 = 0 then (day * 3 + plan) % 23 else (day * 3 + 1 + plan) % 23 end", "dinner": "(day * 3 + 2 + plan) % 23"}
SIGHTS = "case when k % 53 = 0 then 16 else (day * 2 + plan) % 16 end", "(day * 2 + 1 + plan) % 16"
FLIGHT = "case when k % 59 = 0 then 9 else k % 7 end"
FLOWN = f"concat('Flight Number: F', {FLIGHT}, ', {{}}, Departure Time: 2', case when k % 31 = 0 then '2' else '3' end, ':10, Arrival Time: 0', case when k % 29 = 0 then '7:50' else '6:20' end)"
EVENT = "case when k % 35 = 0 then 9 else k % 3 end"
LODGE = f"'L', (plan + {LEG}) % 5"
STOP = "case when k % 2 = 0 then concat(', nearest transit: Stop', k % 5, ', ', (k % 9) * 50 + case when k % 61 = 0 then 20 else 0 end, case when k % 71 = 0 then '' else 'm away' end) else '' end"
CLOCK = {"breakfast": "case when k % 47 = 0 then 'nine to ten' else '09:00 to 10:00' end", "lunch": "case when k % 43 = 0 then '13:30 to 14:30' else '14:00 to 15:00' end", "dinner": "'19:00 to 20:00'"}


def transportation(finer: bool) -> str:
    ends = f"from c', {LEAVES}, ' to c', {COMES}, '"
    flown = FLOWN.format(ends)
    stay = f"case when plan % 4 = 1 then concat('Self-driving, ', {STAYS}) else concat('Taxi, ', {STAYS}) end" if finer else "'-'"
    return f"case when {MOVES} then case when k % 67 = 0 then '-' when plan % 4 = 1 then concat('Self-driving, ', {ENDS}) when plan % 4 = 2 then concat('Taxi, ', {ENDS}) else {flown} end else {stay} end"


def texts(finer: bool) -> dict[str, str]:
    meal = lambda m: f"concat('R', {MEAL[m]}, ', c', {HERE})"
    stay = f"concat('from c', {HERE}, ' to c', {HERE})" if finer else f"concat('c', {HERE})"
    out = {
        "current_city": f"case when {MOVES} then concat({ENDS}) when k % 73 = 0 then 'c3' else {stay} end",
        "transportation": transportation(finer),
        "breakfast": f"case when k % 79 = 0 then '-' else {meal('breakfast')} end",
        "lunch": meal("lunch"),
        "dinner": f"case when k % 83 = 0 then '' else {meal('dinner')} end",
        "attraction": f"case when k % 89 = 0 then '-' else concat('A', {SIGHTS[0]}, ', c', {HERE}, ';A', {SIGHTS[1]}, ', c', {HERE}{'' if finer else ', chr(59)'}) end",
        "accommodation": f"case when day = n then '-' when k % 97 = 0 then '' else concat({LODGE}, ', c', case when k % 101 = 0 then (plan + 4) % 5 else {HERE} end) end",
    }
    if finer:
        before = f"'L', (plan + {LEG} - case when (n = 5 and day = 3) or (n = 7 and (day = 3 or day = 5)) then 1 else 0 end) % 5"
        spot = lambda m: f"';R', {MEAL[m]}, ', visit from ', {CLOCK[m]}"
        out["event"] = f"case when k % 5 = 0 then concat('E', {EVENT}, ', c', {HERE}) else '-' end"
        out["points"] = f"case when k % 103 = 0 then '-' else concat({before}, ', stay from 08:00 to 08:30', {spot('breakfast')}, {STOP}, ';A', {SIGHTS[0]}, ', visit from 12:00 to 13:00;A', {SIGHTS[1]}, ', visit from 13:00 to 13:20', {spot('lunch')}, {spot('dinner')}, case when k % 25 = 0 then concat(';E', {EVENT}, ', visit from 20:00 to 21:00') else '' end, ';', {LODGE}, ', stay from 21:00 to 22:00') end"
    return out


ASKED = {
    "days": "case when n is null then 3 when plan % 23 = 0 then n + 2 else n end",
    "level": "case when plan % 9 < 3 then 'easy' when plan % 9 < 6 then 'medium' else 'hard' end",
    "org": "concat('c', plan % 5)",
    "dest": "case when plan % 8 = 0 then 's1' else 's0' end",
    "visiting_city_number": "case when n = 7 then 3 when n = 5 then 2 else 1 end",
    "people_number": "1 + plan % 5",
    "budget": "1500.0 + plan * 37 % 9000",
    "house_rule": "case when plan % 9 < 3 then null when plan % 2 = 0 then 'smoking' when plan % 5 = 0 then 'pets' when plan % 7 = 0 then 'visitors' end",
    "room_type": "case when plan % 9 < 3 then null when plan % 4 = 1 then 'shared room' when plan % 4 = 2 then 'not shared room' when plan % 4 = 3 then 'entire room' end",
    "transportation": "case when plan % 9 < 3 then null when plan % 7 = 1 then 'no flight' when plan % 7 = 2 then 'no self-driving' end",
}
WISHED = {"cuisine": ("K", 3), "event": ("segment ", 3), "attraction": ("T", 3)}
WISHES = "plan % 9 >= 3 and plan % 4 > 0"
PLACES = {"restaurant": ("R", 23, 23), "attraction": ("A", 17, 16), "event": ("E", 4, 3)}
FIFTH = "cast(floor(n_nationkey / 5) as bigint)"
SANDBOX = {
    "lodgings": ("nation", {"row_id": "n_nationkey", "name": "concat('L', n_nationkey % 5)", "city": f"concat('c', {FIFTH})", "price": "20 + n_nationkey * 13", "occupancy": "1 + n_nationkey % 4", "minimum_nights": "case when n_nationkey % 13 = 0 then 3 else 1 end", "house_rules": "case n_nationkey % 3 when 0 then 'No smoking' when 1 then 'No pets & No parties' else '' end"}),
    "flights": ("part", {"row_id": "p_partkey", "flight_number": "concat('F', p_partkey % 7)", "origin": "concat('c', p_partkey % 5)", "dest": "concat('c', (p_partkey % 5 + 1 + p_partkey % 4) % 5)", "price": "p_size"}),
    "distances": ("nation", {"origin": "concat('c', n_nationkey % 5)", "destination": f"concat('c', {FIFTH})", "km": "case when n_nationkey % 17 <> 5 then n_nationkey * 37.0 + 50 end"}),
    "states": ("nation", {"city": "concat('c', n_nationkey)", "state": "case when n_nationkey = 0 then 's1' else 's0' end"}),
    "stops": ("part", {"poi": "concat('R', p_partkey % 23)", "city": "concat('c', p_partkey % 5)", "stop": "'Stop0 Stop1 Stop2 Stop3 Stop4'", "stop_distance": "(p_partkey % 9) * 50.0 + 3"}),
}
KINDS = ("Shared room", "Private room", "Entire home/apt"), ("shared_room", "private_room", "entire_room")
KEPT = {"states": "n_nationkey < 5"}


def room(finer: bool) -> str:
    a, b, c = KINDS[finer]
    return f"case when n_nationkey % 4 = 0 then '{a}' when n_nationkey % 4 = 1 then '{b}' else '{c}' end"


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in columns.items())


DAYS = "case when n0 >= 7 then 7 when n0 >= 5 then 5 when n0 >= 3 then 3 else n0 end"
MORE = "case when plan % 19 = 0 then 1 else 0 end"


def numbered(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_custkey as plan", "cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as day", "count(*) over (partition by o_custkey) as n0", "o_orderkey as k")
    return rows.selectExpr("plan", "day", f"{DAYS} as n", "k").where(f"day <= n + {MORE}")


def days(t: Tables, finer: bool) -> DataFrame:
    """Days of plans; a few plans have a day more than was asked for."""
    return numbered(t).selectExpr("plan", "day", *(f"{v} as {k}" for k, v in texts(finer).items()))


def asked(t: Tables) -> DataFrame:
    """One query per customer; wishes of cuisines, events and attractions are lists of one or two."""
    rows = t.customer.select(F.col("c_custkey").alias("plan")).join(numbered(t).select("plan", "n").distinct(), "plan", "left").selectExpr("plan", *(f"{v} as {k}" for k, v in ASKED.items()))
    wish = lambda prefix, m: F.when(F.expr(WISHES), F.transform(F.sequence(F.lit(0), F.col("plan") % 2), lambda i: F.concat(F.lit(prefix), ((F.col("plan") + i) % m).cast("string"))))
    return rows.select("*", *(wish(*p).alias(k) for k, p in WISHED.items()), F.array(F.lit("2024-01-06"), F.lit("2024-01-20"), F.lit("2024-02-10")).alias("dates"))


def sandbox(t: Tables, finer: bool) -> evaluate.Sandbox:
    def place(kind: str) -> DataFrame:
        c, m, top = PLACES[kind]
        return t.part.where(f"p_partkey % {m} < {top}").selectExpr("p_partkey as row_id", f"concat('{c}', p_partkey % {m}) as name", "concat('c', p_partkey % 5) as city", "p_size as price")

    table = lambda name: getattr(t, SANDBOX[name][0]).where(KEPT.get(name, "true")).selectExpr(*(f"{v} as {k}" for k, v in SANDBOX[name][1].items()))
    kind = lambda c: F.concat(F.lit(c), (F.col("row_id") % 3).cast("string"))
    lodgings = t.nation.selectExpr(*(f"{v} as {k}" for k, v in SANDBOX["lodgings"][1].items()), f"{room(finer)} as room_type")
    more = {}
    if finer:
        date = F.date_add(F.lit("2024-01-01").cast("date"), F.col("price")).cast("string")
        more = {"events": place("event").select("row_id", "name", "city", date.alias("date"), kind("segment ").alias("segment")), "stops": table("stops")}
    restaurants, attractions = (place(k).withColumn(c, F.concat_ws(", ", F.lit(first), kind(own))) for k, c, first, own in (("restaurant", "cuisines", "Tea", "K"), ("attraction", "subcategories", "Park", "T")))
    return evaluate.Sandbox(restaurants, lodgings, attractions, table("flights"), table("distances"), table("states"), **more)


def checks(t: Tables, finer: bool) -> DataFrame:
    return evaluate.checked(days(t, finer), asked(t), sandbox(t, finer))


def given(c: str) -> str:
    return f"coalesce({c} not in ('', '-'), false)"


def parts(finer: bool) -> list[str]:
    """The SQL's tables: r numbered days, d texts, q queries, x days asked for, s slots with the first of their matches, c the route."""
    place = lambda kind, more: f"select p_partkey as row_id, '{kind}' as kind, concat('{PLACES[kind][0]}', p_partkey % {PLACES[kind][1]}) as name, concat('c', p_partkey % 5) as city, p_size as price, null as occupancy, null as minimum_nights, {more} as words, null as room_type, p_size as size from part where p_partkey % {PLACES[kind][1]} < {PLACES[kind][2]}"
    wish = lambda prefix, m: f"case when {WISHES} then list_transform(range(0, 1 + plan % 2), lambda i: concat('{prefix}', (plan + i) % {m})) end"
    sights = "string_split(attraction, ';')" + ("" if finer else "[:-2]")
    slots = [f"select plan, day, {i} as place, 'restaurant' as kind, {m} as v from x where {given(m)}" for i, m in enumerate(evaluate.MEALS)]
    slots.append(f"select plan, day, 3, 'attraction', unnest({sights}) from x where {given('attraction')}")
    if finer:
        slots.append(f"select plan, day, 5, 'event', event from x where {given('event')}")
    slots.append(f"select plan, day, 9, 'accommodation', accommodation from x where {given('accommodation')}")
    entities = [place("restaurant", "concat('Tea, K', p_partkey % 3)"), place("attraction", "concat('Park, T', p_partkey % 3)"), f"select row_id, 'accommodation', name, city, price, occupancy, minimum_nights, house_rules, room_type, null from {table('lodgings', f', {room(finer)} as room_type')}"]
    if finer:
        entities.append(place("event", "concat('segment ', p_partkey % 3)"))
    return [
        f"r as (select plan, day, n, k from (select plan, day, {DAYS} as n, k from (select o_custkey as plan, row_number() over (partition by o_custkey order by o_orderkey) as day, count(*) over (partition by o_custkey) as n0, o_orderkey as k from orders)) where day <= n + {MORE})",
        f"d as (select plan, day, n, k, {listed(texts(finer))} from r)",
        f"q as (select plan, {listed(ASKED)}, {', '.join(f'{wish(*p)} as {k}' for k, p in WISHED.items())} from (select c_custkey as plan from customer) left join (select distinct plan, n from r) using (plan))",
        "x as (select d.*, q.days, q.org, q.dest, q.people_number, q.visiting_city_number from d join q using (plan) where day <= q.days)",
        f"s0 as ({' union all '.join(slots)})",
        "s1 as (select *, string_split(v, ', ')[1] as name, string_split(v, ', ')[2] as city from s0)",
        f"e as ({' union all '.join(entities)})",
        "s as (select s1.plan, s1.day, s1.place, s1.kind, s1.v, s1.city, count(e.row_id) as m, arg_min(e.price, e.row_id) as price, arg_min(e.occupancy, e.row_id) as occupancy, arg_min(e.minimum_nights, e.row_id) as nights, arg_min(e.words, e.row_id) as words, arg_min(e.room_type, e.row_id) as room, arg_min(e.words, e.row_id) filter (e.size between 5 and 40) as dated from s1 left join e on e.kind = s1.kind and e.city = s1.city and contains(e.name, s1.name) group by all)",
        f"f as {table('flights')}",
        f"g as (select * from {table('distances')} where km is not null)",
        "c as (select plan, day, 0 as i, case when current_city like 'from%' then substr(current_city, 6, 2) else current_city end as city from x union all select plan, day, 1, right(current_city, 2) from x where current_city like 'from%')",
        "i as (select plan, g, city, count(*) as m from (select *, sum(fresh) over (partition by plan order by day, i) as g from (select *, case when lag(city) over (partition by plan order by day, i) = city then 0 else 1 end as fresh from c)) group by 1, 2, 3)",
        "w as (select plan, max(g) as top, sum(m) as entries, arg_min(city, g) as first, arg_max(city, g) as last from i group by 1)",
        "starts as (select plan from x where day = 1 and current_city like 'from%' and substr(current_city, 6, 2) <> org)",
        "middle as (select plan, city from (select *, row_number() over (partition by plan order by day, i) as a, count(*) over (partition by plan) as b from c) where a > 1 and a < b)",
    ]


def bad(finer: bool) -> dict[str, str]:
    """SQL of the plans that break each soft check."""
    fields = ["transportation", *evaluate.MEALS, "attraction", "accommodation", *(["event", "points"] if finer else [])]
    full = " + ".join(f"cast({given(c)} as int)" for c in ["current_city", *fields])
    state = "case when city = 'c0' then 's1' else 's0' end"
    ends = "substr(current_city, 6, 2)", "right(current_city, 2)"
    out = {
        "reasonable_city": f"from starts union select plan from w where first <> last or entries < 3 union select plan from i join w using (plan) where g > 1 and g < top and (m = 1 or city = first or city = last) union select plan from i join w using (plan) where g > 1 and g < top group by plan having count(*) <> count(distinct city) union select a.plan from i a join w using (plan) join i b using (plan) where a.g = top and a.m > 1 and b.g < top and b.city = a.city union select plan from middle join q using (plan) where days > 3 and {state} <> dest",
        "restaurants": "select plan from s0 where kind = 'restaurant' group by plan, v having count(*) > 1",
        "attractions": "select plan from s0 where kind = 'attraction' group by plan, v having count(*) > 1",
        "transport": f"select plan from d where day = 1 and not {given('transportation')} union select plan from x group by plan having bool_or(contains(transportation, 'Self-driving')) and bool_or(contains(transportation, 'Flight') or contains(transportation, 'Taxi'))",
        "not_absent": f"select q.plan from q left join x using (plan) group by q.plan, q.days having count(x.day) <> q.days union from starts union select c.plan from c join q using (plan) group by c.plan, visiting_city_number having count(distinct case when city <> org then city end) <> visiting_city_number union select plan from x where (current_city like 'from %' and transportation = '-') or (current_city not like 'from %' and attraction = '-') or (day <> days and accommodation in ('', '-')) or ((breakfast = '-' or dinner = '') and current_city not like 'from %'){' or points = ' + chr(39) + '-' + chr(39) if finer else ''} union select plan from x group by plan, days having sum(1 + {full}) * 2 < days * {len(fields)}",
    }
    own = ["regexp_extract(transportation, 'from (c\\d) to (c\\d)', 1)", "regexp_extract(transportation, 'from (c\\d) to (c\\d)', 2)"]
    at = [f"case when current_city like 'from%' then {e} else {{}} end" for e in ends]
    flown = [a.format(o) for a, o in zip(at, own)] if finer else own
    driven = [a.format("'-'") for a in at] if finer else own
    out["within_sandbox"] = f"select plan from s where m = 0 union select plan from x where contains(transportation, 'Flight') and (concat('F', {FLIGHT}), {', '.join(flown)}) not in (select (flight_number, origin, dest) from f) union select plan from x where regexp_matches(transportation, 'Self-driving|Taxi') and ({', '.join(driven)}) not in (select (origin, destination) from g)"
    if not finer:
        letters = "case when current_city like 'from%' then [{0}, {1}] else string_split(current_city, '') end".format(*ends)
        any_of = lambda v: f"len(list_filter({letters}, lambda a: contains({v}, a))) = 0"
        lost_city = f"select plan from x where ({given('transportation')} and len(list_filter({letters}, lambda a: not contains(transportation, a))) > 0) or ({given('accommodation')} and not contains(accommodation, ({letters})[-1]))"
        lost_city += "".join(f" or ({given(m)} and {any_of(m)})" for m in evaluate.MEALS) + f" or ({given('attraction')} and {any_of('string_split(attraction, chr(59))[1]')}) or ({given('attraction')} and {any_of('string_split(attraction, chr(59))[2]')})"
        out["within_city"] = lost_city
        out["minimum_nights"] = "select r.plan from (select plan, accommodation as v, count(*) as nights from (select *, row_number() over (partition by plan order by day) - row_number() over (partition by plan, accommodation order by day) as g from x) group by plan, accommodation, g) r join (select distinct plan, v, m, nights from s where kind = 'accommodation') s using (plan, v) where s.m = 1 and r.nights < s.nights"
        return out
    any_city = "not contains({0}, " + ends[0] + ") and not contains({0}, " + ends[1] + ")"
    out["within_city"] = f"select plan from x where not current_city like 'from%' or (contains(transportation, 'Flight') and (not contains(transportation, {ends[0]}) or not contains(transportation, {ends[1]}))) or ({given('accommodation')} and not contains(accommodation, {ends[1]}))" + "".join(f" or ({given(m)} and {any_city.format(m)})" for m in (*evaluate.MEALS, "attraction"))
    out["events"] = "select plan from s0 where kind = 'event' group by plan, v having count(*) > 1"
    out |= {"meal_gaps": "from close", "poi_sequence": "from poi", "within_sandbox": out["within_sandbox"] + " union from lost_stops"}
    return out


def finer_parts() -> list[str]:
    """SQL tables of plans whose meals are too close, whose points are out of order, and whose stops aren't known."""
    spot = lambda m: f"list_filter(string_split(points, ';'), lambda v: v not in ('', '-') and contains(v, string_split({m}, ', ')[1]))[1]"
    hour = lambda v: f"try_cast(trim(string_split({v}, ':')[1]) as int) + try_cast(trim(string_split({v}, ':')[2]) as int) / 60::double"
    said = ", ".join(f"case when {m} <> '-' then {spot(m)} end as {m[0]}" for m in evaluate.MEALS)
    read = ", ".join(f"{hour(f'string_split(string_split({m[0]}, {chr(39)}from{chr(39)})[2], {chr(39)}to{chr(39)})[1]')} as {m[0]}1, {hour(f'string_split(string_split(string_split({m[0]}, {chr(39)}from{chr(39)})[2], {chr(39)}to{chr(39)})[2], {chr(39)},{chr(39)})[1]')} as {m[0]}2" for m in evaluate.MEALS)
    broken = " or ".join(f"({m[0]} is not null and ({m[0]}1 is null or {m[0]}2 is null))" for m in evaluate.MEALS)
    last = "last_value(case when accommodation <> '-' then string_split(accommodation, ', ')[1] end ignore nulls) over (partition by plan order by day"
    moving = "((days = 7 and day in (3, 5)) or (days = 5 and day = 3))"
    within = " or ".join(f"({given(m)} and not contains(points, string_split({m}, ', ')[1]))" for m in evaluate.MEALS)
    sights = " or ".join(f"not contains(points, concat('A', {v}))" for v in SIGHTS)
    second = lambda c: f"string_split({c}, ', ')[2]"
    named = ", ".join(f"case when {given(c)} then {second(v)} end" for c, v in (("accommodation", "accommodation"), ("event", "event"), ("attraction", "string_split(attraction, ';')[2]"), ("dinner", "dinner"), ("lunch", "lunch")))
    leg = lambda end, i: f"last_value(case when {given('transportation')} then case when current_city like 'from%' then {end} when contains(transportation, 'Flight') then regexp_extract(transportation, 'from (c\\d) to (c\\d)', {i}) else '-' end end ignore nulls) over (partition by plan order by day)"
    return [
        f"close as (select plan from (select *, {read} from (select plan, {said} from x)) where {broken} or l1 - b2 < 4 or d1 - l2 < 4)",
        f"turns as (select *, coalesce({last}), 'abc') as home, {last} rows between unbounded preceding and 1 preceding) as before, string_split(points, ';') as t, total from x join (select plan, count(*) as total from d group by 1) using (plan))",
        f"poi as (select plan from turns where ({moving} and coalesce(before, '') <> '' and not (contains(t[1], before) and contains(t[-1], home))) or (days not in (5, 7) and not (contains(t[1], home) and (accommodation = '-' or contains(t[-1], home)))) or (event <> '-' and contains(points, string_split(event, ', ')[1])) or (attraction <> '-' and ({sights})) or {within} or (points <> '-' and contains(transportation, 'Flight') and (((day = 1 or (days > 3 and day = 3) or (days > 5 and day = 5)) and k % 29 = 0) or (day = total and k % 31 = 0))))",
        f"legs as (select *, {leg('substr(current_city, 6, 2)', 1)} as a, {leg('right(current_city, 2)', 2)} as b, coalesce({named}) as spot from x)",
        f"lost_stops as (select plan from legs where k % 2 = 0 and points <> '-' and days in (3, 5, 7) and not exists (select 1 from {table('stops')} p where p.poi = concat('R', {MEAL['breakfast']}) and contains(p.stop, concat('Stop', legs.k % 5)) and abs(p.stop_distance - ((legs.k % 9) * 50 + case when legs.k % 61 = 0 then 20 else 0 end)) <= 5 and p.city in (case when {moving} then a when day = days then case when current_city like 'from%' then substr(current_city, 6, 2) else current_city end else spot end, case when {moving} then b else '' end)))",
    ]


def table(name: str, more: str = "") -> str:
    return f"(select {listed(SANDBOX[name][1])}{more} from {SANDBOX[name][0]} where {KEPT.get(name, 'true')})"


RULES = "case house_rule when 'smoking' then 'No smoking' when 'pets' then 'No pets' else 'No visitors' end"


def hard(finer: bool) -> dict[str, str]:
    """SQL of each hard check by plan, over p (plan and its query)."""
    shared, _, entire = KINDS[finer]
    kinds = f"case p.room_type when 'shared room' then s.room <> '{shared}' when 'not shared room' then s.room = '{shared}' else s.room <> '{entire}' end"
    meals = "s.plan = p.plan and s.kind = 'restaurant' and s.m > 0 and contains(s.words, u.w) and not exists (select 1 from s h where h.plan = s.plan and h.day = s.day and h.kind = 'restaurant' and h.place <= s.place and h.city = p.org)"
    every = lambda wish, has: f"case when p.{wish} is not null then not exists (select 1 from (select unnest(p.{wish}) as w) u where not exists (select 1 from s where {has})) end"
    out = {
        "cost": "coalesce(z.cost <= p.budget, false)",
        "room_rule": f"case when house_rule is not null then not exists (select 1 from s where s.plan = p.plan and s.kind = 'accommodation' and s.m > 0 and contains(s.words, {RULES})) end",
        "cuisine": every("cuisine", meals),
        "room_type": f"case when p.room_type is not null then not exists (select 1 from s where s.plan = p.plan and s.kind = 'accommodation' and s.m > 0 and {kinds}) end",
        "transport_ban": "case when p.transportation is not null then not exists (select 1 from x where x.plan = p.plan and contains(x.transportation, case p.transportation when 'no flight' then 'Flight' else 'Self-driving' end)) end",
    }
    if finer:
        out["event_type"] = every("event", "s.plan = p.plan and s.kind = 'event' and s.dated = u.w")
        out["attraction_type"] = every("attraction", "s.plan = p.plan and s.kind = 'attraction' and s.m > 0 and contains(s.words, u.w) and s.city <> p.org")
    return out


COSTS = r"""z as (select plan, case when bool_and(cost is not null) then sum(cost) end as cost from (
  select plan, case when m = 0 then 0 when kind = 'accommodation' then price * ceil(people_number / occupancy) else price * people_number end as cost from s join q using (plan) where kind in ('restaurant', 'accommodation')
  union all select plan, coalesce((select arg_min(price, row_id) from f where flight_number = concat('F', {flight})), 0) * people_number from x where contains(transportation, 'Flight')
  union all select x.plan, case when contains(transportation, 'Self') then floor(km * 0.05) * ceil(people_number / 5) else floor(km) * ceil(people_number / 4) end from x left join g on g.origin = regexp_extract(transportation, 'from (c\d) to (c\d)', 1) and g.destination = regexp_extract(transportation, 'from (c\d) to (c\d)', 2) where regexp_matches(transportation, 'Self-driving|Taxi')) group by 1)"""


def checks_sql(finer: bool) -> str:
    """SQL of a row per query with every check."""
    soft, names = bad(finer), (evaluate.FINE_SOFT if finer else evaluate.SOFT)
    tables = [*parts(finer), *(finer_parts() if finer else []), COSTS.format(flight=FLIGHT)]
    least = 2 if finer else 0
    tables.append(f"o as (select q.*, coalesce(t.n > {least}, false) as delivered, {', '.join(f'q.plan not in ({soft[c]}) as ok_{c}' for c in names)} from q left join (select plan, count(*) as n from d group by 1) t using (plan))")
    tables.append("p as (select *, delivered and ok_not_absent and ok_within_sandbox as gate from o)")
    judged = [f"case when gate then {v} end as {c}" for c, v in hard(finer).items()]
    wishes = " + ".join(f"({evaluate.WISHES[c]} is not null)::int" for c in hard(finer) if c in evaluate.WISHES)
    return f"with {', '.join(tables)} select p.plan, level, days, delivered, gate, {', '.join(f'case when delivered then ok_{c} end as {c}' for c in names)}, {', '.join(judged)}, round(coalesce(z.cost, case when z.plan is null then 0 end), 2) as plan_cost, {wishes} as wishes, {', '.join(f'{w} is not null as asked_{c}' for c, w in evaluate.WISHES.items())} from p left join z using (plan)"


def rates_sql(finer: bool) -> str:
    soft, judged = (evaluate.FINE_SOFT, evaluate.FINE_HARD) if finer else (evaluate.SOFT, evaluate.HARD)
    every = lambda names: " and ".join(f"coalesce({c}, true)" for c in names)
    passed = lambda names: " + ".join(f"coalesce({c}::int, 0)" for c in names)
    counted = " ".join(f"when level = '{level}' then {' + '.join(f'count_if(asked_{c})' for c in names if c in judged)}" for level, names in evaluate.COUNTED.items())
    cells = f"select level, days, count(*) as n, count_if(delivered) as delivered, count_if(gate) as gated, sum({passed(soft)}) as soft, sum({passed(judged)}) as hard, count_if(gate and {every(soft)}) as good, count_if(gate and {every(judged)}) as meets, count_if(gate and {every(soft)} and {every(judged)}) as complete, case {counted} else 0 end as wishes from ({checks_sql(finer)}) group by level, days"
    return f"select sum(delivered) / sum(n) as delivery, sum(soft) / greatest(sum(case when delivered > 0 then n * {len(soft)} else 0 end), 1) as soft_micro, sum(good) / sum(n) as soft_macro, sum(hard) / greatest(sum(case when gated > 0 then n + wishes else 0 end), 1) as hard_micro, sum(meets) / sum(n) as hard_macro, sum(complete) / sum(n) as final from ({cells})"


def detail_sql(finer: bool) -> str:
    soft, judged = (evaluate.FINE_SOFT, evaluate.FINE_HARD) if finer else (evaluate.SOFT, evaluate.HARD)
    one = lambda c, h: f"select level, days, '{c}' as \"check\", {h} as hard, count(*) filter ({c}) as passed, count(*) filter (not {c}) as failed, case when bool_or({'gate' if h else 'delivered'}) and ({' or '.join([f'level = {chr(39)}{level}{chr(39)}' for level, names in evaluate.COUNTED.items() if c in names]) if c in evaluate.WISHES else 'true'}) then {f'count(*) filter (asked_{c})' if c in evaluate.WISHES else 'count(*)'} else 0 end as total from t group by level, days"
    return f"with t as ({checks_sql(finer)}) " + " union all ".join([*(one(c, False) for c in soft), *(one(c, True) for c in judged)])


def rows(t: Tables, finer: bool) -> DataFrame:
    out = checks(t, finer)
    return out.withColumn("plan_cost", F.round("plan_cost", 2)).withColumn("wishes", F.size("wished")).drop("wished")


def _register(finer: bool) -> None:
    name = "fine_trip" if finer else "trip"
    asked_columns = ", ".join(f"asked_{c}" for c in evaluate.WISHES)
    query(f"{name}_checks", f"select * exclude ({asked_columns}) from ({checks_sql(finer)})")(lambda t: rows(t, finer))
    query(f"{name}_rates", rates_sql(finer))(lambda t: evaluate.evaluate(days(t, finer), asked(t), sandbox(t, finer)))
    query(f"{name}_check_totals", detail_sql(finer))(lambda t: evaluate.detail(checks(t, finer), finer))


for _finer in (False, True):
    _register(_finer)
