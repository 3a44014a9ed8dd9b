"""Searches: exact itineraries, the best combinations of members, nearest points, and groups that a leader and opponents make."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.operators import groups, itineraries, lookup, retrieval
from sojourn.plans import stored
from sojourn.plans.catalog import Tables, query, r6
from sojourn.plans.catalog_more import travellers
from sojourn.plans.preparing import drawn

KINDS = ["outbound", "return", "hotel", "origin_restaurant", "restaurant", "attraction", "hotel", "return"]
KIND = "case l_partkey % 8 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
CANDIDATE = {
    "trip": "o_custkey",
    "kind": KIND,
    "item": "l_orderkey * 10 + l_linenumber",
    "price": "cast(l_quantity as double)",
    "minutes": "case when l_partkey % 8 in (3, 4, 5) then 30 + l_suppkey % 5 * 20 else 0 end",
    "points": "case when l_partkey % 8 in (2, 6) then case when l_suppkey % 3 = 0 then 20 else 0 end when l_partkey % 8 in (0, 1, 7) then 0 when l_suppkey % 3 = 0 then 10 else 1 end",
}
#: Trips of few restaurants and sights last two days, so that SQL can try all ways to deal them.
TRIP = {"days": "case when restaurants <= 5 and sights <= 5 then 2 else 1 end", "budget": "60.0 + trip * 7 % 90 * case when restaurants <= 5 and sights <= 5 then 3 else 1 end", "day_minutes": "case when trip % 3 = 0 then 250 when trip % 3 = 1 then 340 else 600 end"}
ALL = "(select " + ", ".join(f"{v} as {k}" for k, v in CANDIDATE.items()) + " from lineitem join orders on l_orderkey = o_orderkey)"


def _sets(table: str, sizes: list[int], shift: int) -> str:
    """SQL of all choices of so many rows of a table (trip, i, minutes, worth, cost), as masks."""
    out = []
    for n in sizes:
        names = [f"t{k}" for k in range(n)]
        joins = " ".join(f"join {table} {b} on {b}.trip = {a}.trip and {b}.i > {a}.i" for a, b in zip(names, names[1:]))
        mask = " + ".join(f"(1::bigint << ({t}.i + {shift}))" for t in names)
        out.append(f"select t0.trip, {n} as size, {mask} as mask, " + ", ".join(f"{' + '.join(f'{t}.{c}' for t in names)} as {c}" for c in ("minutes", "worth", "cost")) + f" from {table} t0 {joins}")
    return " union all ".join(out)


EXACT = f"""with a as (select *, cast(floor(price * 100) as bigint) as each_, count(*) filter (kind = 'restaurant') over (partition by trip) as restaurants, count(*) filter (kind = 'attraction') over (partition by trip) as sights from {ALL}),
t as (select distinct trip, restaurants, sights, {', '.join(f'{v} as {k}' for k, v in TRIP.items())} from a),
c as (select a.trip, kind, item, minutes, cast(floor(price * case when kind = 'hotel' then days else 1 end * 100) as bigint) as cost, 100 * points - cast(floor(price * case when kind = 'hotel' then days else 1 end * 100) as bigint) as worth, row_number() over (partition by a.trip, kind order by item) - 1 as i from a join t using (trip)),
r as (select * from c where kind = 'restaurant'), v as (select * from c where kind = 'attraction'),
flown as (select trip, kind, min(cost) as cost from c where kind in ('outbound', 'return') group by 1, 2),
rooms as (select trip, worth + cost as points, min(cost) as cost from c where kind = 'hotel' group by 1, 2),
single as (select t.trip, coalesce(o.cost, 0) + coalesce(b.cost, 0) + coalesce(h.cost, 0) + coalesce(e.cost, 0) as cost, coalesce(h.points, 0) + coalesce(e.worth + e.cost, 0) - (coalesce(o.cost, 0) + coalesce(b.cost, 0) + coalesce(h.cost, 0) + coalesce(e.cost, 0)) as worth, coalesce(e.minutes, 0) as minutes, e.minutes is not null as home
  from t left join flown o on o.trip = t.trip and o.kind = 'outbound' left join flown b on b.trip = t.trip and b.kind = 'return' left join rooms h on h.trip = t.trip left join c e on e.trip = t.trip and e.kind = 'origin_restaurant'),
m as ({_sets('r', [2, 3], 0)} union all select trip, -1, 0, 0, 0, 0 from t where restaurants = 0),
w as ({_sets('v', [2, 3, 4], 20)} union all select trip, -1, 0, 0, 0, 0 from t where sights = 0),
d as (select m.trip, m.size, m.mask + w.mask as mask, m.minutes + w.minutes as minutes, m.worth + w.worth as worth, m.cost + w.cost as cost from m join w using (trip)),
p as (select s.trip, s.worth + x.worth as worth from single s join t using (trip) join d x using (trip) where t.days = 1 and x.size in (case when home then 2 else 3 end, -1) and s.minutes + x.minutes <= day_minutes and s.cost + x.cost <= budget * 100
  union all select s.trip, s.worth + x.worth + y.worth from t join d x using (trip) join d y using (trip) join single s using (trip) where t.days = 2 and x.size in (case when home then 2 else 3 end, -1) and y.size in (3, -1) and x.mask & y.mask = 0 and s.minutes + x.minutes <= day_minutes and y.minutes <= day_minutes and s.cost + x.cost + y.cost <= budget * 100)
select t.trip, case when max(worth) is null then 'infeasible' else 'optimal' end as status, max(worth) as worth from t left join p using (trip) group by 1"""


@query("exact_itineraries", EXACT)
def _(t: Tables):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*(f"{v} as {k}" for k, v in CANDIDATE.items()))
    trips = rows.groupBy("trip").agg(F.count_if(F.col("kind") == "restaurant").alias("restaurants"), F.count_if(F.col("kind") == "attraction").alias("sights")).selectExpr("trip", *(f"{v} as {k}" for k, v in TRIP.items()))
    return itineraries.itineraries(rows, trips).select("trip", "status", "worth").distinct()


CHOSEN = "select s_suppkey % 4 as g, s_suppkey as m, 'f' || (i % 3) || '.' || i as field, (s_suppkey * (i + 1)) % 3 as value, case when (s_suppkey + i) % 11 = 0 then 9 else 4 + (s_suppkey * 7 + i) % 5 end as alpha from supplier, range(4) r(i)"


@query("exact_combinations", f"with w as ({CHOSEN}), m as (select distinct g, m from w), k as (select a.g, a.m as a, b.m as b, c.m as c from m a join m b on a.g = b.g and a.m < b.m join m c on b.g = c.g and b.m < c.m), f as (select k.g, a, b, c, field, count_if(alpha >= 9) as h, count(distinct value) filter (alpha >= 9) as hv, count_if(alpha < 9) as n, count(distinct value) filter (alpha < 9) as v, sum(alpha) filter (alpha < 9) as x, sum(alpha * alpha) filter (alpha < 9) as x2 from k join w on w.g = k.g and w.m in (a, b, c) group by 1, 2, 3, 4, 5), t as (select *, h >= 2 and hv > 1 as hard, not (h >= 2 and hv > 1) and n >= 2 and v > 1 as soft from f), z as (select g, a, b, c, round(count_if(soft) + 2.0 * count(distinct split_part(field, '.', 1)) filter (soft) + 0.5 * sqrt(greatest(sum(x2) filter (soft) / sum(n) filter (soft) - power(sum(x) filter (soft) / sum(n) filter (soft), 2), 0)), 9) as score from t group by 1, 2, 3, 4 having count_if(hard) = 0 and count_if(soft) >= 2) select g, round(max(score), 6) as score from z group by 1")
def _(t: Tables):
    k = F.col("s_suppkey")
    rows = t.supplier.select((k % 4).alias("g"), k.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    alpha = F.when((F.col("m") + F.col("i")) % 11 == 0, 9).otherwise(4 + (F.col("m") * 7 + F.col("i")) % 5)
    wishes = rows.select("g", "m", F.concat(F.lit("f"), F.col("i") % 3, F.lit("."), "i").alias("field"), ((F.col("m") * (F.col("i") + 1)) % 3).alias("value"), alpha.alias("alpha"))
    return groups.best_combination(wishes, "g", "m", 3, exact=True).select("g", r6("score").alias("score"))


@query("nearest_points", "select a.c_nationkey, round(min(sqrt(power(a.c_acctbal - b.c_acctbal, 2) + power((a.c_custkey - b.c_custkey) * 10.0, 2))), 6) as least from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_custkey < b.c_custkey group by 1")
def _(t: Tables):
    points = t.customer.select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_custkey") * 10.0).alias("y"))
    return lookup.nearest_pair(points, "c_nationkey", "c_custkey", ["c_acctbal", "y"]).where("least is not null").select("c_nationkey", r6("least").alias("least"))


LEADER = f"arg_max({{0}}, (ln(({drawn(chr(39) + '42' + chr(39), 'c_custkey')} + 1) / 4294967297.0) / (s + 0.1), -c_custkey))"
DISTANCE = "(sqrt(power({0}.b - {1}.b, 2) + power({0}.n - {1}.n, 2) + power({0}.b - {1}.b, 2) + 2 * power({0}.p - {1}.p, 2) + power({0}.p - {1}.p, 2)) + 8 * (1 - (" + stored.ALIKE.format("{0}", "{1}", "e") + ")) + 8 * (1 - (" + stored.ALIKE.format("{0}", "{1}", "h") + "))) / sqrt(22.0)"


def led_groups(cut: int, k: int) -> str:
    """SQL of groups of k: the best `cut` by fit, a leader drawn by weight among ten, and others in turn."""
    own = "c_nationkey, c_custkey, b, n, p, e, h, s"
    out = [f"r0 as (select * from ({stored.LEVELS}, {stored.FITS} as s from customer) qualify row_number() over (partition by c_nationkey order by s desc, c_custkey) <= {cut})", "ten as (select * from r0 qualify row_number() over (partition by c_nationkey order by s desc, c_custkey) <= 10)", f"c0 as (select * from r0 where (c_nationkey, c_custkey) in (select (c_nationkey, {LEADER.format('c_custkey')}) from ten group by c_nationkey))"]
    for i in range(1, k):
        before = "(select *, 1e9 as x from r0)" if i == 1 else f"r{i - 1}"
        out.append(f"r{i} as (select {', '.join(f'a.{c}' for c in own.split(', '))}, least(a.x, {DISTANCE.format('a', 'z')}) as x from {before} a join c{i - 1} z using (c_nationkey) where a.c_custkey <> z.c_custkey)")
        out.append(f"c{i} as (select * from r{i} qualify row_number() over (partition by c_nationkey order by round(0.6 * s + 0.4 * x, 12) desc, c_custkey) = 1)")
    return f"with {', '.join(out)} " + " union all ".join(f"select c_nationkey as trip, c_custkey as key, {i + 1}::bigint as place from c{i}" for i in range(k))


@query("led_groups", led_groups(40, 4))
def _(t: Tables):
    rows = travellers(t).select(F.col("c_nationkey").alias("trip"), F.col("c_custkey").alias("key"), "v", "budget", "season")
    trips = t.nation.select(F.col("n_nationkey").alias("trip"), F.lit(1).alias("trip_budget"), F.lit(2).alias("trip_season"), F.lit(9e5).alias("budget"), F.lit(2).alias("people"), F.lit(3).alias("days"), F.lit(1).alias("cities"))
    return retrieval.conflicting_groups(rows, trips, 4, strategy="default")
