"""Queries of trips and requests in preparation: normalised, generated, searched for candidates, batched and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.operators import aggregates as agg
from sojourn.operators import lookup, personas, prepare
from sojourn.plans.catalog import query, r6


def drawn(*parts: str) -> str:
    """SQL of prepare.draw."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint"


def chosen(options: list, *parts: str) -> str:
    listed = ", ".join(f"'{o}'" if isinstance(o, str) else str(o) for o in options)
    return f"([{listed}])[({drawn(*parts)} % {len(options)})::int + 1]"


ASK = "case c_custkey % 5 when 0 then 'A trip for 3 people please' when 1 then 'we are a family of 4' when 2 then 'for myself' else 'Somewhere warm' end"


@query("normalized_trips", f"with t as (select c_custkey as trip, case when c_custkey % 3 = 0 then c_custkey % 4 + 1 end as given, case c_custkey % 5 when 0 then 3 when 1 then 4 when 2 then 1 end as said, round(abs(c_acctbal), 0)::bigint as budget from customer), u as (select *, coalesce(given, said, 1) as was from t), v as (select *, case when was >= 2 then was else {chosen([2, 3, 5], chr(39) + 'trips' + chr(39), 'trip')} end as people from u) select trip, case when given is not null then 'field' when said is not null then 'query' else 'default' end as people_source, people, people <> was as upsampled, case when people <> was then round_even(budget * people / was, 0)::bigint else budget end as budget_final, 4 + (trip % 2)::int as keys from v")
def _(t):
    k = F.col("c_custkey")
    trips = t.customer.select(k.alias("trip"), F.when(k % 3 == 0, k % 4 + 1).alias("people_number"), F.expr(ASK).alias("query"), F.round(F.abs("c_acctbal"), 0).cast("long").alias("budget"), F.lit(3).alias("days"), F.when(k % 2 == 1, F.create_map(F.lit("pace"), F.lit("slow"))).otherwise(F.create_map(F.lit("cuisine"), F.lit("Thai"))).alias("wishes"))
    out = prepare.normalized_trips(trips, [2, 3, 5])
    return out.select("trip", "people_source", F.col("people").cast("long").alias("people"), "upsampled", "budget_final", F.size("wishes").alias("keys"))


@query("chosen_strategies", "with f as (select c_custkey, c_custkey % 7 = 0 as tight, c_custkey % 3 = 0 as short, c_custkey % 4 = 0 as large, c_custkey % 5 = 0 as several, c_custkey % 11 as days from customer), s as (select *, 10 * tight::int as b, 5 * short::int + 3 * (short and not large)::int - 2 * large::int as p, 8 * large::int as l, 1 + 4 * several::int + 3 * (not short and days <= 7)::int as a from f) select c_custkey, case greatest(b, p, l, a) when b then 'budget_war' when p then 'pace_war' when l then 'taste_war' else 'adaptive' end as strategy from s")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select(k, prepare.strategy(k % 7 == 0, k % 3 == 0, k % 4 == 0, k % 5 == 0, k % 11).alias("strategy"))


def taste(k, m: int):
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when((k + i * m) % 3 == 0, F.concat(F.lit("t"), i.cast("string")))), lambda x: x.isNotNull())


TASTE = "list_filter(range(6), lambda i: ({k} + i * {m}) % 3 = 0)"
JACCARD = "case when len({a}) + len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"


@query("feature_similarity", f"with f as (select c_custkey as k, c_nationkey, {TASTE.format(k='c_custkey', m=2)} as e, {TASTE.format(k='c_custkey', m=4)} as s, c_custkey % 4 as b, case when c_custkey % 5 > 0 then c_custkey % 3 end as n from customer) select a.k as a, b.k as b, round(least(0.6 * ({JACCARD.format(a='a.e', b='b.e')}) + 0.4 * ({JACCARD.format(a='a.s', b='b.s')}) + 0.2 * (a.b = b.b)::int + 0.1 * coalesce(a.n = b.n, false)::int, 1.0), 6) as alike from f a join f b using (c_nationkey) where a.k % 50 = 0 and b.k <> a.k")
def _(t):
    k = F.col("c_custkey")
    who = t.customer.select(k.alias("k"), "c_nationkey", taste(k, 2).alias("experiences"), taste(k, 4).alias("scenery"), (k % 4).alias("budget"), F.when(k % 5 > 0, k % 3).alias("season"))
    fields = ["experiences", "scenery", "budget", "season"]
    alike = lambda x, y: r6(personas.feature_similarity({f: x[f] for f in fields}, {f: y[f] for f in fields}))
    j = lookup.scored_pairs(who.where("k % 50 = 0"), who, "c_nationkey", "k", fields, alike)  # queries: ids divisible by 50
    return j.where("b <> a").select("a", "b", F.col("score").alias("alike"))


@query("rule_scores", f"with f as (select c_custkey, len({TASTE.format(k='c_custkey', m=2)}) as e, len({TASTE.format(k='c_custkey', m=4)}) as s, case when c_custkey % 6 > 0 then c_custkey % 4 end as b, case when c_custkey % 5 > 0 then c_custkey % 3 end as n from customer) select c_custkey, round(coalesce(case abs(1 - b) when 0 then 2 when 1 then 1 end, 0) + coalesce((n = 2)::int, 0) + 0.05::double * least(e, 4) + 0.03::double * least(s, 4), 6) as score from f")
def _(t):
    k = F.col("c_custkey")
    who = {"experiences": taste(k, 2), "scenery": taste(k, 4), "budget": F.when(k % 6 > 0, k % 4), "season": F.when(k % 5 > 0, k % 3)}
    return t.customer.select(k, r6(personas.rule_score(F.lit(1), F.lit(2), who)).alias("score"))


BANDS = "(select n_nationkey as place, min(s_acctbal) filter (s_acctbal > 0) as low, avg(s_acctbal) filter (s_acctbal > 0) as mean, max(s_acctbal) filter (s_acctbal > 0) as high from nation left join supplier on s_nationkey = n_nationkey and n_nationkey % 7 > 0 group by 1)"


def elements(level: str, share: str, wishes: dict[str, str], people: str) -> str:
    at = lambda what: f"'queries', '{level}', '{what}', id"
    base = f"select c_custkey as id, {chosen([3, 5, 7], at('days').replace('id', 'c_custkey'))} as days, {drawn(at('place').replace('id', 'c_custkey'))} % (select max(n_nationkey) + 1 from nation) as place from customer"
    budget = f"round_even(case days when 3 then (mean + low) / 2 when 5 then mean else round_even((mean + high) / 2 / 100, 0) * 100 end * {share} / 100, 0) * 100"
    return f"with b as ({base}), p as (select *, {people} as people from b), w as (select p.*, {', '.join(f'{v} as {k}' for k, v in wishes.items())}, {budget} as budget from p join {BANDS} using (place) where low is not null) select days, place, people, house_rule, cuisine, room_type, transportation, round(budget, 2) as budget, min(id) as id from w group by 1, 2, 3, 4, 5, 6, 7, 8"


MEDIUM = "'queries', 'medium', '{}', id"
CROWD = drawn(MEDIUM.format("crowd")) + " % 3"
WISH = chosen(["house rule", "cuisine", "room type"], MEDIUM.format("wish"))
DISHES = "list_transform(list_sort(list_transform([{}], lambda c: {{'d': ('0x' || substr(md5(concat_ws(':', 'queries', 'medium', 'dish', id, c)), 1, 8))::bigint, 'c': c}})), lambda d: d.c)".format(", ".join(f"'{c}'" for c in prepare.CUISINES))


@query("easy_queries", elements("easy", "1", {k: "null::varchar" for k in ("house_rule", "cuisine", "room_type", "transportation")}, "1"))
def _(t):
    return made_queries(t, "easy")


@query("medium_queries", elements("medium", "people * 0.75", {
    "house_rule": f"case when {WISH} = 'house rule' then {chosen(prepare.HOUSE_RULES, MEDIUM.format('rule'))} end",
    "cuisine": f"case when {WISH} = 'cuisine' then array_to_string(list_sort(({DISHES})[:2]), ',') end",
    "room_type": f"case when {WISH} = 'room type' then case when people <= 2 then {chosen(prepare.ROOM_TYPES, MEDIUM.format('room'))} else {chosen(prepare.ROOM_TYPES[2:], MEDIUM.format('room'))} end end",
    "transportation": "null::varchar",
}, f"case {CROWD} when 0 then 2 when 1 then {chosen([3, 4], MEDIUM.format('people'))} else {chosen([5, 6, 7, 8], MEDIUM.format('people'))} end"))
def _(t):
    return made_queries(t, "medium")


HARD = "'queries', 'hard', '{}', id"
KEYED = "list_transform(list_sort([{}]), lambda x: x.k)[:3]".format(", ".join(f"{{'u': -ln(({drawn(HARD.format('wish'), chr(39) + k + chr(39))} + 1) / 4294967296.0) / {w}, 'k': '{k}'}}" for k, w in prepare.HARD_WEIGHTS.items()))
HARD_CROWD = drawn(HARD.format("crowd")) + " % 3"


@query("hard_queries", elements("hard", "people * 0.5", {
    "house_rule": f"case when list_contains({KEYED}, 'house rule') then {chosen(prepare.HOUSE_RULES, HARD.format('rule'))} end",
    "cuisine": f"case when list_contains({KEYED}, 'cuisine') then array_to_string(list_sort(({DISHES.replace('medium', 'hard')})[:4]), ',') end",
    "room_type": f"case when list_contains({KEYED}, 'room type') then case when people <= 2 then {chosen(prepare.ROOM_TYPES, HARD.format('room'))} else {chosen(prepare.ROOM_TYPES[2:], HARD.format('room'))} end end",
    "transportation": f"case when list_contains({KEYED}, 'transportation') then {chosen(['no flight', 'no self-driving'], HARD.format('ban'))} end",
}, f"case {HARD_CROWD} when 0 then 2 when 1 then {chosen([3, 4], HARD.format('people'))} else {chosen([5, 6, 7, 8], HARD.format('people'))} end"))
def _(t):
    return made_queries(t, "hard")


def made_queries(t, level: str):
    price = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    bands = t.nation.join(t.supplier, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("n_nationkey") % 7 > 0), "left").groupBy(F.col("n_nationkey").alias("place")).agg(F.min(price).alias("low"), F.avg(price).alias("mean"), F.max(price).alias("high"))
    out = prepare.query_elements(t.customer.select(F.col("c_custkey").alias("id")), bands, level)
    return out.withColumn("budget", F.round("budget", 2))


MINUTES = "least(45 + floor(abs(s_acctbal) / 100 / 5), 90)::bigint"


@query("trip_candidates", f"with t as (select n_nationkey as trip, concat('city', n_nationkey % 5) as o, concat('city', (n_nationkey + 1) % 5) as d from nation), x as (select s_name as name, concat('city', s_nationkey % 5) as city, concat('city', (s_nationkey + 1) % 5) as dest, round(abs(s_acctbal) / 100, 2) as price from supplier) select trip, 'outbound' as kind, name as item, price, null::bigint as minutes from t join x on city = o and dest = d union all select trip, 'return', name, price, null from t join x on city = d and dest = o union all select trip, 'hotel', name, price, null from t join x on city = d union all select trip, 'restaurant', name, price, least(45 + floor(price / 5), 90)::bigint from t join x on city = d union all select trip, 'origin_restaurant', name, price, least(45 + floor(price / 5), 90)::bigint from t join x on city = o union all select trip, 'attraction', name, 15.0, 90 from t join x on city = d")
def _(t):
    trips = t.nation.select(F.col("n_nationkey").alias("trip"), F.concat(F.lit("City"), F.col("n_nationkey") % 5, F.lit(" (ST)")).alias("org"), F.concat(F.lit("CITY"), (F.col("n_nationkey") + 1) % 5).alias("dest"))
    rows = t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("City"), F.col("s_nationkey") % 5).alias("city"), F.concat(F.lit("city"), (F.col("s_nationkey") + 1) % 5).alias("dest"), F.round(F.abs("s_acctbal") / 100, 2).alias("price"), F.lit("x").alias("house_rules"), F.lit("y").alias("cuisines"))
    return prepare.candidates(trips, rows.withColumnRenamed("city", "origin"), rows, rows, rows).drop("category")


@query("solved_plan_rows", "with d as (select o_custkey as trip, row_number() over (partition by o_custkey order by o_orderkey) as day, count(*) over (partition by o_custkey) as days, o_orderkey as k from orders) select trip, day, case when day = days and day > 1 and trip % 4 > 0 or (day = 1 and days = 1 and trip % 3 = 0 and trip % 4 > 0) then concat('from B to A') when day = 1 then 'from A to B' else 'B' end as current_city, case when day = 1 and trip % 3 > 0 then concat('Flight Number: F', trip % 9, ', from A to B') when day = days and trip % 4 > 0 then concat('Flight Number: R', trip % 9, ', from B to A') else '-' end as transportation, case when k % 5 = 0 then '-' else concat('R', k % 7, case when day = 1 then ', A' else ', B' end) end as breakfast, case when k % 3 = 0 then '-' when k % 3 = 1 then concat('S', k % 6, ', B;') else concat('S', k % 6, ', B;T', k % 4, ', B;') end as attraction, case when day < days then concat('H', trip % 5, ', B') else '-' end as accommodation from d")
def _(t):
    d = t.orders.selectExpr("o_custkey as trip", "cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as day", "count(*) over (partition by o_custkey) as days", "o_orderkey as k")
    solved = d.selectExpr("trip", "day", "days", "'A' as org", "'B' as dest", "case when trip % 3 > 0 then concat('F', trip % 9) end as outbound", "case when trip % 4 > 0 then concat('R', trip % 9) end as back", "concat('H', trip % 5) as hotel", "case when k % 5 > 0 then concat('R', k % 7) end as breakfast", "'x' as lunch", "'y' as dinner", "case k % 3 when 0 then array() when 1 then array(concat('S', k % 6)) else array(concat('S', k % 6), concat('T', k % 4)) end as attractions")
    return prepare.plan_rows(solved).drop("lunch", "dinner")


LINE = "concat('{\"custom_id\": \"', c_custkey % 400, '\", \"response\": {\"status_code\": ', case when c_custkey % 7 = 0 then 500 else 200 end, ', \"body\": {\"choices\": [{\"message\": {\"content\": \"', case when c_custkey % 5 = 0 then '{broken' else concat('[', c_custkey, ']') end, '\"}}]}}, \"error\": ', case when c_custkey % 7 = 0 and c_custkey % 2 = 1 then '{\"message\": \"down\"}' else 'null' end, '}')"


@query("parsed_replies", "with l as (select c_custkey % 400 as id, max(c_custkey) as k from customer group by 1) select id::varchar as custom_id, k % 7 > 0 and k % 5 > 0 as success, case when k % 7 > 0 and k % 5 > 0 then concat('[', k, ']') end as data, case when k % 7 > 0 and k % 5 = 0 then 'JSON parse error' when k % 14 = 0 then 'Unknown error' when k % 7 = 0 then 'down' end as error from l")
def _(t):
    return prepare.parsed_replies(t.customer.select("c_custkey", F.expr(LINE).alias("value")), "c_custkey")


@query("batched_requests", "with f as (select conv_id, turn, concat(conv_id, '_', row_number() over (partition by conv_id order by turn) - 1) as custom_id, count(*) over (partition by conv_id) as n from conversations) select conv_id, count_if(turn % 3 > 0)::bigint as kept, count(*) as n from f group by 1")
def _(t):
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    requests = prepare.flattened(lists, "conv_id", "turns")
    return prepare.regrouped(requests, requests.select("custom_id", (F.col("item") % 3 > 0).alias("success")), "conv_id")


@query("merged_lists", "select c_custkey, case when c_custkey % 8 <= 3 then 1 when c_custkey % 8 <= 5 then 3 else 4 end as n from customer")
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k, (k % 8).alias("days"), F.lit('["a"]').alias("x"), F.lit('[{"b": 1}, "c"]').alias("y"), F.lit("[4]").alias("z"))
    return prepare.merged_lists(rows, ["x", "y", "z"], "days").select("c_custkey", F.size("merged").alias("n"))


@query("shortened_logs", "select c_custkey, case when 22 + 3 * (c_custkey % 30) > 60 then 'Thought: go;Observation 1: [truncated];' || case when 22 + 3 * (c_custkey % 30) - 2 * (c_custkey % 30) + 11 > 60 then 'Observation 2: [truncated]' else 'Observation 2: ' || repeat('y', (c_custkey % 30)::int) end else 'Thought: go;Observation 1: ' || repeat('x', (2 * (c_custkey % 30))::int) || ';Observation 2: ' || repeat('y', (c_custkey % 30)::int) end as log from customer where c_custkey % 30 > 5")
def _(t):
    n = (F.col("c_custkey") % 30).cast("int")
    lines = F.array(F.lit("Thought: go"), F.concat(F.lit("Observation 1: "), F.repeat(F.lit("x"), 2 * n)), F.concat(F.lit("Observation 2: "), F.repeat(F.lit("y"), n)))
    return t.customer.where("c_custkey % 30 > 5").select("c_custkey", F.array_join(prepare.shortened(lines, 81), ";").alias("log"))


@query("moved_columns", "select c_custkey, c_mktsegment, c_nationkey from customer")
def _(t):
    headed = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").toDF("﻿C_CustKey ", " c_nationkey", "C_MKTSEGMENT")
    return prepare.moved_after(prepare.with_normalized_headers(headed), ["c_mktsegment", "none"], "c_custkey")


@query("mode_sweep", "select o_orderpriority as mode, 'values' as statistic, avg((o_totalprice > 100000)::int) as x from orders group by 1 union all select o_orderpriority, 'spread', count(distinct o_orderstatus)::double from orders group by 1")
def _(t):
    rows = t.orders.withColumnRenamed("o_orderpriority", "mode")
    ratio = lambda df, g: df.groupBy(*g).agg(F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("x"))
    distinct = lambda df, g: df.groupBy(*g).agg(F.count_distinct("o_orderstatus").cast("double").alias("x"))
    out = prepare.swept(rows, "mode", {"values": ratio, "spread": distinct})
    return out.select("mode", "statistic", F.get_json_object("row", "$.x").cast("double").alias("x"))


@query("group_welfare", "with m as (select s_nationkey as g, s_suppkey % 3 as m, sum(case when s_acctbal > 0 then s_suppkey % 11 else 0 end) / nullif(sum(s_suppkey % 11), 0) as s, sum(case when s_acctbal < 1000 then s_suppkey % 11 else 0 end) as c, count_if(s_acctbal > 0) as k, count(*) as n from supplier group by 1, 2) select g, round(min(s), 6) as least, sum(c)::bigint as cost, round(sum(k) / sum(n), 6) as retained from m group by 1")
def _(t):
    rows = t.supplier.select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 3).alias("m"), (F.col("s_suppkey") % 11).alias("alpha"), (F.col("s_acctbal") > 0).alias("ok"), (F.col("s_acctbal") < 1000).alias("changed"))
    return prepare.group_welfare(rows, "g", "m", "alpha", "ok", "changed").select("g", r6("least").alias("least"), F.col("cost").cast("long").alias("cost"), r6("retained").alias("retained"))


@query("rule_kinds", "with r as (select l_suppkey % 50 as g, case l_linenumber % 3 when 0 then 'in' when 1 then 'not_in' else 'bool' end as op, list_distinct([concat('v', l_partkey % 2), concat('v', l_partkey % 3), 'v0']) as items, l_quantity > 25 as flag from lineitem), a as (select g, op, list(items) as lists, count_if(flag) * 2 > count(*) as major from r group by 1, 2), b as (select *, list_sort(list_distinct(flatten(lists))) as every, list_sort(list_filter(list_distinct(flatten(lists)), lambda v: len(list_filter(lists, lambda l: list_contains(l, v))) = len(lists))) as shared from a) select g as \"group\", op as operator, array_to_string(case op when 'in' then case when len(shared) > 0 then shared else every end when 'not_in' then every end, ',') as items, case when op = 'bool' then major end as flag from b")
def _(t):
    v = lambda n: F.concat(F.lit("v"), F.col("l_partkey") % n)
    op = F.when(F.col("l_linenumber") % 3 == 0, "in").when(F.col("l_linenumber") % 3 == 1, "not_in").otherwise("bool")
    rules = t.lineitem.select((F.col("l_suppkey") % 50).alias("group"), F.lit("x").alias("attr"), op.alias("operator"), F.lit(None).cast("double").alias("number"), F.array_distinct(F.array(v(2), v(3), F.lit("v0"))).alias("items"), (F.col("l_quantity") > 25).alias("flag"), F.lit(1.0).alias("priority"))
    out = agg.aggregate_rules(rules)
    return out.select("group", "operator", F.array_join("items", ",").alias("items"), "flag")
