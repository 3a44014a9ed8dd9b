"""More queries: top-k, sets, scalar functions, vectors, groups, constraints, preferences, search, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.functions import numeric, text
from sojourn.operators import constraints, groups, leaderboard, lookup, personas, preferences, prepare, search, vectors, windows
from sojourn.plans.catalog import query, r6
from sojourn.streaming import resume


def lit_list(values):
    return F.array(*map(F.lit, values))


# top-k


@query("cheapest_row", "select p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) as p_partkey, min(p_retailprice) as p_retailprice from part group by 1")
def _(t):
    return search.cheapest(t.part, ["p_brand"], "p_retailprice", "p_partkey", ["p_partkey", "p_retailprice"])


@query("cheapest_mode", "with p as (select o_orderkey, case when o_orderkey % 3 > 0 then o_totalprice end as flight, case when o_orderkey % 4 > 0 then o_totalprice * 0.9 + 100 end as taxi, case when o_orderkey % 5 > 2 then o_totalprice * 0.8 + 9000 end as car from orders) select o_orderkey, round(least(flight, taxi, car), 6) as cost, case when least(flight, taxi, car) is null then null when flight = least(flight, taxi, car) then 'Flight' when taxi = least(flight, taxi, car) then 'Taxi' else 'Self-driving' end as mode from p")
def _(t):
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    best = search.cheapest_mode({"Flight": F.when(k % 3 > 0, x), "Taxi": F.when(k % 4 > 0, x * 0.9 + 100), "Self-driving": F.when(k % 5 > 2, x * 0.8 + 9000)})
    return t.orders.select("o_orderkey", r6(best["cost"]).alias("cost"), best["mode"].alias("mode"))


@query("topk_score", "select c_nationkey, c_custkey from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal * 0.5 + length(c_mktsegment) desc, c_custkey) as n from customer) where n <= 5")
def _(t):
    scored = t.customer.withColumn("score", F.col("c_acctbal") * 0.5 + F.char_length("c_mktsegment"))
    return personas.top(scored, ["c_nationkey"], "score", "c_custkey", 5).select("c_nationkey", "c_custkey")


@query("weighted_pick")
def _(t):
    return personas.weighted_pick(t.supplier.withColumn("w", F.abs("s_acctbal") + 0.1), ["s_nationkey"], "w", "s_suppkey", 42).select("s_nationkey", "s_suppkey")


@query("full_sort", "select n_nationkey, row_number() over (order by n_name, n_nationkey, n_regionkey) as place from nation")
def _(t):
    return windows.global_rank(t.nation, [(F.col(c), False) for c in ("n_name", "n_nationkey", "n_regionkey")], "place").select("n_nationkey", F.col("place").cast("long").alias("place"))


@query("first_n", "select o_orderkey from orders order by o_orderdate, o_orderkey limit 20")
def _(t):
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey")


@query("distinct_capped_list", "select p_brand, array_to_string(list_slice(list_sort(list(distinct p_type)), 1, 10), ';') as types from part group by 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 10), ";").alias("types"))


# sets


@query("union_distinct", "select s_nationkey as k from supplier union select c_nationkey from customer")
def _(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).union(t.customer.select("c_nationkey")).distinct()


@query("vertical_concat", "select s_name as name, s_nationkey as nation from supplier union all select c_name, c_nationkey from customer")
def _(t):
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return s.unionByName(t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))


@query("set_ops", "with s as (select s_nationkey as k, list(distinct s_suppkey % 7) as a from supplier group by 1), c as (select c_nationkey as k, list(distinct c_custkey % 11) as b from customer group by 1) select k, len(list_distinct(list_concat(a, b))) as either, len(list_intersect(a, b)) as both, len(list_filter(a, lambda x: not list_contains(b, x))) as only from s join c using (k)")
def _(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_set(F.col("s_suppkey") % 7).alias("a"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set(F.col("c_custkey") % 11).alias("b"))
    n = lambda x: F.size(x).cast("long")
    return s.join(c, "k").select("k", n(F.array_union("a", "b")).alias("either"), n(F.array_intersect("a", "b")).alias("both"), n(F.array_except("a", "b")).alias("only"))


@query("duplicate_free", "select distinct p_brand, p_size from part")
def _(t):
    return t.part.select("p_brand", "p_size").dropDuplicates()


# scalar functions


NAMED = "(select s_suppkey as k, s_name || ', ' || n_name || case when s_suppkey % 3 = 0 then '(' || n_regionkey || ')' else '' end as v from supplier join nation on n_nationkey = s_nationkey)"


def named(t):
    j = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return j.select(F.col("s_suppkey").alias("k"), F.concat("s_name", F.lit(", "), "n_name", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("("), F.col("n_regionkey").cast("string"), F.lit(")"))).otherwise("")).alias("v"))


@query("before_parenthesis", f"select k, split_part(v, '(', 1) as plain from {NAMED}")
def _(t):
    return named(t).select("k", text.before_parenthesis(F.col("v")).alias("plain"))


@query("name_city_split", f"select k, trim(split_part(v, ',', 1)) as name, trim(split_part(split_part(v, ',', 2), '(', 1)) as city from {NAMED}")
def _(t):
    nc = text.name_city(F.col("v"))
    return named(t).select("k", nc["name"].alias("name"), nc["city"].alias("city"))


@query("name_city_last_comma", f"select k, trim(split_part(v, ',', 1)) as name, trim(split_part(v, ',', 2)) as city from {NAMED}")
def _(t):
    nc = text.name_city_last_comma(F.col("v"))
    return named(t).select("k", nc["name"].alias("name"), nc["city"].alias("city"))


LEGS = "(select a.n_nationkey * 100 + b.n_nationkey as k, a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey <> b.n_nationkey and a.n_regionkey = b.n_regionkey)"


def legs(t):
    a = t.nation.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("x"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").where("i <> j").select((F.col("i") * 100 + F.col("j")).alias("k"), "x", "y", F.concat(F.lit("Flight Number: F"), F.col("i"), F.lit(", from "), "x", F.lit(" to "), "y", F.lit(", Departure")).alias("v"))


@query("extract_from_to", f"select k, x as origin, case when contains(y, ' ') then y else y end as destination from {LEGS}")
def _(t):
    ft = text.from_to(F.col("v"))
    return legs(t).select("k", ft["origin"].alias("origin"), ft["destination"].alias("destination"))


@query("flight_number", f"select k, 'F' || (k // 100) as number from {LEGS}")
def _(t):
    return legs(t).select("k", text.flight_number(F.col("v")).alias("number"))


@query("transport_kind", "select o_orderkey, case o_orderkey % 4 when 0 then 'Taxi' when 1 then 'Self-driving' when 2 then 'Flight' end as kind from orders")
def _(t):
    said = F.element_at(lit_list(["a TAXI, then a flight", "self-Driving", "Flight F1", "on foot"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", text.transport_kind(said).alias("kind"))


@query("ground_cost", "select o_orderkey, floor(floor(o_totalprice) * 0.05)::bigint as drive, floor(o_totalprice)::bigint as taxi from orders")
def _(t):
    km = text.distance_km(F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" km")))
    return t.orders.select("o_orderkey", numeric_cost(km, "self-driving").alias("drive"), numeric_cost(km, "taxi").alias("taxi"))


def numeric_cost(km, mode):
    return text.ground_cost(km, F.lit(mode)).cast("long")


@query("duration_minutes", "select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then (l_quantity::int) * 60 when l_linenumber % 3 = 1 then l_linenumber else (l_quantity::int) * 60 + l_linenumber end as minutes, case when l_linenumber % 3 = 2 then (l_quantity::int) * 60 + l_linenumber end as strict from lineitem")
def _(t):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(" hours"))).when(F.col("l_linenumber") % 3 == 1, F.concat(n, F.lit(" minutes"))).otherwise(F.concat(q, F.lit(" hours "), n, F.lit(" mins")))
    return t.lineitem.select("l_orderkey", "l_linenumber", text.duration_minutes(said).alias("minutes"), text.duration_minutes_strict(said).alias("strict"))


@query("money_text", "select p_partkey, floor(p_retailprice)::bigint as dollars from part")
def _(t):
    said = F.concat(F.lit("a budget of $ "), F.format_number(F.floor("p_retailprice"), 0), F.lit(" or $5"))
    return t.part.select("p_partkey", text.money(said).alias("dollars"))


PHRASES = ["a group of 7 people", "for 25 people, party of 3 people", "three travelers", "a solo trip", "we are a couple", "family of 4", "for myself", "for us", "nobody said"]


@query("party_size", "select c_custkey, case c_custkey % 9 when 0 then 7 when 1 then 3 when 2 then 3 when 3 then 1 when 4 then 2 when 5 then 4 when 6 then 1 when 7 then 2 end as people from customer")
def _(t):
    return t.customer.select("c_custkey", text.party_size(F.element_at(lit_list(PHRASES), (F.col("c_custkey") % 9 + 1).cast("int"))).alias("people"))


@query("season_bucket", "select o_orderkey, case when month(o_orderdate) in (12, 1, 2) then 0 when month(o_orderdate) < 6 then 1 when month(o_orderdate) < 9 then 2 else 3 end as season from orders")
def _(t):
    return t.orders.select("o_orderkey", numeric.season(F.month("o_orderdate")).alias("season"))


@query("per_person_night", "select o_orderkey, round(case when o_orderkey % 6 > 0 and o_orderkey % 8 > 0 then o_totalprice / ((o_orderkey % 6) * (o_orderkey % 8)) end, 6) as pppn from orders")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", r6(numeric.per_person_night(F.col("o_totalprice"), k % 6, k % 8)).alias("pppn"))


@query("quantile_bucket", "with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders) select o_orderkey, case when o_totalprice <= a then 0 when o_totalprice <= b then 1 when o_totalprice <= c then 2 else 3 end as bucket, case when o_totalprice / 1000 < 50 then 0 when o_totalprice / 1000 < 100 then 1 when o_totalprice / 1000 < 250 then 2 else 3 end as fallback from orders, q")
def _(t):
    q = t.orders.agg(F.percentile("o_totalprice", lit_list([0.25, 0.5, 0.75])).alias("q")).first().q  # three numbers
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", numeric.quantile_bucket(x, *map(F.lit, q)).alias("bucket"), numeric.fallback_bucket(x / 1000).alias("fallback"))


@query("round_hundreds", "select o_orderkey, round_even(o_totalprice / 100, 0) * 100 as rounded, round_even((o_orderkey % 7 + 1) * 50.0 / 100, 0) * 100 as half from orders")
def _(t):
    return t.orders.select("o_orderkey", numeric.round_hundreds(F.col("o_totalprice")).alias("rounded"), numeric.round_hundreds((F.col("o_orderkey") % 7 + 1) * F.lit(50.0)).alias("half"))


@query("rescaled_budget", "select o_orderkey, round_even(floor(o_totalprice) * (o_orderkey % 5 + 1) / 2, 0)::bigint as budget from orders")
def _(t):
    return t.orders.select("o_orderkey", numeric.rescale_budget(F.floor("o_totalprice").cast("double"), F.col("o_orderkey") % 5 + 1, F.lit(2)).alias("budget"))


@query("json_props", "select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, len(json_keys(props)) as keys from events")
def _(t):
    names = F.json_object_keys("props")
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(m, names[0]).alias("first_value"), F.size(names).cast("long").alias("keys"))


@query("literal_lists", "select p_partkey, len(string_split(p_type, ' ')) as n, list_last(string_split(p_type, ' ')) as last from part")
def _(t):
    said = F.concat(F.lit("['"), F.array_join(F.split("p_type", " "), "', '"), F.lit("']"))
    items = text.literal_list(said)
    return t.part.select("p_partkey", F.size(items).cast("long").alias("n"), F.element_at(items, -1).alias("last"))


@query("fence_and_json", "select p_partkey, '{\"size\": ' || p_size || '}' as body, p_size as size from part")
def _(t):
    body = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}"))
    fenced = F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\nok"))
    noisy = F.concat(F.lit("here "), body, F.lit(" done"))
    return t.part.select("p_partkey", text.strip_fence(fenced).alias("body"), F.from_json(text.outer_json(noisy), "size int")["size"].alias("size"))


@query("slug", "select p_partkey, regexp_replace(p_name || '/' || p_type, '[^\\p{L}\\p{N}\\-_.]', '-', 'g') as slug from part")
def _(t):
    return t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit("/"), "p_type")).alias("slug"))


@query("stop_distance", "select s_suppkey, round(abs(s_acctbal), 2) as meters from supplier")
def _(t):
    return t.supplier.select("s_suppkey", text.stop_distance(F.concat("s_name", F.lit(", "), F.round(F.abs("s_acctbal"), 2).cast("string"), F.lit("m away"))).alias("meters"))


@query("poi_list", "select s_suppkey, s_name || '|' || n_name as names, 'xz' as kinds, round(9 + (s_suppkey % 60) / 60, 6) as start from supplier join nation on n_nationkey = s_nationkey")
def _(t):
    j = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    said = F.concat("s_name", F.lit(", stay from 09:"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0"), F.lit(" to 10:00; "), "n_name", F.lit(", visit from 11:00 to 12:30;"))
    return j.select("s_suppkey", F.array_join(text.poi_names(said), "|").alias("names"), F.array_join(text.poi_kinds(said), "").alias("kinds"), r6(text.stay_hours(said)["start"]).alias("start"))


@query("clock_tokens", "select event_id, hour(ts) as h, 2 as n from events")
def _(t):
    said = F.concat(F.lit("from "), F.date_format("ts", "HH:mm"), F.lit(" to 23:59 not 1234:5"))
    return t.events.select("event_id", text.hour_of(said).cast("long").alias("h"), F.size(text.clock_tokens(said)).alias("n"))


@query("answer_normalized", "select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || p_name || ', ' || p_type || '!'), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as answer from part")
def _(t):
    return t.part.select("p_partkey", text.answer_normalized(F.concat(F.lit("The "), "p_name", F.lit(", "), "p_type", F.lit("!"))).alias("answer"))


@query("iso_date", "select o_orderkey, o_orderkey % 2 = 0 as ok from orders")
def _(t):
    return t.orders.select("o_orderkey", text.is_iso_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))).alias("ok"))


ERRORS = ["Parse_error at 3", "invalid field x", "an invalid room type", "must be objects", "PERSONA_INDEX gone", "something else"]


@query("error_classes", "select user_id, case user_id % 6 when 0 then 'parse_error' when 1 then 'invalid_field' when 2 then 'invalid_room_type' when 3 then 'shape_error' when 4 then 'persona_index_mismatch' else 'other' end as kind, count(*) as rows from events group by 1, 2")
def _(t):
    said = F.element_at(lit_list(ERRORS), (F.col("user_id") % 6 + 1).cast("int"))
    return t.events.groupBy("user_id", text.error_class(said).alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("field_category", "select p_partkey, case p_partkey % 3 when 0 then 'flight' when 1 then 'other' else 'ground' end as category from part")
def _(t):
    said = F.element_at(lit_list(["flight.price", "weather.rain", "ground.mode"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", text.category_of(said).alias("category"))


@query("importance_band", "select o_orderkey, case when o_orderkey % 11 >= 9 then 'must_have' when o_orderkey % 11 >= 7 then 'should_have' when o_orderkey % 11 >= 4 then 'could_have' else 'indifferent' end as band from orders")
def _(t):
    return t.orders.select("o_orderkey", numeric.importance_band(F.col("o_orderkey") % 11).alias("band"))


@query("clamped", "select o_orderkey, case when o_orderkey % 3 = 0 then 5.0 else least(greatest(o_orderkey % 20 - 4, 0), 10)::double end as x from orders")
def _(t):
    said = F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise((F.col("o_orderkey") % 20 - 4).cast("string"))
    return t.orders.select("o_orderkey", numeric.clamped(said, 0.0, 10.0, 5.0).alias("x"))


@query("table_numbers", "select s_suppkey, round(abs(s_acctbal), 2) as price, (s_suppkey % 9)::double as seats from supplier")
def _(t):
    said = F.concat(F.lit("F12 row "), F.round(F.abs("s_acctbal"), 2).cast("string"), F.lit(" "), (F.col("s_suppkey") % 9).cast("string"), F.lit("  09:30 11:40 77"))
    found = text.numbers_before_clock(said)
    return t.supplier.select("s_suppkey", found[1].alias("price"), found[2].alias("seats"))


@query("enums_present", "select p_partkey, array_to_string(list_filter(['steel', 'brass', 'small'], lambda x: contains(lower(p_type), x)), ',') as found from part")
def _(t):
    return t.part.select("p_partkey", F.array_join(text.enums_present(F.col("p_type"), ["steel", "brass", "small"]), ",").alias("found"))


@query("budget_guidance", "select o_orderkey, round_even(o_totalprice / 3 * 0.4, 0)::bigint as night, round_even(o_totalprice * 0.3 / 4, 0)::bigint as flight, round_even(o_totalprice * 0.22 / 12, 0)::bigint as meal from orders")
def _(t):
    g = numeric.budget_guidance(F.col("o_totalprice"), F.lit(3), F.lit(2), numeric.budget_tier(F.lit("a Comfortable trip")))
    return t.orders.select("o_orderkey", *(g[n].alias(n) for n in ("night", "flight", "meal")))


@query("constraint_validate", "with r as (select min(p_size) as lo, max(p_size) as hi from part) select o_orderkey, case when o_orderkey % 80 < lo then 'infeasible' when o_orderkey % 80 >= hi then 'no_op' else 'ok' end as sense from orders, r")
def _(t):
    r = F.broadcast(t.part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")))  # one row
    return t.orders.join(r).select("o_orderkey", numeric.feasibility(F.lit("<="), F.col("o_orderkey") % 80, F.col("lo"), F.col("hi")).alias("sense"))


@query("shares_balanced", "select o_orderkey, abs(1 - (o_orderkey % 10) / 10.0 - (o_orderkey % 7) / 7.0) <= 0.15 as ok from orders")
def _(t):
    return t.orders.select("o_orderkey", numeric.shares_balanced((F.col("o_orderkey") % 10) / F.lit(10.0), (F.col("o_orderkey") % 7) / F.lit(7.0)).alias("ok"))


@query("translation_need", "select doc_id, not regexp_matches(coalesce(text, ''), '[가-힣]') and length(coalesce(text, '')) >= 40 as needed from documents")
def _(t):
    return t.documents.select("doc_id", text.needs_translation(F.coalesce("text", F.lit(""))).alias("needed"))


@query("date_runs", "select o_orderkey, (cast(o_orderdate as date) + ((o_orderkey % 5)::int))::timestamp as last, o_orderkey % 5 + 1 as n from orders")
def _(t):
    days = numeric.date_run(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", F.element_at(days, -1).cast("timestamp_ntz").alias("last"), F.size(days).cast("long").alias("n"))


@query("rendered_query", "select o_orderkey, 'Plan a trip for ' || (o_orderkey % 5 + 1) || ' people in ' || c_mktsegment as text from orders join customer on c_custkey = o_custkey")
def _(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return j.select("o_orderkey", F.format_string("Plan a trip for %d people in %s", F.col("o_orderkey") % 5 + 1, "c_mktsegment").alias("text"))


@query("visit_minutes", "select p_partkey, least(45 + floor(p_retailprice / 50 / 5), 90)::bigint as minutes from part")
def _(t):
    return t.part.select("p_partkey", numeric.visit_minutes(F.col("p_retailprice") / 50).cast("long").alias("minutes"))


@query("stable_hash_id", "select c_custkey, substr(sha1(c_name), 1, 16) as id from customer")
def _(t):
    return t.customer.select("c_custkey", numeric.stable_id(F.col("c_name")).alias("id"))


@query("stable_seed", "select c_custkey, xor(('0x' || substr(sha1(c_name), 1, 8))::bigint, 42::bigint) as seed from customer")
def _(t):
    return t.customer.select("c_custkey", numeric.stable_seed(F.col("c_name"), 42).alias("seed"))


@query("token_cost", "select doc_id, round_even(0.06 * coalesce(length(text), 0) / 1000, 4) as cost from documents")
def _(t):
    return t.documents.select("doc_id", numeric.token_cost(F.lit("gpt-4-x"), F.coalesce(F.char_length("text"), F.lit(0))).alias("cost"))


@query("perplexity", "select event_type, round(exp(-avg(-value / 100)), 6) as p from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(r6(numeric.perplexity(-F.col("value") / 100)).alias("p"))


@query("spatial_decay", "select s_suppkey, round(case when abs(s_acctbal) <= 5000 then 1 - 0.5 * abs(s_acctbal) / 5000 else 0.5 * exp(-0.0002 * (abs(s_acctbal) - 5000)) end, 6) as score from supplier")
def _(t):
    return t.supplier.select("s_suppkey", r6(numeric.spatial_decay(F.abs("s_acctbal"))).alias("score"))


@query("normal_score", "with z as (select l_orderkey, l_linenumber, (l_quantity - 20) / 8 as a, (l_linenumber - 3) / 2.0 as b from lineitem) select l_orderkey, l_linenumber, round(exp(-0.5 * (a * a - 2 * 0.3 * a * b + b * b) / (1 - 0.3 * 0.3)), 6) as score from z")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(numeric.normal_score(F.col("l_quantity"), F.col("l_linenumber"), 20, 3, 8, 2, 0.3)).alias("score"))


@query("poisson_score", "select l_orderkey, round(exp(-1.82) * pow(1.82, count(*)) / factorial(count(*)::int), 6) as p from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n")).select("l_orderkey", r6(numeric.poisson(F.col("n"), 1.82)).alias("p"))


@query("duration_score", "select l_orderkey, l_linenumber, round(exp(-0.5 * pow((l_quantity - l_linenumber * 5) / 10, 2)), 6) as score from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(numeric.gaussian_score(F.col("l_quantity"), F.col("l_linenumber") * 5, 10)).alias("score"))


@query("planar_km", "select s_suppkey, round(sqrt(pow(s_acctbal / 100 - 3, 2) + pow(s_nationkey - 4, 2)) * 111, 6) as km from supplier")
def _(t):
    return t.supplier.select("s_suppkey", r6(numeric.planar_km(F.col("s_acctbal") / 100, F.col("s_nationkey"), F.lit(3), F.lit(4))).alias("km"))


@query("split_names", "select doc_id, case doc_id % 4 when 0 then 'train' when 1 then 'validation' when 2 then 'test' end as split from documents")
def _(t):
    said = F.element_at(lit_list(["a/train/test", "b_validation_test", "x/test.json", "other"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", text.split_of_path(said).alias("split"))


@query("until_sentinel", "select p_partkey, len(string_split(p_type, ' ')) as n from part")
def _(t):
    tokens = F.concat(lit_list(["\n", "\n"]), F.split("p_type", " "), lit_list(["STOP", "more"]))
    return t.part.select("p_partkey", F.size(text.until_sentinel(tokens, F.lit("STOP"))).cast("long").alias("n"))


# vectors


@query("cosine_pairs", "select a.vec_id as a, b.vec_id as b, round(1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 5) as d from embeddings a join embeddings b on a.label = b.label and a.vec_id % 50 = 0 and b.vec_id <> a.vec_id")
def _(t):
    j = vectors.key_distances(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "label", "vec_id", "embedding", vectors.cosine_distance)  # queries: ids divisible by 50
    return j.where("b <> a").select("a", "b", F.round("distance", 5).alias("d"))


@query("weighted_l2", "select a.vec_id as a, b.vec_id as b, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow((a.embedding[i]::double - b.embedding[i]::double) * (1 + (i - 1) % 3), 2)))), 5) as d from embeddings a join embeddings b on a.label = b.label and a.vec_id % 50 = 0 and b.vec_id <> a.vec_id")
def _(t):
    j = vectors.key_distances(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "label", "vec_id", "embedding", vectors.weighted_l2(lambda i: 1.0 + i % 3))
    return j.where("b <> a").select("a", "b", F.round("distance", 5).alias("d"))


@query("jaccard_tokens", "with w as (select p_partkey as k, p_brand, list_distinct(string_split(p_type, ' ')) as s from part) select a.k as a, b.k as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) as j from w a join w b on a.p_brand = b.p_brand and b.k <> a.k")
def _(t):
    w = t.part.select("p_partkey", "p_brand", F.array_distinct(F.split("p_type", " ")).alias("s"))
    j = lookup.scored_pairs(w, w, "p_brand", "p_partkey", ["s"], lambda x, y: r6(numeric.jaccard(x["s"], y["s"])))
    return j.where("b <> a").select("a", "b", F.col("score").alias("j"))


def travellers(t):
    k = F.col("c_custkey")
    pick = lambda names, m: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((k + i * m) % 3 == 0, F.element_at(lit_list(names), i + 1))), lambda x: x.isNotNull())
    level = lambda names: F.element_at(lit_list(names), (k % 3 + 1).cast("int"))
    v = personas.vector((k % 4).cast("int"), (k % 5).cast("int"), F.array(F.element_at(lit_list(personas.AGES), (k % 4 + 1).cast("int"))), level(["Chill", "Balanced", "Very Active"]), level(["Very Safety", "Balanced", "Ready for Anything"]), level(["Off the Beaten Path", "Classic", "Trendy"]), pick(personas.EXPERIENCES, 2), pick(personas.SCENERY, 4))
    return t.customer.select("c_nationkey", "c_custkey", v.alias("v"), (k % 4).cast("int").alias("budget"), (k % 5).cast("int").alias("season"))


@query("persona_vectors", "select c_custkey, round((c_custkey % 4) / 3.0, 6) as budget, round(case when c_custkey % 5 <= 3 then (c_custkey % 5) / 3.0 else 0 end, 6) as season, (c_custkey % 3) / 2.0 as pace, len(list_filter(range(8), lambda i: (c_custkey + i * 2) % 3 = 0))::double as experiences from customer")
def _(t):
    v = F.col("v")
    return travellers(t).select("c_custkey", r6(v[0]).alias("budget"), r6(v[1]).alias("season"), v[3].alias("pace"), F.aggregate(personas.part(v, "experiences"), F.lit(0.0), lambda s, x: s + x).alias("experiences"))


@query("persona_relevance", "with v as (select c_custkey, abs(c_custkey % 4 - 1) as off, c_custkey % 5 as s, (c_custkey % 3) / 2.0 as p, len(list_filter(range(8), lambda i: (c_custkey + i * 2) % 3 = 0)) + len(list_filter(range(8), lambda i: (c_custkey + i * 4) % 3 = 0)) as n from customer) select c_custkey, round(case off when 0 then 2.5 when 1 then 1.5 when 2 then 0.5 else 0 end + case when s = 2 then 1.5 else 0.3 end + p * 0.8 + p * 0.5 + least(n * 0.15, 1.0), 6) as score from v")
def _(t):
    score = personas.relevance(F.col("v"), F.col("budget"), F.col("season"), F.lit(1), F.lit(2), F.lit(True), F.lit(True))
    return travellers(t).select("c_custkey", r6(score).alias("score"))


@query("persona_conflicts")
def _(t):
    p = travellers(t)
    j = lookup.scored_pairs(p, p, "c_nationkey", "c_custkey", ["v"], lambda x, y: r6(personas.conflict(x["v"], y["v"], personas.weights("budget_war"))))
    return j.where("b > a").select("a", "b", F.col("score").alias("conflict"))


@query("conflict_select")
def _(t):
    p = travellers(t).withColumn("score", personas.relevance(F.col("v"), F.col("budget"), F.col("season"), F.lit(1), F.lit(2), F.lit(True), F.lit(False)))
    return personas.opponents(p, "c_nationkey", "c_custkey", "score", "v", [1.0] * 22, 4)


@query("mmr_select")
def _(t):
    rows = t.embeddings.withColumn("score", F.col("embedding")[0].cast("double"))
    return personas.spread(rows, "label", "vec_id", "score", "embedding", 5)


# groups


WISHES = "(select s_nationkey as g, s_suppkey as m, 'f.' || (i % 3) || '.' || i as field, (s_suppkey * (i + 1)) % 3 as value, (s_suppkey * 7 + i * 5) % 10 as alpha from supplier, range(5) r(i))"


def wishes(t):
    i = F.explode(F.sequence(F.lit(0), F.lit(4)))
    k = F.col("s_suppkey")
    return t.supplier.select(F.col("s_nationkey").alias("g"), k.alias("m"), k, i.alias("i")).select("g", "m", F.concat_ws(".", F.lit("f"), F.col("i") % 3, "i").alias("field"), ((k * (F.col("i") + 1)) % 3).alias("value"), ((k * 7 + F.col("i") * 5) % 10).alias("alpha"))


CONFLICTS = f"(select g, field, case when count_if(alpha >= 9) >= 2 and count(distinct value) filter (alpha >= 9) > 1 then 'hard' when count_if(alpha >= 4 and alpha < 9) >= 2 and count(distinct value) filter (alpha >= 4 and alpha < 9) > 1 then 'soft' else 'none' end as conflict from {WISHES} group by 1, 2)"


@query("conflict_fields", f"select * from {CONFLICTS}")
def _(t):
    return groups.field_conflicts(wishes(t), ["g"]).select("g", "field", "conflict")


@query("solvable_groups", f"select g, count_if(conflict = 'hard')::bigint as hard, count_if(conflict = 'soft')::bigint as soft, count_if(conflict = 'hard') = 0 and count_if(conflict = 'soft') >= 2 as solvable from {CONFLICTS} group by 1")
def _(t):
    return groups.solvable(groups.field_conflicts(wishes(t), ["g"]), ["g"]).drop("score")


@query("best_combo")
def _(t):
    return groups.best_combination(wishes(t), "g", "m", 3).select("g", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), r6("score").alias("score"))


# constraints on days made of orders: a customer is a trip, an order a day


@query("transport_constraint", "with k as (select o_custkey as plan, list(distinct case o_orderkey % 7 when 0 then 'Taxi' when 1 then 'Self-driving' when 2 then 'Flight' end) as k, arg_min(o_orderkey % 7 < 6, o_orderkey) as first from orders group by 1) select plan, first and not (list_contains(k, 'Self-driving') and list_contains(k, 'Flight')) and not (list_contains(k, 'Taxi') and list_contains(k, 'Self-driving')) as ok from k")
def _(t):
    said = F.element_at(lit_list(["Taxi", "Self-driving", "Flight Number: 1", "foot", "boat", "train", "-"]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    days = t.orders.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("day"), said.alias("transportation"))
    return constraints.transportation(days).select("plan", "ok")


@query("repeat_constraint", "select plan, max(n) = 1 as ok from (select l_orderkey as plan, l_suppkey, count(*) as n from lineitem group by 1, 2) group by 1")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("day"), F.lit(0).alias("place"), F.lit("lunch").alias("kind"), F.col("l_suppkey").alias("value"))
    return constraints.no_repeats(rows, constraints.MEALS).select("plan", "ok")


@query("coverage_constraint", "with g as (select o_custkey as plan, list(distinct o_orderpriority) as got from orders group by 1) select c_custkey as plan, case when c_custkey % 4 = 0 then null else coalesce(list_contains(got, '1-URGENT') and list_contains(got, '5-LOW'), false) end as ok from customer left join g on plan = c_custkey")
def _(t):
    got = t.orders.select(F.col("o_custkey").alias("plan"), F.array("o_orderpriority").alias("values"))
    asked = t.customer.select(F.col("c_custkey").alias("plan"), F.when(F.col("c_custkey") % 4 != 0, lit_list(["1-URGENT", "5-LOW"])).alias("cuisine"))
    return constraints.covered(got, asked, "cuisine").select("plan", "ok")


@query("preference_checks", "with s as (select s_nationkey as trip, avg(s_acctbal) as m, min(s_acctbal) as lo, max(s_acctbal) as hi, stddev_pop(s_acctbal) / avg(s_acctbal) * 100 as cv, avg(s_acctbal) > 0 as pos from supplier group by 1) select trip, 'accommodation_price' as kind, m between 1000 and 5000 as ok from s union all select trip, 'accommodation_rating', lo >= 500 from s union all select trip, 'flight_distance', hi <= 9000 from s union all select trip, 'price_consistency', case when pos then cv else 0 end < 20 or (select count(*) from supplier where s_nationkey = trip) < 2 from s union all select trip, 'baggage', m >= 150 from s")
def _(t):
    values = t.supplier.groupBy(F.col("s_nationkey").alias("trip")).agg(F.collect_list("s_acctbal").alias("numbers"))
    kinds = [("accommodation_price", "$1000-$5000"), ("accommodation_rating", "500"), ("flight_distance", "9000"), ("price_consistency", "consistent"), ("baggage", "checked_bag")]
    rows = values.select("trip", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(w).alias("wish")) for k, w in kinds))).alias("x"), "numbers", F.lit(None).cast("array<string>").alias("texts")).select("trip", "x.kind", "x.wish", "numbers", "texts")
    return preferences.judged(rows).select("trip", "kind", "ok")


# search and leaderboards


@query("select_relaxed", "with c as (select s_nationkey as trip, case when s_suppkey % 2 = 0 then 'hotel' else 'meal' end as kind, s_suppkey as item, row_number() over (partition by s_nationkey, s_suppkey % 2 order by 100 * (s_suppkey % 20) - 100 * round(abs(s_acctbal) / 100, 2) desc, s_suppkey) as n from supplier) select trip, kind, item from c where n <= case kind when 'hotel' then 1 else 2 end")
def _(t):
    return search.relaxed(choices(t), {"hotel": 1, "meal": 2}).select("trip", "kind", "item")


def choices(t):
    return t.supplier.select(F.col("s_nationkey").alias("trip"), F.when(F.col("s_suppkey") % 2 == 0, "hotel").otherwise("meal").alias("kind"), F.col("s_suppkey").alias("item"), F.round(F.abs("s_acctbal") / 100, 2).alias("cost"), (F.col("s_suppkey") % 20).alias("preference"))


@query("select_within_budget")
def _(t):
    return search.itinerary(choices(t), t.nation.select(F.col("n_nationkey").alias("trip"), (F.col("n_nationkey") * 10.0 + 20).alias("budget")), {"hotel": 1, "meal": 1})


@query("greedy_trips")
def _(t):
    table = lambda name, price, row: t.supplier.select(F.col("s_nationkey").alias("city"), F.col("s_name").alias("name"), F.abs(F.col("s_acctbal") + price).alias("price"), (F.col("s_suppkey") * row).alias("row_id"))
    trips = t.nation.select(F.col("n_nationkey").alias("trip"), F.col("n_nationkey").alias("city"), F.lit(3).alias("days"))
    return search.greedy_trips(trips, table("r", 0, 1), table("s", 100, 1), table("h", -500, 1))


@query("grounded_rows")
def _(t):
    rows = t.nation.select(F.col("n_nationkey").alias("plan"), F.lit(1).alias("day"), F.col("n_nationkey").alias("city"))
    return search.grounded(rows, t.supplier.select(F.col("s_nationkey").alias("city"), "s_name", "s_suppkey"), "city", 5)


@query("leaderboard", "with b as (select c_mktsegment || '/' || c_nationkey as model, arg_max(c_acctbal, (c_custkey)) as score, max(c_custkey) as updated from customer group by 1) select model, row_number() over (order by score desc, updated desc) as rank from b")
def _(t):
    rows = t.customer.select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("model"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("updated"))
    board = leaderboard.upsert(rows.where("updated % 2 = 0"), rows.where("updated % 2 = 1"), ["model"], "updated")
    return leaderboard.standing(board, ["score"], "updated").select("model", F.col("rank").cast("long").alias("rank"))


@query("resume_remaining", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 4)")
def _(t):
    return resume.not_done(t.orders, t.lineitem.where("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("windowed_events", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as rows, round(sum(value), 6) as total from events group by 1, 2")
def _(t):
    out = resume.windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "rows", r6("total").alias("total"))


@query("flattened_requests", "select conv_id || '_' || (row_number() over (partition by conv_id order by turn) - 1) as custom_id, turn, count(*) over (partition by conv_id) as n from conversations")
def _(t):
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return prepare.flattened(lists, "conv_id", "turns").select("custom_id", F.col("item").alias("turn"), "n")


@query("regrouped_results", "select conv_id, count_if(length(text) > 300)::bigint as ok, count(*) as n from conversations group by 1")
def _(t):
    asked = t.conversations.select("conv_id", F.concat_ws("_", "conv_id", "turn").alias("custom_id"))
    replies = t.conversations.select(F.concat_ws("_", "conv_id", "turn").alias("custom_id"), (F.char_length("text") > 300).alias("success"))
    return prepare.regrouped(asked, replies, "conv_id").withColumnRenamed("kept", "ok")


@query("plan_text", "select l_orderkey, string_agg(l_linenumber || ':' || l_partkey, '; ' order by l_linenumber, l_partkey) as text from lineitem group by 1")
def _(t):
    return prepare.rendered(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])


@query("cost_within_budget", "select o_orderkey, sum(ceil(l_quantity / 4) * l_extendedprice / 100) <= max(o_totalprice) / 10 as ok from orders join lineitem on l_orderkey = o_orderkey group by 1")
def _(t):
    cost = F.sum(numeric.party_units(F.col("l_quantity"), F.lit("Taxi")) * F.col("l_extendedprice") / 100)
    costs = t.lineitem.groupBy(F.col("l_orderkey").alias("plan")).agg(cost.alias("cost")).withColumn("evaluable", F.lit(True))
    asked = t.orders.select(F.col("o_orderkey").alias("plan"), (F.col("o_totalprice") / 10).alias("budget"))
    return constraints.within_budget(costs, asked).select(F.col("plan").alias("o_orderkey"), "ok")


