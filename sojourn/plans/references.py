"""Reference texts made of the driver's tables: literals, profiles of their sections, wishes held against them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators import constraints, prepare, profiles
from sojourn.operators.steps import shared_folder
from sojourn.plans.catalog import Tables, query
from sojourn.sources import tables
from sojourn.streaming import resume

LITERAL = """case c_custkey % 4 when 0 then concat('{''name'': "O''', c_custkey, '", ''k'': (', c_nationkey, ', None, True)}') when 1 then concat('(''a'', ', c_nationkey, ')') when 2 then concat('["say \\\\"', c_custkey, '\\\\"", ''x'']') else concat('{''b', c_nationkey, ''', ''a''}') end"""
SAID = """case c_custkey % 4 when 0 then concat('{"k":[', c_nationkey, ',null,true],"name":"O''', c_custkey, '"}') when 1 then concat('["a",', c_nationkey, ']') when 2 then concat('["say \\"', c_custkey, '\\"","x"]') else concat('["a","b', c_nationkey, '"]') end"""


@query("parsed_literals", f"select c_custkey, {SAID} as cell from customer")
def _(t: Tables):
    k, n, quote = F.col("c_custkey"), F.col("c_nationkey"), F.lit("'")
    cell = F.when(k % 4 == 0, F.concat(F.lit("{'name': \"O'"), k, F.lit("\", 'k': ("), n, F.lit(", None, True)}"))).when(k % 4 == 1, F.concat(F.lit("('a', "), n, F.lit(")"))).when(k % 4 == 2, F.concat(F.lit('["say \\"'), k, F.lit('\\"", '), quote, F.lit("x"), quote, F.lit("]"))).otherwise(F.concat(F.lit("{'b"), n, F.lit("', 'a'}")))
    return tables.parsed_cells(t.customer.select("c_custkey", cell.alias("cell")), ["cell"])


def references(t: Tables) -> DataFrame:
    """A reference per nation, as a literal: its suppliers as restaurants, its customers as lodgings, and a drive."""
    letter = lambda c: F.char(65 + c % 26)
    bar = F.concat(F.lit("Bar "), letter(F.col("s_suppkey")), F.lit(" "), F.col("s_suppkey") % 50 + 5, F.lit(" "), F.format_string("%.1f", (F.col("s_suppkey") % 41) / 10), F.when(F.col("s_suppkey") % 3 == 0, " Italian").otherwise(" Thai"))
    inn = F.concat(F.lit("Inn "), letter(F.col("c_custkey")), F.format_string(" %.1f %.1f %.1f ", (30 + F.col("c_custkey") % 97).cast("double"), (F.col("c_custkey") % 9).cast("double"), (F.col("c_custkey") % 41) / 10), 1 + F.col("c_custkey") % 6)
    content = lambda rows, line, by, order, head: rows.groupBy(F.col(by).alias("k")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: F.concat(F.lit("\\n"), x["l"])), "")).alias("c"))
    bars, inns = content(t.supplier, bar, "s_nationkey", "s_suppkey", "Name Cost Rating"), content(t.customer, inn, "c_nationkey", "c_custkey", "NAME price nights review people")
    section = lambda d, c: F.when(c.isNotNull(), F.concat(F.lit("{'Description': '"), F.lit(d), F.lit("', 'Content': '"), c, F.lit("'}")))
    drive = F.concat(F.lit("taxi, duration: "), F.col("k") % 7, F.lit(" hours "), F.col("k"), F.lit(" mins, distance: 9 km, cost: "), F.col("k") * 3)
    rows = t.nation.select(F.col("n_nationkey").alias("k")).join(bars.withColumnRenamed("c", "b"), "k", "left").join(inns.withColumnRenamed("c", "i"), "k", "left")
    parts = F.concat_ws(", ", section("Restaurants in town", F.col("b")), section("Accommodations in town", F.col("i")), section("Taxi to town", drive))
    return rows.select("k", F.concat(F.lit("["), parts, F.lit("]")).alias("reference"))


BARS = "(select s_nationkey as k, s_suppkey % 50 + 5 as cost, (s_suppkey % 41) / 10.0 as rating from supplier)"
INNS = "(select c_nationkey as k, 30.0 + c_custkey % 97 as price, c_custkey % 9 as nights, (c_custkey % 41) / 10.0 as review, 1 + c_custkey % 6 as people from customer)"
DRIVES = "(select n_nationkey as k, n_nationkey * 3.0 as cost, n_nationkey % 7 * 60.0 + n_nationkey as minutes from nation)"
PROFILE = " union all ".join(
    [f"select k, '{t}' as \"table\", '{f}' as field, 'number' as type, count(*) as count, min({c})::double as least, max({c})::double as most, null as \"values\" from {source} group by 1" for source, t, f, c in ((BARS, "restaurant", "restaurant.avg_cost", "cost"), (BARS, "restaurant", "restaurant.rating", "rating"), (INNS, "accommodation", "accommodation.price", "price"), (INNS, "accommodation", "accommodation.minimum_nights", "nights"), (INNS, "accommodation", "accommodation.review", "review"), (INNS, "accommodation", "accommodation.maximum_occupancy", "people"), (DRIVES, "ground", "ground.taxi_cost", "cost"), (DRIVES, "ground", "ground.taxi_duration_minutes", "minutes"))]
    + [f"select k, '{t}', '{t}.rows', 'rows', count(*) - 1, null, null, null from {source} group by 1" for source, t in ((BARS, "restaurant"), (INNS, "accommodation"))]
    + [f"select k, '{t}', '{t}', 'section', 1, null, null, null from {source} group by 1" for source, t in ((BARS, "restaurant"), (INNS, "accommodation"), (DRIVES, "ground"))]
    + ["select distinct s_nationkey, 'restaurant', 'restaurant.cuisine', 'values', 1, null::double, null::double, 'Italian' from supplier where s_suppkey % 3 = 0"]
)


def profiled(t: Tables) -> DataFrame:
    return profiles.profile(profiles.sections(references(t), "k", "reference"), "k")


@query("reference_profile", PROFILE)
def _(t: Tables):
    return profiled(t).withColumn("values", F.array_join("values", ","))


FAULTS = """with p as (select s_nationkey as k, min((s_suppkey % 41) / 10.0) as lo, max((s_suppkey % 41) / 10.0) as hi, bool_or(s_suppkey % 3 = 0) as italian from supplier group by 1)
select o_orderkey, concat_ws(',', case when o_orderkey % 11 = 0 then 'missing_description' end, case when o_orderkey % 7 = 0 then 'alpha_beta_inconsistent' end, case when o_orderkey % 7 = 0 and o_orderkey % 2 = 0 then 'hard_beta_too_high' end,
  case when o_orderkey % 3 = 1 and ((k is not null and italian and o_orderkey % 5 <> 0) or ((k is null or not italian) and o_orderkey % 5 = 1)) then 'cuisine_not_allowed' end, case when o_orderkey % 3 = 2 and o_orderkey % 5 = 0 then 'time_format' end,
  case when o_orderkey % 3 = 0 and (o_orderkey % 13 = 0 or (o_orderkey % 2 = 0 and (o_orderkey % 60) / 10.0 > coalesce(hi, 5))) then 'numeric_infeasible_or_noop' end) as faults from orders left join p on k = o_custkey % 25"""


@query("wish_faults", FAULTS)
def _(t: Tables):
    o = F.col("o_orderkey")
    field = F.when(o % 3 == 0, "restaurant.rating").when(o % 3 == 1, "restaurant.cuisine").otherwise("flight.depart_time")
    cuisine = F.when(o % 5 == 0, '["Italian"]').when(o % 5 == 1, '["Thai"]').otherwise('["French"]')
    value = F.when(o % 3 == 0, F.when(o % 13 == 0, '"x"').otherwise(((o % 60) / 10).cast("string"))).when(o % 3 == 1, cuisine).otherwise(F.when(o % 5 == 0, '"7:30"').otherwise('"07:30"'))
    wishes = t.orders.select("o_orderkey", (F.col("o_custkey") % 25).alias("k"), field.alias("field"), F.lit(">=").alias("op"), value.alias("value"), (o % 2 == 0).alias("hard"), F.lit(0.9).alias("alpha"), F.when(o % 7 == 0, 0.4).otherwise(0.1).alias("beta"), F.when(o % 11 == 0, "bad").otherwise("good enough").alias("description"))
    return profiles.wish_faults(wishes, profiled(t), "k", strict=True).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


# what is kept of runs


@query("notebook", "select 0 as note, 'suppliers of nation 3, again' as title, (select count(*) from supplier where s_nationkey = 3) as rows union all select 1, 'customers', (select count(*) from customer)")
def _(t: Tables):
    book = prepare.Notebook(t.spark, f"notes_{uuid.uuid4().hex[:8]}")
    book.write(t.supplier, "suppliers")
    book.write(t.customer.select("c_custkey"), "customers")
    book.update(0, t.supplier.where("s_nationkey = 3").select("s_suppkey"), "suppliers of nation 3, again")
    parts = [book.read(n["index"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n["index"]).alias("note"), F.lit(n["note"]).alias("title"), "rows") for n in book.list()]
    return parts[0].unionByName(parts[1])


@query("row_by_place", "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1 offset 41")
def _(t: Tables):
    got = prepare.nth_row(t.orders, [(F.col("o_totalprice"), True), (F.col("o_orderkey"), False)], 41, ["o_orderkey"], ["o_custkey", "o_totalprice"])
    return got.select("meta.o_orderkey", "references.o_custkey", "references.o_totalprice")


@query("written_artefacts", "select 'regions' as kind, r_regionkey as key, r_name as name from region union all select 'nations', n_nationkey, n_name from nation")
def _(t: Tables):
    kinds = {"regions": t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "nations": t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))}
    paths = prepare.write_artefacts(kinds, shared_folder(t.spark, "artefacts"))
    parts = [t.spark.read.schema("key long, name string").json(p).select(F.lit(k).alias("kind"), "key", "name") for k, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("resumed_run", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def _(t: Tables):
    """A run over customers goes on with those that its log, the large orders, hasn't; it would stop if its examples had changed."""
    examples = t.customer.select("c_custkey")
    prepare.check_resumable({"model": "m", "seed": 1}, {"model": "m", "seed": 2}, examples, t.customer.select("c_custkey"), "c_custkey", ("model",))
    return resume.not_done(examples, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("wished_cuisines", "with r as (select p_partkey as row_id, concat('R', p_partkey % 11) as name, concat('c', p_partkey % 5) as city, p_partkey % 3 as k from part where p_partkey % 11 < 11), m as (select o_custkey as plan, o_orderkey as day, 0 as place, concat('R', o_orderkey % 11) as name, concat('c', o_orderkey % 5) as city from orders union all select o_custkey, o_orderkey, 1, concat('R', (o_orderkey + 3) % 11), concat('c', (o_orderkey + 1) % 5) from orders), h as (select plan, day, min(place) as place from m where city = 'c0' group by 1, 2), f as (select m.plan, m.day, m.place, arg_min(r.k, r.row_id) as k from m left join h using (plan, day) join r on r.city = m.city and contains(r.name, m.name) where h.place is null or m.place < h.place group by 1, 2, 3), g as (select plan, list(distinct concat('K', k)) as got from f group by 1) select q.plan, len(list_intersect(['K0', concat('K', q.plan % 3)], coalesce(got, []))) = len(list_distinct(['K0', concat('K', q.plan % 3)])) as ok from (select distinct o_custkey as plan from orders) q left join g using (plan)")
def _(t: Tables):
    o, meal = F.col("o_orderkey"), lambda i: F.concat(F.lit("R"), (F.col("o_orderkey") + 3 * i) % 11, F.lit(", c"), (F.col("o_orderkey") + i) % 5)
    days = t.orders.select(F.col("o_custkey").alias("plan"), o.alias("day"), meal(0).alias("breakfast"), meal(1).alias("lunch"), F.lit("-").alias("dinner"), F.lit("-").alias("attraction"), F.lit("-").alias("accommodation"))
    asked = days.select("plan").distinct().select("plan", F.lit("c0").alias("org"), F.array_distinct(F.array(F.lit("K0"), F.concat(F.lit("K"), F.col("plan") % 3))).alias("cuisine"))
    table = t.part.selectExpr("p_partkey as row_id", "concat('R', p_partkey % 11) as name", "concat('c', p_partkey % 5) as city", "concat('Tea, K', p_partkey % 3) as cuisines")
    return constraints.covered(constraints.cuisine_values(days, asked, table), asked, "cuisine").select("plan", "ok")
