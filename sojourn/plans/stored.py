"""Queries that write the driver's tables in the sandbox's file forms and read them back, and what is chosen or checked row by row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sojourn.functions import numeric, text
from sojourn.operators import constraints, groups, leaderboard, lookup, personas, preferences, prepare, search, windows
from sojourn.plans.catalog import SQL, Tables, query, r6
from sojourn.plans.preparing import drawn
from sojourn.sources import tables
from sojourn.streaming import resume


def folder(t: Tables, label: str) -> str:
    """A new folder that all executors share."""
    conf = t.spark.conf
    return f"{(conf.get('spark.checkpoint.dir', None) or conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def customers_csv(t: Tables) -> str:
    path, k = folder(t, "csv"), F.col("c_custkey")
    t.customer.select(k.alias("id"), F.when(k % 7 > 0, F.col("c_name")).alias("name"), F.when(k % 5 > 0, F.col("c_nationkey")).alias("nation")).write.option("header", True).csv(path)
    return path


@query("complete_csv", "select c_custkey as id, c_name as name from customer where c_custkey % 7 > 0 and c_custkey % 5 > 0")
def _(t):
    return tables.complete_csv(t.spark, customers_csv(t), ["id", "name"], "id long, name string, nation int").drop("row_id")


@query("projected_csv", "select c_custkey as id, c_name as name from customer where c_custkey % 7 > 0")
def _(t):
    return tables.projected_csv(t.spark, customers_csv(t), ["id", "name"], "id long, name string, nation int").drop("row_id")


@query("raw_csv", "select c_custkey as id, case when c_custkey % 7 > 0 then c_name end as title, case when c_custkey % 5 > 0 then c_nationkey end as nation from customer")
def _(t):
    return tables.raw_csv(t.spark, customers_csv(t), {"name": "title"}).drop("row_id").withColumn("id", F.col("id").cast("long"))


@query("dated_rows", "select o_orderkey, o_orderdate::date as day from orders where o_orderkey % 6 > 1")
def _(t):
    said = F.when(F.col("o_orderkey") % 6 > 1, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 6 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return tables.dated(t.orders.select("o_orderkey", said.alias("day")), "day").select("o_orderkey", "day")


@query("strict_json", "select c_custkey, c_name from customer")
def _(t):
    path = folder(t, "json")
    tables.write_rows(t.customer.select("c_custkey", "c_name"), path)
    return tables.strict_json(t.spark, path, "c_custkey long, c_name string")


@query("tolerant_json", "select c_custkey % 100 as id, max(c_custkey) as k from customer where c_custkey % 9 > 1 group by 1")
def _(t):
    path, k = folder(t, "lines"), F.col("c_custkey")
    line = F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.lit('{"id": ')).otherwise(F.to_json(F.struct((k % 100).alias("id"), k.alias("k"))))
    t.customer.orderBy("c_custkey").coalesce(1).select(line.alias("value")).write.text(path)
    return tables.tolerant_json(t.spark, path, "id long, k long", "id").select("id", "k")


@query("numbered_examples", "select case when k % 4 = 0 then concat('own', k) else concat('list_', lpad((row_number() over (order by k) - 1)::varchar, 5, '0')) end as id, concat('q', k) as query, concat('l', k % 3) as level, 1 as more from (select n_nationkey as k from nation) where k % 5 > 0")
def _(t):
    path, k = folder(t, "examples"), F.col("n_nationkey")
    row = F.to_json(F.struct(F.when(k % 4 == 0, F.concat(F.lit("own"), k)).alias("id"), F.when(k % 5 > 0, F.concat(F.lit("q"), k)).alias("query"), F.concat(F.lit("l"), k % 3).alias("level"), F.lit("x").alias("other")))
    t.nation.orderBy(k).coalesce(1).select(row.alias("value")).write.text(path)
    return tables.examples(t.spark, path, "list", ["query", "level"]).select("id", "query", "level", F.size("metadata").alias("more"))


@query("cities_of_states", "select concat('r', n_regionkey) as state, array_to_string(list_sort(list(n_name)), ',') as citys from nation group by 1")
def _(t):
    path = folder(t, "pairs")
    t.nation.select("n_name", F.concat(F.lit("r"), "n_regionkey")).write.option("sep", "\t").csv(path)
    return tables.fanned(tables.pairs(t.spark, path), "state", "city").select("state", F.array_join("citys", ",").alias("citys"))


@query("json_documents", "select n_nationkey, n_name, 1 as files from nation")
def _(t):
    path = folder(t, "documents")
    t.nation.select("n_nationkey", "n_name").write.option("maxRecordsPerFile", 1).json(path)
    docs = tables.documents(t.spark, path, "n_nationkey int, n_name string")
    each = docs.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("files"))
    return docs.join(each, "file").select("n_nationkey", "n_name", "files")


@query("table_catalogue", "select * from (values ('customers', 'id'), ('customers', 'name'), ('customers', 'nation')) t(\"table\", \"column\")")
def _(t):
    return tables.catalogue(t.spark, {"customers": customers_csv(t), "nothing": folder(t, "none")}).select("table", "column")


@query("numbered_documents", "select concat('plan_', row_number() over (order by s_name, s_suppkey), '.json') as document, concat('{\"s_name\":\"', s_name, '\",\"s_suppkey\":', s_suppkey, '}') as body from supplier")
def _(t):
    return tables.numbered_documents(t.supplier.select("s_name", "s_suppkey"), ["s_name", "s_suppkey"], "plan")


@query("parsed_cells", "select c_custkey, case c_custkey % 4 when 0 then concat('[', c_nationkey, ']') when 1 then concat('{\"a\":\"x\",\"b\":null}') when 2 then concat('\"', c_name, '\"') else 'true' end as cell from customer")
def _(t):
    k = F.col("c_custkey")
    cell = F.when(k % 4 == 0, F.concat(F.lit("[ "), "c_nationkey", F.lit(" ]"))).when(k % 4 == 1, F.lit("{'a': 'x', 'b': None}")).when(k % 4 == 2, F.col("c_name")).otherwise("True")
    return tables.parsed_cells(t.customer.select("c_custkey", cell.alias("cell")), ["cell"])


@query("markdown_board", "select n_name as model, n_regionkey::varchar as score from nation")
def _(t):
    path = folder(t, "board")
    lines = leaderboard.markdown(t.nation.withColumnsRenamed({"n_name": "model", "n_regionkey": "score"}), ["model", "score"], "model").split("\n")  # one row per nation
    t.spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return leaderboard.parse_markdown(t.spark.read.text(path), ["model", "score"])


@query("first_rows", "select c_custkey from customer order by c_acctbal desc, c_custkey limit 20")
def _(t):
    return tables.first_rows(t.customer, [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey")


@query("appended_log", "select o_orderkey, o_totalprice from orders")
def _(t):
    path = folder(t, "stream")
    t.orders.select("o_orderkey", "o_totalprice").write.parquet(path)
    stream = t.spark.readStream.schema("o_orderkey long, o_totalprice double").parquet(path)
    log = folder(t, "log")
    for _ in range(2):  # a restart adds nothing that is there
        resume.append_log(stream, lambda b: b, log, f"{path}-checkpoint").awaitTermination()
    return resume.committed(t.spark, log, "o_orderkey long, o_totalprice double")


# choices


@query("weighted_picks", f"with k as (select s_nationkey, s_suppkey, ln(({drawn(chr(39) + '5' + chr(39), 's_suppkey')} + 1) / 4294967297.0) / (1 + s_suppkey % 5) as x from supplier) select s_nationkey, arg_max(s_suppkey, (x, -s_suppkey)) as s_suppkey from k group by 1")
def _(t):
    rows = t.supplier.select("s_nationkey", "s_suppkey", (1 + F.col("s_suppkey") % 5).alias("w"))
    return personas.weighted_pick(rows, ["s_nationkey"], "w", "s_suppkey", 5).select("s_nationkey", "s_suppkey")


COSINE = "(1 - list_cosine_similarity({0}.embedding::double[], {1}.embedding::double[]))"
SPREAD = "with e as (select label, vec_id, embedding, embedding[1]::double as s from embeddings), a as (select label, arg_max(vec_id, (s, -vec_id)) as vec_id, arg_max(embedding, (s, -vec_id)) as embedding from e group by 1), f as (select e.*, {c1} as x from e join a using (label) where e.vec_id <> a.vec_id), b as (select label, arg_max(vec_id, (0.6 * s - 0.4 * (1 - x), -vec_id)) as vec_id, arg_max(embedding, (0.6 * s - 0.4 * (1 - x), -vec_id)) as embedding from f group by 1), g as (select f.label, f.vec_id, s, least(x, {c2}) as x from f join b using (label) where f.vec_id <> b.vec_id), c as (select label, arg_max(vec_id, (0.6 * s - 0.4 * (1 - x), -vec_id)) as vec_id from g group by 1) select label, vec_id, 1::bigint as place from a union all select label, vec_id, 2 from b union all select label, vec_id, 3 from c".format(c1=COSINE.format("e", "a"), c2=COSINE.format("f", "b"))


@query("spread_of_groups", SPREAD)
def _(t):
    rows = t.embeddings.withColumn("score", F.col("embedding")[0].cast("double")).withColumn("v", F.col("embedding").cast("array<double>"))
    return personas.spread(rows, "label", "vec_id", "score", "v", 3, candidates=0)


@query("grounded_in_rows", f"with s as (select s_nationkey as city, s_suppkey, row_number() over (partition by s_nationkey order by s_name, s_suppkey) as i, count(*) over (partition by s_nationkey) as n from supplier) select c_custkey as plan, s_suppkey from customer join s on city = c_nationkey and i = {drawn(chr(39) + '9' + chr(39), 'c_custkey', '1')} % n + 1")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("plan"), F.lit(1).alias("day"), F.col("c_nationkey").alias("city"))
    return search.grounded(rows, t.supplier.select(F.col("s_nationkey").alias("city"), "s_name", "s_suppkey"), "city", 9).select("plan", "s_suppkey")


RANKED = "(select s_nationkey as city, s_name as name, row_number() over (partition by s_nationkey order by {}, s_suppkey) as i from supplier)"


@query("greedy_days", f"with d as (select n_nationkey as trip, unnest([1, 2, 3]) as day from nation), r as {RANKED.format('abs(s_acctbal)')} select d.trip, d.day, b.name as breakfast, l.name as lunch, e.name as dinner, a.name as attraction, h.name as accommodation from d left join r b on b.city = trip and b.i = 3 * (day - 1) + 1 left join r l on l.city = trip and l.i = 3 * (day - 1) + 2 left join r e on e.city = trip and e.i = 3 * (day - 1) + 3 left join {RANKED.format('abs(s_acctbal + 100)')} a on a.city = trip and a.i = day left join {RANKED.format('abs(s_acctbal - 500)')} h on h.city = trip and h.i = 1")
def _(t):
    table = lambda more: t.supplier.select(F.col("s_nationkey").alias("city"), F.col("s_name").alias("name"), F.abs(F.col("s_acctbal") + more).alias("price"), F.col("s_suppkey").alias("row_id"))
    trips = t.nation.select(F.col("n_nationkey").alias("trip"), F.col("n_nationkey").alias("city"), F.lit(3).alias("days"))
    return search.greedy_trips(trips, table(0), table(100), table(-500)).drop("city")


GREEDY = f"""with q as (select c_custkey as trip, [3, 5, 7][(c_custkey % 3)::int + 1] as days, [concat('c', c_custkey % 25), concat('c', (c_custkey + 1) % 25), concat('c', (c_custkey + 2) % 25), concat('c', (c_custkey + 3) % 25)] as cities from customer),
d as (select *, unnest(range(1, days + 1)) as day from q), l as (select *, case when day % 2 = 1 then cities[((day - 1) // 2)::int + 1] end as o, case when day % 2 = 1 then case when day = days then cities[1] else cities[((day - 1) // 2)::int + 2] end end as t, concat('d', (trip + day) % 4) as date from d),
m as (select *, coalesce(t, cities[(day // 2)::int + 1]) as city from l),
f as (select concat('c', p_partkey % 25) as o, concat('c', (p_partkey * 7) % 25) as t, concat('d', p_partkey % 4) as date, arg_min(concat('F', p_partkey), (p_size, p_partkey)) as number, min(p_size) as price from part group by 1, 2, 3),
g as (select concat('c', n_nationkey) as o, concat('c', n_nationkey + 1) as t, n_nationkey * 30 as km from nation),
s as (select concat('c', s_nationkey % 23) as city, s_name as name, abs(s_acctbal) as price, s_suppkey as row_id, row_number() over (partition by s_nationkey % 23 order by s_suppkey) as i, count(*) over (partition by s_nationkey % 23) as n from supplier),
b as (select city, arg_min(name, (price, row_id)) as name from s group by 1),
x as (select m.*, f.number, case when f.price is not null and f.price <= coalesce(floor(km * 0.05), 1e9) then concat('Flight Number: ', f.number) when km is not null then 'Self-driving' end as way, b.name as meal, s.name as sight from m left join f using (o, t, date) left join g using (o, t) left join b using (city) left join s on s.city = m.city and s.i = {drawn("'4'", "m.trip", "m.day")} % s.n + 1)
select trip, day::int as day, case when o is not null then concat('from ', o, ' to ', t) else city end as current_city, case when o is not null and way is not null then concat(way, ', from ', o, ' to ', t) else '-' end as transportation, case when meal is not null then concat(meal, ', ', city) else '-' end as lunch, case when sight is not null then concat(sight, ', ', city) else '-' end as attraction, case when meal is not null and day < days then concat(meal, ', ', city) else '-' end as accommodation, concat_ws(',', case when o is not null and way is null then 'transportation' end, case when meal is null then 'meal' end, case when sight is null then 'attraction' end, case when day < days and meal is null then 'accommodation' end) as fault from x"""


@query("greedy_plans", GREEDY)
def _(t):
    k = F.col("c_custkey")
    cities = F.array(*(F.concat(F.lit("c"), (k + i) % 25) for i in range(4)))
    trips = t.customer.select(k.alias("trip"), F.get(F.array(F.lit(3), F.lit(5), F.lit(7)), (k % 3).cast("int")).alias("days"), cities.alias("cities"), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda d: F.concat(F.lit("d"), (k + d) % 4)).alias("dates"))
    p = F.col("p_partkey")
    flights = t.part.select(p.alias("row_id"), F.concat(F.lit("F"), p).alias("flight_number"), F.concat(F.lit("c"), p % 25).alias("origin"), F.concat(F.lit("c"), (p * 7) % 25).alias("dest"), F.concat(F.lit("d"), p % 4).alias("date"), F.col("p_size").alias("price"))
    n = F.col("n_nationkey")
    roads = t.nation.select(F.concat(F.lit("c"), n).alias("origin"), F.concat(F.lit("c"), n + 1).alias("destination"), (n * 30).alias("km"))
    places = t.supplier.select(F.concat(F.lit("c"), F.col("s_nationkey") % 23).alias("city"), F.col("s_name").alias("name"), F.abs("s_acctbal").alias("price"), F.col("s_suppkey").alias("row_id"))
    return search.greedy_plans(trips, flights, roads, places, places, places, 4).drop("breakfast", "dinner")


WORTH = "100 * pref - 100 * price"
SOLVED = f"""with t as (select n_nationkey as trip, concat('c', n_nationkey % 5) as o, concat('c', (n_nationkey + 1) % 5) as d from nation),
x as (select p_partkey as item, concat('c', p_partkey % 5) as o, concat('c', (p_partkey + case when p_partkey % 2 = 0 then 1 else 4 end) % 5) as d, p_size::double as price, concat('k', p_partkey % 3) as category, case when p_partkey % 4 = 0 then 'Private room' else 'Shared room' end as room from part),
c as (select trip, 'outbound' as kind, item, price, 0 as pref from t join x using (o, d) union all select trip, 'return', item, price, 0 from t join x on x.o = t.d and x.d = t.o union all select trip, 'hotel', item, price * 3, case when room = 'Private room' then 20 else 0 end from t join x on x.o = t.d union all select trip, 'origin_restaurant', item, price, case when category = 'k1' then 10 else 1 end from t join x on x.o = t.o union all select trip, 'restaurant', item, price, case when category = 'k1' then 10 else 1 end from t join x on x.o = t.d union all select trip, 'attraction', item, 15.0, 1 from t join x on x.o = t.d),
r as (select *, row_number() over (partition by trip, kind order by {WORTH} desc, item) as n from c),
w as (select * from r where n <= case kind when 'restaurant' then 8 when 'attraction' then 6 else 1 end)
select trip, kind, item from w where trip in (select trip from w group by 1 having count(*) = 18) union all select trip, null, null from t where trip not in (select trip from w group by 1 having count(*) = 18)"""


@query("solved_trips", SOLVED)
def _(t):
    n, p = F.col("n_nationkey"), F.col("p_partkey")
    city = lambda c, i: F.concat(F.lit("c"), (c + i) % 5)
    trips = t.nation.select(n.alias("trip"), city(n, 0).alias("org"), city(n, 1).alias("dest"), F.lit(3).alias("days"), F.lit(1e9).alias("budget"), F.array(F.lit("k1")).alias("preferred"), F.lit("private").alias("room_type"))
    part = t.part.select(p.alias("name"), city(p, 0).alias("city"), city(p, 0).alias("origin"), F.when(p % 2 == 0, city(p, 1)).otherwise(city(p, 4)).alias("dest"), F.col("p_size").cast("double").alias("price"), F.concat(F.lit("k"), p % 3).alias("cuisines"), F.lit("").alias("house_rules"))
    found = prepare.candidates(trips, part, part, part, part)
    rooms = F.when(F.col("kind") == "hotel", F.when(F.col("item") % 4 == 0, "Private room").otherwise("Shared room"))
    return search.solved_trips(found.withColumn("room_type", rooms), trips.drop("org", "dest")).select("trip", "kind", "item")


# travellers and groups


@query("decoded_interests", "select c_custkey, array_to_string(list_transform(list_filter([c_custkey % 5, c_custkey % 11, 3, c_custkey % 7], lambda c: c < 8), lambda c: ['n0', 'n1', 'n2', 'n3', 'n4', 'n5', 'n6', 'n7'][c::int + 1])[:3], ',') as names from customer")
def _(t):
    k = F.col("c_custkey")
    codes = F.concat(F.lit("["), F.concat_ws(", ", k % 5, k % 11, F.lit(3), k % 7), F.lit("]"))
    return t.customer.select(k, F.array_join(personas.decoded(codes, [f"n{i}" for i in range(8)], 3), ",").alias("names"))


@query("adaptive_weights", "with f as (select c_custkey as k, c_custkey % 5 < 2 as tight, c_custkey % 6 < 4 as short, 1 + c_custkey % 7 >= 4 as many from customer) select k, case when tight then 3.0 else 1.0 end::double as budget, case when short then 3.5 else 1.0 end::double as pace, case when many then 2.0 when short then 2.5 else 1.0 end::double as taste, 1.0::double as rest from f")
def _(t):
    k = F.col("c_custkey")
    people, days = 1 + k % 7, k % 6
    w = personas.adaptive_weights(F.when(k % 5 < 2, F.lit(1.0)).otherwise(F.lit(1e6)), people, F.greatest(days, F.lit(1)))
    return t.customer.select(k.alias("k"), w[0].alias("budget"), w[3].alias("pace"), w[7].alias("taste"), w[20].alias("rest"))


APART = "sqrt(power(abs((a.k % 4) - (b.k % 4)) / 3.0 * 3.0, 2) + power(abs((a.k % 3) - (b.k % 3)) / 2.0, 2))"


@query("vector_conflicts", f"with c as (select c_custkey as k, c_nationkey from customer) select a.k as a, b.k as b, round({APART} / sqrt(9.0 + 0.25 + 2.25 + 19), 6) as conflict from c a join c b using (c_nationkey) where b.k <> a.k")
def _(t):
    k = F.col("c_custkey")
    v = F.array((k % 4) / 3.0, F.lit(0.0), F.lit(0.0), F.lit(0.0), (k % 3) / 2.0, F.lit(0.0), *(F.lit(1.0) for _ in range(16)))
    rows = t.customer.select("c_custkey", "c_nationkey", v.alias("v"))
    j = lookup.scored_pairs(rows, rows, "c_nationkey", "c_custkey", ["v"], lambda x, y: r6(personas.conflict(x["v"], y["v"], personas.weights("budget_war"))))
    return j.where("b <> a").select("a", "b", F.col("score").alias("conflict"))


@query("group_scores", "with w as (select s_nationkey as g, 'f' || (i % 3) || '.' || i as field, (s_suppkey * (i + 1)) % 3 as value, 4 + (s_suppkey * 7 + i) % 5 as alpha from supplier, range(4) r(i)), f as (select g, field, count(*) as n, count(distinct value) as v, sum(alpha) as x, sum(alpha * alpha) as x2 from w group by 1, 2), s as (select g, count(*) as soft, count(distinct split_part(field, '.', 1)) as c, sum(n) as n, sum(x) as x, sum(x2) as x2 from f where n >= 2 and v > 1 group by 1), g as (select distinct s_nationkey as g from supplier) select g, round(case when soft >= 2 then soft + 2.0 * c + 0.5 * sqrt(greatest(x2 / n - power(x / n, 2), 0)) else -1 end, 6) as score from g left join s using (g) where g in (select g from f)")
def _(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.col("s_nationkey").alias("g"), k, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    wishes = rows.select("g", F.concat(F.lit("f"), F.col("i") % 3, F.lit("."), "i").alias("field"), ((k * (F.col("i") + 1)) % 3).alias("value"), (4 + (k * 7 + F.col("i")) % 5).alias("alpha"))
    return groups.solvable(groups.field_conflicts(wishes, ["g"]), ["g"]).select("g", r6("score").alias("score"))


CHOSEN = "select s_nationkey as g, s_suppkey as m, 'f' || (i % 3) || '.' || i as field, (s_suppkey * (i + 1)) % 3 as value, 4 + (s_suppkey * 7 + i) % 5 as alpha from supplier, range(4) r(i)"


@query("best_combinations", f"with w as ({CHOSEN}), m as (select distinct g, m from w), k as (select a.g, a.m as a, b.m as b, c.m as c from m a join m b on a.g = b.g and a.m < b.m join m c on b.g = c.g and b.m < c.m), f as (select k.g, a, b, c, field, count(*) as n, count(distinct value) as v, sum(alpha) as x, sum(alpha * alpha) as x2 from k join w on w.g = k.g and w.m in (a, b, c) group by 1, 2, 3, 4, 5), s as (select g, a, b, c, count(*) as soft, count(distinct split_part(field, '.', 1)) as y, sum(n) as n, sum(x) as x, sum(x2) as x2 from f where n >= 2 and v > 1 group by 1, 2, 3, 4), z as (select *, round(soft + 2.0 * y + 0.5 * sqrt(greatest(x2 / n - power(x / n, 2), 0)), 9) as score from s where soft >= 2) select g, arg_max(concat_ws(',', a, b, c), (score, -a, -b, -c)) as members, round(max(score), 6) as score from z group by 1")
def _(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.col("s_nationkey").alias("g"), k.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    wishes = rows.select("g", "m", F.concat(F.lit("f"), F.col("i") % 3, F.lit("."), "i").alias("field"), ((F.col("m") * (F.col("i") + 1)) % 3).alias("value"), (4 + (F.col("m") * 7 + F.col("i")) % 5).alias("alpha"))
    return groups.best_combination(wishes, "g", "m", 3).select("g", F.array_join("members", ",").alias("members"), r6("score").alias("score"))


FAR = "sqrt(power(({0}.k % 4 - {1}.k % 4) / 3.0, 2) + power(({0}.k % 3 - {1}.k % 3) / 2.0, 2)) / sqrt(22.0)"
OPPONENTS = "with p as (select c_nationkey as g, c_custkey as k, (c_custkey * 7) % 101 / 10.0 as s from customer), a as (select g, arg_max(k, (s, -k)) as k from p group by 1), f as (select p.*, {a} as x from p join a using (g) where p.k <> a.k), b as (select g, arg_max(k, (round(0.6 * s + 0.4 * x, 12), -k)) as k from f group by 1), h as (select f.g, f.k, s, least(x, {b}) as x from f join b using (g) where f.k <> b.k), c as (select g, arg_max(k, (round(0.6 * s + 0.4 * x, 12), -k)) as k from h group by 1) select g, k, 1::bigint as place from a union all select g, k, 2 from b union all select g, k, 3 from c".format(a=FAR.format("p", "a"), b=FAR.format("f", "b"))


@query("opponents_of_groups", OPPONENTS)
def _(t):
    k = F.col("c_custkey")
    v = F.array((k % 4) / 3.0, F.lit(0.0), F.lit(0.0), F.lit(0.0), (k % 3) / 2.0, F.lit(0.0), *(F.lit(1.0) for _ in range(16)))
    pool = t.customer.select(F.col("c_nationkey").alias("g"), k.alias("k"), ((k * 7) % 101 / 10.0).alias("s"), v.alias("v"))
    return personas.opponents(pool, "g", "k", "s", "v", [1.0] * 22, 3, candidates=0)


@query("validated_constraints", "select o_orderkey, array_to_string(list_filter([case when o_orderkey % 7 = 0 then 'invalid field' end, case when o_orderkey % 11 = 0 then 'invalid op' end, case when o_orderkey % 7 > 0 and o_orderkey % 11 > 0 and o_totalprice < 1000 then 'infeasible' end, case when o_orderkey % 7 > 0 and o_orderkey % 11 > 0 and o_totalprice >= 300000 then 'no_op' end], lambda e: e is not null), ',') as errors from orders")
def _(t):
    k = F.col("o_orderkey")
    asked = t.orders.select(k, F.when(k % 7 == 0, "odd").otherwise("price").alias("field"), F.when(k % 11 == 0, "~").otherwise("<=").alias("op"), F.col("o_totalprice").alias("number"), F.lit(None).cast("string").alias("item"))
    ranges = t.spark.createDataFrame([("price", 1000.0, 300000.0)], "field string, lo double, hi double")
    enums = t.spark.createDataFrame([("kind", ["a"])], "field string, items array<string>")
    return groups.validated(asked, ranges, enums).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("plan_marks", "select o_orderkey, (o_orderstatus = 'F') as optimal, o_totalprice <= 150000 as within_budget, o_orderkey % 4 = 3 as days_ok, round(((o_orderstatus = 'F')::int + (o_totalprice <= 150000)::int + (o_orderkey % 4 = 3)::int) / 3, 6) as score from orders")
def _(t):
    out = groups.evaluated(t.orders, F.col("o_orderstatus") == "F", F.col("o_totalprice"), F.lit(150000), F.col("o_orderkey") % 4, F.lit(3))
    return out.select("o_orderkey", "optimal", "within_budget", "days_ok", r6("score").alias("score"))


@query("first_solvable_round", "with m as (select s_nationkey as g, s_suppkey as k, ceil(row_number() over (partition by s_nationkey order by s_suppkey) / 2)::bigint as round from supplier), w as (select m.*, i, (k * (i + 1)) % 3 as value, 4 + (k * 7 + i) % 5 as alpha from m, range(3) r(i)), u as (select a.g, a.round as upto, w.i, count(*) as n, count(distinct value) as v from (select distinct g, round from m) a join w on w.g = a.g and w.round <= a.round group by 1, 2, 3), s as (select g, upto from u group by 1, 2 having count_if(n >= 2 and v > 1) >= 2) select g, min(upto) as round from s group by 1")
def _(t):
    k = F.col("s_suppkey")
    members = windows.rounds(t.supplier.select(F.col("s_nationkey").alias("g"), k.alias("k")), ["g"], ["k"], 2)
    wishes = members.select("g", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("g", "k", F.concat(F.lit("f."), "i").alias("field"), ((F.col("k") * (F.col("i") + 1)) % 3).alias("value"), (4 + (F.col("k") * 7 + F.col("i")) % 5).alias("alpha"))
    return groups.solvable_by_round(members, wishes, "g", "k")


@query("nearby_stops", "select p_partkey, abs(p_size - 25) <= 5 and contains(p_type, 'ECONOMY') as ok from part")
def _(t):
    points = t.part.select(F.col("p_partkey").alias("plan"), F.col("p_partkey").alias("poi"), F.lit("c").alias("city"), F.lit("ECONOMY").alias("stop_name"), F.lit(25.0).alias("distance"))
    stops = t.part.select(F.col("p_partkey").alias("poi"), F.lit("c").alias("city"), F.col("p_type").alias("stop"), F.col("p_size").cast("double").alias("stop_distance"))
    return constraints.stop_near(points, stops).select(F.col("plan").alias("p_partkey"), "ok")


@query("priced_distances", "select n_nationkey, case n_nationkey % 3 when 0 then floor((n_nationkey * 37 + 5) * 0.05) when 1 then n_nationkey * 37 + 5 end::bigint as cost from nation")
def _(t):
    k = F.col("n_nationkey")
    said = F.concat(F.format_number(k * 37 + 5, 0), F.lit(" km"))
    mode = F.when(k % 3 == 0, "self-driving").when(k % 3 == 1, "taxi").otherwise("boat")
    return t.nation.select(k, text.ground_cost(text.distance_km(said), mode).alias("cost"))


LISTS = "(select s_nationkey as trip, list(abs(s_acctbal)) as x, count(*) as n, avg(abs(s_acctbal)) as m, min(abs(s_acctbal)) as lo, max(abs(s_acctbal)) as hi, sum(abs(s_acctbal)) as total, min(s_suppkey) as k, bool_and(s_suppkey % 2 = 0) as even, bool_or(s_suppkey % 2 = 0) as any_even, max(s_suppkey % 24) as late, min(s_suppkey % 24) as early, count(distinct s_suppkey % 5) as kinds, max(c) as most from (select *, count(*) over (partition by s_nationkey, s_suppkey % 3) as c from supplier) group by 1)"
CHECKED = {
    "room_type": ("private room", "even"), "house_rules": ("must allow pets; must forbid smoking", "even"), "maximum_occupancy": ("1500", "lo >= 1500"), "review_score": ("900", "lo >= 900"),
    "restaurant_price": ("Over $4500", "m >= 4500"), "restaurant_rating": ("700", "lo >= 700"), "cuisine": ("must: pets; banned: smoking", "even"), "ambiance": ("lively", "any_even"), "proximity": ("within 800 km", "lo <= 800"),
    "flight_price": ("business", "m >= 1000"), "departure": ("evening", "early >= 18"), "arrival": ("morning", "early >= 6 and late < 12"), "intercity_duration": ("under 2 hours", "hi <= 2"), "flight_duration": ("15000", "total <= 15000"),
    "layovers": ("one_stop", "most - 1 <= 1"), "cuisine_diversity": ("diverse", "kinds / n > 0.7"), "dining_frequency": ("2 meals", "(x[2] / nullif(x[1], 0) between 1.5 and 2.5)"), "minimum_nights": ("max 2", "false"), "clustering": ("scattered", "null"),
}
SAME = [k for k in CHECKED if k not in ("dining_frequency", "minimum_nights", "clustering")]


@query("preferences_by_kind", f"with s as {LISTS} " + " union all ".join(f"select trip, '{k}' as kind, coalesce({CHECKED[k][1]}, true) as ok from s" for k in SAME))
def _(t):
    k, x = F.col("s_suppkey"), F.abs(F.col("s_acctbal"))
    words = F.when(k % 2 == 0, "Private room, pets, bar").otherwise("Shared room, smoking, inn")
    lists = t.supplier.groupBy(F.col("s_nationkey").alias("trip")).agg(F.collect_list(x).alias("x"), F.collect_list(words).alias("w"), F.collect_list(F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30"))).alias("h"), F.collect_list(F.concat(F.lit("c"), k % 5)).alias("c"), F.collect_list(F.concat(F.lit("A-"), k % 3)).alias("r"))
    texts = {"departure": "h", "arrival": "h", "cuisine_diversity": "c", "layovers": "r"}
    rows = lists.select("trip", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.lit(CHECKED[c][0]).alias("wish"), F.col(texts.get(c, "w")).alias("texts")) for c in SAME))).alias("p"), F.col("x").alias("numbers")).select("trip", "p.*", "numbers")
    return preferences.judged(rows).select("trip", "kind", "ok")


@query("preferences_by_number", "with s as (select s_suppkey as trip, s_suppkey % 7 as a, s_suppkey % 5 as b from supplier) select trip, 'dining_frequency' as kind, coalesce((1.0 + b) / (1 + a) between 1.5 and 2.5, true) as ok from s union all select trip, 'minimum_nights', b <= 2 from s union all select trip, 'clustering', abs(a - b) * 0.1 / 2 > 0.5 * 1.0 from s")
def _(t):
    a, b, k = F.col("s_suppkey") % 7, F.col("s_suppkey") % 5, F.col("s_suppkey").alias("trip")
    row = lambda kind, wish, *numbers: F.struct(F.lit(kind).alias("kind"), F.lit(wish).alias("wish"), F.array(*(n.cast("double") for n in numbers)).alias("numbers"))
    every = F.array(row("dining_frequency", "2 meals", 1 + a, 1 + b), row("minimum_nights", "max 2", a, b), row("clustering", "scattered", a * 0.1, b * 0.1, F.lit(0.0), F.lit(0.0)))
    rows = t.supplier.select(k, F.explode(every).alias("p")).select("trip", "p.*", F.lit(None).cast("array<string>").alias("texts"))
    return preferences.judged(rows).select("trip", "kind", "ok")


@query("visit_lengths", "select p_partkey, least(45 + floor(p_retailprice / 5), 90)::bigint as minutes from part")
def _(t):
    return t.part.select("p_partkey", numeric.visit_minutes(F.col("p_retailprice")).alias("minutes"))


# SQL of queries that are registered elsewhere


def greedy_sql(base: str, group: str, key: str, carried: str, apart: str, worth: str, k: int, cut: int) -> str:
    """SQL of a choice of k in turn: base (group, key, s and `carried` columns), the distance `apart` of rows {0} and {1}, and what a row
    is `worth` by its score s and least distance x; groups are cut to their best rows first."""
    parts = [f"r0 as (select *, null::double as x from ({base}) qualify row_number() over (partition by {group} order by s desc, {key}) <= {cut})"]
    for i in range(k):
        value = "s" if i == 0 else worth
        parts.append(f"c{i} as (select * from r{i} qualify row_number() over (partition by {group} order by {value} desc, s desc, {key}) = 1)")
        parts.append(f"r{i + 1} as (select a.{group}, a.{key}, a.s, {', '.join(f'a.{c}' for c in carried.split(', '))}, least(coalesce(a.x, 1e9), {apart.format('a', 'b')}) as x from r{i} a join c{i} b using ({group}) where a.{key} <> b.{key})")
    return f"with {', '.join(parts)} " + " union all ".join(f"select {group}, {key}, {i + 1}::bigint as place from c{i}" for i in range(k))


SQL["mmr_select"] = greedy_sql("select label, vec_id, embedding[1]::double as s, embedding::double[] as v from embeddings", "label", "vec_id", "v", "1 - list_cosine_similarity({0}.v, {1}.v)", "0.6 * s - 0.4 * (1 - x)", 5, 500)
HOT = "list_filter(range(8), lambda i: (c_custkey + i * {}) % 3 = 0)"
ALIKE = "case when len({0}.{2}) + len({1}.{2}) = 0 then 0.0 else len(list_intersect({0}.{2}, {1}.{2})) / len(list_distinct(list_concat({0}.{2}, {1}.{2}))) end"
LEVELS = "select c_nationkey, c_custkey, (c_custkey % 4) / 3.0::double as b, case when c_custkey % 5 <= 3 then (c_custkey % 5) / 3.0::double else 0.0 end as n, (c_custkey % 3) / 2.0::double as p, {0} as e, {1} as h".format(HOT.format(2), HOT.format(4))
FITS = "case abs(c_custkey % 4 - 1) when 0 then 2.5 when 1 then 1.5 when 2 then 0.5 else 0 end::double + case when c_custkey % 5 = 2 then 1.5 else 0.3 end::double + (c_custkey % 3) / 2.0::double * 0.8 + least((len({0}) + len({1})) * 0.15::double, 1.0)".format(HOT.format(2), HOT.format(4))
SQL["conflict_select"] = greedy_sql(f"{LEVELS}, {FITS} as s from customer", "c_nationkey", "c_custkey", "b, n, p, e, h", "(sqrt(2 * power({0}.b - {1}.b, 2) + power({0}.n - {1}.n, 2) + 3 * power({0}.p - {1}.p, 2)) + 8 * (1 - (" + ALIKE.format("{0}", "{1}", "e") + ")) + 8 * (1 - (" + ALIKE.format("{0}", "{1}", "h") + "))) / sqrt(22.0)", "0.6 * s + 0.4 * x", 4, 40)
SQL["greedy_trips"] = SQL["greedy_days"].replace("select d.trip, d.day,", "select d.trip, d.trip as city, d.day,")
SQL["grounded_rows"] = f"with s as (select s_nationkey as city, s_name, s_suppkey, row_number() over (partition by s_nationkey order by s_name, s_suppkey) as i, count(*) over (partition by s_nationkey) as n from supplier) select n_nationkey as plan, 1 as day, city, s_name, s_suppkey from nation join s on city = n_nationkey and i = {drawn(chr(39) + '5' + chr(39), 'n_nationkey', '1')} % n + 1"
SQL["best_combo"] = """with w as (select s_nationkey as g, s_suppkey as m, 'f.' || (i % 3) || '.' || i as field, (s_suppkey * (i + 1)) % 3 as value, (s_suppkey * 7 + i * 5) % 10 as alpha from supplier, range(5) r(i)), m as (select distinct g, m from w),
k as (select a.g, a.m as a, b.m as b, c.m as c from m a join m b on a.g = b.g and a.m < b.m join m c on b.g = c.g and b.m < c.m),
f as (select k.g, a, b, c, field, count_if(alpha >= 9) as h, count(distinct value) filter (alpha >= 9) as hv, count_if(alpha >= 4 and alpha < 9) as n, count(distinct value) filter (alpha >= 4 and alpha < 9) as v, sum(alpha) filter (alpha >= 4 and alpha < 9) as x, sum(alpha * alpha) filter (alpha >= 4 and alpha < 9) as x2 from k join w on w.g = k.g and w.m in (a, b, c) group by 1, 2, 3, 4, 5),
t as (select *, h >= 2 and hv > 1 as hard, not (h >= 2 and hv > 1) and n >= 2 and v > 1 as soft from f),
z as (select g, a, b, c, round(count_if(soft) + 2.0 * count(distinct split_part(field, '.', 1)) filter (soft) + 0.5 * sqrt(greatest(sum(x2) filter (soft) / sum(n) filter (soft) - power(sum(x) filter (soft) / sum(n) filter (soft), 2), 0)), 9) as score from t group by 1, 2, 3, 4 having count_if(hard) = 0 and count_if(soft) >= 2)
select g, arg_max(concat_ws(',', a, b, c), (score, -a, -b, -c)) as members, round(max(score), 6) as score from z group by 1"""
SQL["persona_conflicts"] = f"with c as ({LEVELS} from customer) select a.c_custkey as a, b.c_custkey as b, round((sqrt(9 * power(a.b - b.b, 2) + 0.25 * power(a.n - b.n, 2) + power(a.b - b.b, 2) + 2.25 * power(a.p - b.p, 2) + 2 * power(a.p - b.p, 2)) + 8 * (1 - ({ALIKE.format('a', 'b', 'e')})) + 8 * (1 - ({ALIKE.format('a', 'b', 'h')}))) / sqrt(9 + 0.25 + 1 + 2.25 + 18), 6) as conflict from c a join c b using (c_nationkey) where b.c_custkey > a.c_custkey"
SQL["select_within_budget"] = """with c as (select s_nationkey as trip, case when s_suppkey % 2 = 0 then 'hotel' else 'meal' end as kind, s_suppkey as item, round(abs(s_acctbal) / 100, 2) as cost, s_suppkey % 20 as preference from supplier),
p as (select h.trip, h.item as hotel, m.item as meal, 100 * h.preference - 100 * h.cost + 100 * m.preference - 100 * m.cost as value, h.cost + m.cost as cost from c h join c m on h.trip = m.trip and h.kind = 'hotel' and m.kind = 'meal' where h.cost + m.cost <= h.trip * 10.0 + 20),
b as (select trip, arg_max(hotel, (value, -cost, -hotel, -meal)) as hotel, arg_max(meal, (value, -cost, -hotel, -meal)) as meal from p group by 1)
select trip, 'hotel' as kind, hotel as item, 'optimal' as status from b union all select trip, 'meal', meal, 'optimal' from b union all select distinct trip, null, null, 'infeasible' from c where trip not in (select trip from b)"""
SQL["weighted_pick"] = f"with k as (select s_nationkey, s_suppkey, ln(({drawn(chr(39) + '42' + chr(39), 's_suppkey')} + 1) / 4294967297.0) / (abs(s_acctbal) + 0.1) as x from supplier) select s_nationkey, arg_max(s_suppkey, (x, -s_suppkey)) as s_suppkey from k group by 1"
