"""Queries over the driver's tables, each with SQL that says the same: one or more for each kind of operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions import numeric, text
from sojourn.operators import aggregates as agg
from sojourn.operators import lookup, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


r6 = lambda c: F.round(c, 6)


# lookups and predicates


@query("lookup_exact", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber = 3")
def _(t):
    return lookup.equal_to(t.lineitem, l_returnflag="R", l_linestatus="F", l_linenumber=3).select("l_orderkey", "l_linenumber", "l_quantity")


@query("lookup_single_key", "select s_suppkey, s_name from supplier where s_nationkey = 7")
def _(t):
    return lookup.equal_to(t.supplier, s_nationkey=7).select("s_suppkey", "s_name")


@query("lookup_plain_key", "select n_nationkey, n_name from nation where n_name = 'GERMANY' or n_name = (select n_name from nation where n_nationkey = 3)")
def _(t):
    rows = t.nation.withColumn("noted", F.concat("n_name", F.lit("(region)")))
    asked = t.nation.where("n_nationkey = 3 or n_name = 'GERMANY'").select(F.concat("n_name", F.lit("(state)")).alias("asked"))
    return rows.join(asked, text.before_parenthesis(F.col("noted")) == text.before_parenthesis(F.col("asked")), "left_semi").select("n_nationkey", "n_name")


@query("lookup_any_case", "select c_custkey from customer where lower(trim(c_mktsegment)) = 'building' and c_nationkey = 5")
def _(t):
    rows = t.customer.withColumn("nation", F.col("c_nationkey").cast("string"))
    return lookup.by_name(rows, "nation", "c_mktsegment", " 5", "Building ").select("c_custkey")


@query("date_between", "select event_id, user_id from events where ts between (select min(ts) from events) + interval 1 day and (select min(ts) from events) + interval 3 day")
def _(t):
    first = t.events.agg(F.min("ts").alias("m"))
    dates = F.array(F.expr("m + interval 1 day"), F.expr("m + interval 2 day"), F.expr("m + interval 3 day"))
    return lookup.in_dates(t.events.join(F.broadcast(first)), "ts", dates).select("event_id", "user_id")


@query("isin_threshold", "select o_orderkey, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice >= 100000")
def _(t):
    return lookup.among(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_totalprice", 100000).select("o_orderkey", "o_totalprice")


@query("not_contains_filter", "select p_partkey, p_name from part where not contains(p_name, 'a') and not contains(p_type, 'E')")
def _(t):
    return lookup.without_words(lookup.without_words(t.part, "p_name", ["a"]), "p_type", ["E"]).select("p_partkey", "p_name")


@query("pattern_alternation", "select p_partkey from part where regexp_matches(p_type, 'BRASS|STEEL|ECONOMY')")
def _(t):
    return t.part.where(F.col("p_type").rlike("BRASS|STEEL|ECONOMY")).select("p_partkey")


@query("any_of_list", "select p_partkey from part where list_has_any(string_split(lower(p_type), ' '), ['brass', 'small', 'economy'])")
def _(t):
    return lookup.with_any(t.part.withColumn("words", F.split(F.lower("p_type"), " ")), "words", ["brass", "small", "economy"]).select("p_partkey")


@query("feasibility_guard", "select s_nationkey, count(*) as rows, case when count(*) < 4 then 'too_few' else 'ok' end as status from supplier group by 1")
def _(t):
    return lookup.guarded(t.supplier, ["s_nationkey"], 4)


@query("stated_wish", "select doc_id, (quality is not null and quality = 1) or (toxic is not null and toxic = 1) as stated from labels")
def _(t):
    wish = lambda c: F.when(F.col(c) == 1, "yes").otherwise("-")
    return t.labels.select("doc_id", lookup.is_stated(wish("quality"), wish("toxic")).alias("stated"))


@query("room_kind", "select p_partkey, case when p_size <= 10 then 'Shared room' when p_size <= 30 then 'Private room' else 'Entire home/apt' end as kind from part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") <= 10, "Shared room").when(F.col("p_size") <= 30, "Private room").otherwise("Entire home/apt").alias("kind"))


@query("text_predicate", "select p_partkey, p_size from part where p_size >= 40 and contains(p_brand, '3') and not contains(p_name, 'x')")
def _(t):
    return t.part.where(lookup.parse_predicate("p_size >= 40, p_brand contains 3, p_name ~contains x")).select("p_partkey", "p_size")


@query("missing_and_extra", "select c_custkey as key, 'missing' as side from customer where c_custkey not in (select o_custkey + 20 from orders) union all select distinct o_custkey + 20, 'extra' from orders where o_custkey + 20 not in (select c_custkey from customer)")
def _(t):
    a, b = t.customer.select(F.col("c_custkey").alias("key")), t.orders.select((F.col("o_custkey") + 20).alias("key")).distinct()
    return lookup.unknown(a, b, ["key"]).withColumn("side", F.lit("missing")).unionByName(lookup.unknown(b, a, ["key"]).withColumn("side", F.lit("extra")))


# joins


@query("first_match_join", "select l_orderkey, l_linenumber, p.p_name as first_name, p.p_retailprice as first_price from lineitem l left join (select l2.p_size, arg_min(p_name, p_partkey) as p_name, arg_min(p_retailprice, p_partkey) as p_retailprice from part l2 group by 1) p on cast(l_quantity as int) = p.p_size")
def _(t):
    dim = t.part.withColumnsRenamed({"p_name": "first_name", "p_retailprice": "first_price"}).withColumn("q", F.col("p_size"))
    facts = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    return lookup.first_match(facts, dim, ["q"], "p_partkey", ["first_name", "first_price"]).drop("q")


@query("semi_known", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def _(t):
    return lookup.known(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer.where("c_acctbal > 5000"), ["c_custkey"]).select("o_orderkey")


@query("anti_unknown", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def _(t):
    return lookup.unknown(t.customer, t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey")


@query("contains_join", "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def _(t):
    return lookup.holding(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("passage")), "text", "passage").select("doc_id", "item_id")


@query("named_within_city", "select a.p_partkey, b.p_partkey as other from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and contains(a.p_name, string_split(b.p_name, ' ')[1]) where a.p_partkey <> b.p_partkey")
def _(t):
    right = t.part.select(F.col("p_partkey").alias("other"), "p_brand", "p_size", F.substring_index("p_name", " ", 1).alias("head"))
    return lookup.containing(t.part.select("p_partkey", "p_brand", "p_size", "p_name"), right, ["p_brand", "p_size"], "p_name", "head").where("p_partkey <> other").select("p_partkey", "other")


@query("band_join", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b using (s_nationkey) where a.s_suppkey < b.s_suppkey and abs(a.s_acctbal - b.s_acctbal) <= 500")
def _(t):
    a = t.supplier.select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"))
    b = t.supplier.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"))
    return lookup.within_band(a, b, ["s_nationkey"], F.col("x"), F.col("y"), 500).where("a < b").select("a", "b")


@query("or_fallback_lookup", "select l_orderkey, l_linenumber, coalesce(a.n_name, b.n_name) as name from lineitem left join nation a on a.n_nationkey = l_partkey % 40 left join nation b on b.n_nationkey = l_suppkey % 40")
def _(t):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("first"), (F.col("l_suppkey") % 40).alias("second"))
    dim = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return lookup.either_key(facts, dim, "first", "second", "k", "name").select("l_orderkey", "l_linenumber", "name")


@query("state_fanout", "select r_name, n_name, count(s_suppkey) as suppliers from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey where r_name in ('ASIA', 'EUROPE') group by 1, 2")
def _(t):
    areas = t.region.where(F.col("r_name").isin("ASIA", "EUROPE")).withColumnRenamed("r_regionkey", "n_regionkey")
    out = lookup.fanned_out(areas, t.nation, "n_regionkey", t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")
    return out.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("in_all_dimensions", "select n_nationkey from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 9000) and n_nationkey in (select c_nationkey from customer where c_acctbal > 9900)")
def _(t):
    s = t.supplier.where("s_acctbal > 9000").withColumnRenamed("s_nationkey", "n_nationkey")
    c = t.customer.where("c_acctbal > 9900").withColumnRenamed("c_nationkey", "n_nationkey")
    return lookup.in_all(t.nation.select("n_nationkey"), "n_nationkey", [s, c])


@query("ordinal_zip", "select idx, s_name, n_name from (select row_number() over (order by s_suppkey) as idx, s_name from supplier) full join (select row_number() over (order by n_nationkey) as idx, n_name from nation) using (idx)")
def _(t):
    a = lookup.numbered(t.supplier, ["s_suppkey"]).select("idx", "s_name")
    return lookup.zipped(a, lookup.numbered(t.nation, ["n_nationkey"]).select("idx", "n_name"), ["idx"]).select("idx", "s_name", "n_name")


@query("pair_min_distance", "select a.s_nationkey, round(min(abs(a.s_acctbal - b.s_acctbal)), 6) as least from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey group by 1")
def _(t):
    rows = t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal")
    return lookup.least_distance(rows, "s_nationkey", "s_suppkey", r6(F.abs(F.col("s_acctbal") - F.col("other_s_acctbal"))))


@query("k_combos", "select a.s_nationkey, a.s_suppkey as a, b.s_suppkey as b, c.s_suppkey as c from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey join supplier c on b.s_nationkey = c.s_nationkey and b.s_suppkey < c.s_suppkey")
def _(t):
    out = lookup.combinations(t.supplier.select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 3)
    return out.select("s_nationkey", *(F.col("members")[i].alias(n) for i, n in enumerate("abc")))


@query("index_aligned_merge", "select o_orderkey, count(*) as n, string_agg(p_brand, ',' order by l_linenumber, l_partkey) as brands from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey group by 1")
def _(t):
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("parts"))
    merged = lookup.index_merged(lists, "o_orderkey", "parts", t.part, "p_partkey", "p_brand")
    return merged.select("o_orderkey", F.size("merged").cast("long").alias("n"), F.array_join("merged", ",").alias("brands"))


@query("hydrated_ids", "select c_custkey, last_order from customer left join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders where o_orderstatus = 'F' group by 1) on o_custkey = c_custkey")
def _(t):
    log = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), "o_orderdate")
    return lookup.hydrated(t.customer.select("c_custkey"), log, "c_custkey", ["o_orderdate", "last_order"], "last_order")


# aggregation


FLAGS = ("select o_orderkey, o_orderpriority, year(o_orderdate)::int as y, case when o_orderstatus = 'P' then null else o_orderstatus = 'F' end as a, case when o_totalprice < 20000 then null else o_totalprice > 150000 end as b, month(o_orderdate) > 6 as c from orders")


def flags(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("a"), F.when(F.col("o_totalprice") >= 20000, F.col("o_totalprice") > 150000).alias("b"), (F.month("o_orderdate") > 6).alias("c"))


@query("stratum_true_false", f"with f as ({FLAGS}), u as (select o_orderpriority, 'a' as \"check\", a as ok from f union all select o_orderpriority, 'b', b from f union all select o_orderpriority, 'c', c from f) select o_orderpriority, \"check\", count_if(ok)::bigint as passed, count_if(not ok)::bigint as failed, count(ok) as applicable, count(*) as rows from u group by 1, 2")
def _(t):
    return agg.true_false(flags(t), ["o_orderpriority"], ["a", "b", "c"])


@query("micro_macro_rates", f"with f as ({FLAGS}) select round((sum(coalesce(a::int, 0)) + sum(coalesce(b::int, 0)) + sum(coalesce(c::int, 0))) / (count(a) + count(b) + count(c)), 6) as micro, round(avg((coalesce(a, true) and coalesce(b, true) and coalesce(c, true))::int), 6) as macro, count(*) as rows from f")
def _(t):
    return agg.pass_rates(flags(t), ["a", "b", "c"]).select(r6("micro").alias("micro"), r6("macro").alias("macro"), "rows")


@query("gated_rates", f"with f as (select *, o_orderkey % 10 > 0 as d from ({FLAGS})), g as (select d, case when d then a end as a, case when d and coalesce(a, false) and coalesce(c, false) then b end as b, case when d then c end as c, d and coalesce(a, false) and coalesce(c, false) as o from f) select round(avg(d::int), 6) as delivery, round((sum(coalesce(a::int, 0)) + sum(coalesce(c::int, 0))) / (count(a) + count(c)), 6) as soft_micro, round(avg((d and coalesce(a, true) and coalesce(c, true))::int), 6) as soft_macro, round(sum(coalesce(b::int, 0)) / count(b), 6) as hard_micro, round(avg((o and coalesce(b, true))::int), 6) as hard_macro, round(avg((d and coalesce(a, true) and coalesce(c, true) and o and coalesce(b, true))::int), 6) as final from g")
def _(t):
    out = agg.gated_rates(flags(t).withColumn("d", F.col("o_orderkey") % 10 > 0), ["a", "c"], ["b"], ["a", "c"], "d")
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("applicability_counts", f"with f as ({FLAGS}) select y, count(a) as a, count(b) as b, count(c) as c, count(*) as rows from f group by 1")
def _(t):
    return agg.applicable(flags(t), ["y"], ["a", "b", "c"])


@query("delivery_rate", "select round(avg((n > 2)::int), 6) as delivery from (select l_orderkey, count(*) as n from lineitem group by 1)")
def _(t):
    return agg.delivery(t.lineitem, "l_orderkey", 2).select(r6("delivery").alias("delivery"))


@query("fixed_denominator", "select o_orderpriority as split, count_if(o_orderstatus = 'F')::bigint as passed, round(count_if(o_orderstatus = 'F') / case o_orderpriority when '1-URGENT' then 2300 when '2-HIGH' then 521 else count_if(o_orderstatus = 'F') end, 6) as rate from orders group by 1")
def _(t):
    return agg.fixed_denominator(t.orders, F.col("o_orderpriority"), F.col("o_orderstatus") == "F", {"1-URGENT": 2300, "2-HIGH": 521}).withColumn("rate", r6("rate"))


@query("party_cost", "select l_orderkey, round(sum(ceil(l_quantity / 5) * p_retailprice), 2) as cost from lineitem join part on p_partkey = l_partkey group by 1")
def _(t):
    units = numeric.party_units(F.col("l_quantity"), F.lit("Self-driving"))
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.round(F.sum(units * F.col("p_retailprice")), 2).alias("cost"))


@query("budget_bands", "select p_brand, round(min(p_retailprice) * 3, 6) as low, round(max(p_retailprice) * 3, 6) as high, round(avg(p_retailprice) * 3, 6) as mean, round_even(max(p_retailprice) * 3 / 100, 0) * 100 as rounded from part group by 1")
def _(t):
    out = agg.budget_band(t.part, ["p_brand"], "p_retailprice", 3)
    return out.select("p_brand", r6("low").alias("low"), r6("high").alias("high"), r6("mean").alias("mean"), numeric.round_hundreds(F.col("high")).alias("rounded"))


@query("price_text_band", "select p_brand, min(cast(floor(p_retailprice) as bigint)) as low, max(cast(floor(p_retailprice) as bigint)) as high from part group by 1")
def _(t):
    priced = t.part.withColumn("pricing", F.to_json(F.struct(F.format_string("$%s", F.format_number(F.floor("p_retailprice"), 0)).alias("price"))))
    told = priced.withColumn("amount", text.money(F.from_json("pricing", "map<string,string>")["price"]))
    return told.groupBy("p_brand").agg(F.min("amount").alias("low"), F.max("amount").alias("high"))


@query("distinct_minus_origin", "select o_custkey, count(distinct s_nationkey) as nations from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join customer on c_custkey = o_custkey where s_nationkey <> c_nationkey group by 1")
def _(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return agg.elsewhere(j, "o_custkey", "s_nationkey", "c_nationkey", "nations")


@query("coverage_set", "select l_orderkey, list_has_all(list(distinct l_returnflag), ['N', 'R']) as ok, case when not list_contains(list(distinct l_returnflag), 'N') then 'N' when not list_contains(list(distinct l_returnflag), 'R') then 'R' end as missing from lineitem group by 1")
def _(t):
    got = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("got"))
    c = agg.covers(F.col("got"), F.array(F.lit("N"), F.lit("R")))
    return got.select("l_orderkey", c["ok"].alias("ok"), c["missing"].alias("missing"))


@query("list_thresholds", "select l_orderkey, min(l_quantity) >= 5 as floor_ok, max(l_quantity) <= 45 as cap_ok, avg(l_quantity) <= 25 as mean_ok from lineitem group by 1")
def _(t):
    return agg.within_limits(t.lineitem, "l_orderkey", "l_quantity", 5, 45, 25)


@query("cv_consistency", "select l_suppkey, round(stddev_pop(l_extendedprice) / avg(l_extendedprice) * 100, 6) as cv, case when stddev_pop(l_extendedprice) / avg(l_extendedprice) * 100 < 20 then 'consistent' when stddev_pop(l_extendedprice) / avg(l_extendedprice) * 100 <= 40 then 'moderate' else 'varied' end as kind from lineitem group by 1")
def _(t):
    return agg.variation(t.lineitem, ["l_suppkey"], "l_extendedprice").withColumn("cv", r6("cv"))


@query("diversity_ratio", "select p_brand, round(count(distinct w) / count(w), 6) as ratio from (select p_brand, unnest(string_split(p_type, ' ')) as w from part) group by 1")
def _(t):
    return agg.diversity(t.part, ["p_brand"], F.split("p_type", " ")).withColumn("ratio", r6("ratio"))


@query("topn_frequency", "select p_type, count(*) as rows from part group by 1 order by 2 desc, 1 limit 10")
def _(t):
    return agg.top_values(t.part, "p_type", 10)


@query("nearest_rank_quantiles", "with o as (select o_orderpriority as p, o_totalprice as x, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders) select p as o_orderpriority, max(n) as n, round(avg(x), 6) as mean, min(x) as least, max(x) as most, max(x) filter (i = round_even(0.25 * (n - 1), 0)) as q25, max(x) filter (i = round_even(0.5 * (n - 1), 0)) as q50, max(x) filter (i = round_even(0.9 * (n - 1), 0)) as q90 from o group by 1")
def _(t):
    return agg.nearest_rank(t.orders, ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.9]).withColumn("mean", r6("mean"))


@query("interp_quantiles", "select event_type, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75 from events group by 1")
def _(t):
    return agg.quantiles(t.events, ["event_type"], "value", [0.25, 0.75]).select("event_type", r6("q25").alias("q25"), r6("q75").alias("q75"))


@query("keyword_ratios", "select event_type, round(avg((value > 50)::int), 6) as high, round(avg((value > 50 or user_id % 2 = 0)::int), 6) as either from events group by 1")
def _(t):
    high = F.col("value") > 50
    out = agg.ratios(t.events, ["event_type"], {"high": high, "either": high | (F.col("user_id") % 2 == 0)})
    return out.select("event_type", r6("high").alias("high"), r6("either").alias("either"))


@query("keyword_coverage", "with d as (select lang, lower(coalesce(text, '')) as t from documents), c as (select lang, 'common' as \"check\", contains(t, 'the') or contains(t, 'der') as ok from d union all select lang, 'rare', contains(t, 'license') or contains(t, 'idiot') from d) select lang, \"check\", round(avg(ok::int) * 100, 6) as percent, case when avg(ok::int) * 100 >= 50 then 'high' when avg(ok::int) * 100 >= 20 then 'medium' else 'low' end as level from c group by 1, 2")
def _(t):
    docs = t.documents.withColumn("text", F.coalesce("text", F.lit("")))
    return agg.keyword_coverage(docs, "text", {"common": ["the", "der"], "rare": ["license", "idiot"]}, ["lang"]).withColumn("percent", r6("percent"))


@query("overlap_histogram", "select event_type, count_if(value >= 0 and value < 60)::bigint as low, count_if(value >= 40 and value < 120)::bigint as mid, count_if(value >= 80 and value < 1e9)::bigint as high from events group by 1")
def _(t):
    return agg.bands(t.events, ["event_type"], "value", [("low", 0, 60), ("mid", 40, 120), ("high", 80, 1e9)])


@query("weighted_mean", "select o_orderpriority, round(coalesce(sum(o_totalprice * w) / nullif(sum(w), 0), avg(o_totalprice)), 6) as mean from (select *, case when o_orderpriority = '5-LOW' then 0 else o_orderkey % 5 end as w from orders) group by 1")
def _(t):
    w = F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.col("o_orderkey") % 5)
    return t.orders.groupBy("o_orderpriority").agg(r6(agg.weighted_mean(F.col("o_totalprice"), w)).alias("mean"))


@query("rule_aggregation", "with s as (select s_nationkey as g, (s_suppkey % 3)::int as k, s_acctbal as x, s_suppkey % 5 + 1 as p from supplier) select g as \"group\", k, round(case k when 0 then min(x) when 1 then max(x) else sum(x * p) / sum(p) end, 6) as number from s group by 1, 2")
def _(t):
    k = (F.col("s_suppkey") % 3).cast("int")
    rules = t.supplier.select(F.col("s_nationkey").alias("group"), k.cast("string").alias("attr"), F.element_at(F.array(F.lit("<="), F.lit(">="), F.lit("==")), k + 1).alias("operator"), F.col("s_acctbal").alias("number"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("boolean").alias("flag"), (F.col("s_suppkey") % 5 + 1).alias("priority"))
    return agg.aggregate_rules(rules).select("group", F.col("attr").cast("int").alias("k"), r6("number").alias("number"))


@query("mean_without_sentinel", "select l_returnflag, round(avg(case when l_linenumber % 3 <> 0 then l_tax end), 6) as mean from lineitem group by 1")
def _(t):
    x = F.when(F.col("l_linenumber") % 3 == 0, -1.0).otherwise(F.col("l_tax"))
    return t.lineitem.groupBy("l_returnflag").agg(r6(agg.mean_without(x)).alias("mean"))


@query("attempt_statistics", "select count(*) as rows, round(avg((n = 1)::int), 6) as first_pass, round(avg(n), 6) as mean_attempts, round(avg(n - 1), 6) as mean_retries from (select user_id, count(*) as n from events where event_type = 'error' group by 1)")
def _(t):
    tries = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("n") == 1)
    return agg.attempts(tries, "n", "ok").select("rows", *(r6(c).alias(c) for c in ("first_pass", "mean_attempts", "mean_retries")))


@query("grouping_sets_rates", f"with f as ({FLAGS}) select y, round(avg((coalesce(a, true) and coalesce(b, true))::int), 6) as rate, count(*) as rows from f group by grouping sets ((), (y))")
def _(t):
    ok = F.coalesce("a", F.lit(True)) & F.coalesce("b", F.lit(True))
    return agg.with_total(flags(t), ["y"], {"rate": ok}).withColumn("rate", r6("rate"))


@query("line_dedupe", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p from documents where text is not null) select line, count(*) as rows from l where trim(line) <> '' group by 1 order by min((doc_id, p)) limit 5")
def _(t):
    return agg.repeated_lines(t.documents.where("text is not null"), "text", "doc_id", 5)


@query("route_max_stops", "select user_id, max(n) - 1 as stops from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def _(t):
    return agg.stops(t.events, "user_id", "event_type")


@query("weighted_satisfaction", "select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_orderkey % 11 else 0 end) / nullif(sum(o_orderkey % 11), 0), 6) as satisfaction from orders group by 1")
def _(t):
    rows = t.orders.select("o_orderpriority", (F.col("o_orderkey") % 11).alias("alpha"), (F.col("o_orderstatus") == "F").alias("ok"))
    return agg.satisfaction(rows, ["o_orderpriority"], "alpha", "ok").withColumn("satisfaction", r6("satisfaction"))


@query("profile_numeric", "select 'p_size' as \"column\", min(p_size)::double as least, max(p_size)::double as most, round(avg(p_size), 6) as mean, count(p_size) as rows from part union all select 'p_retailprice', min(p_retailprice), max(p_retailprice), round(avg(p_retailprice), 6), count(p_retailprice) from part")
def _(t):
    return agg.numeric_profile(t.part, lookup.profile_columns(t.part.columns, allow=["p_size", "p_retailprice"])).withColumn("mean", r6("mean"))


# windows


@query("run_lengths", "with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i, row_number() over (partition by user_id, event_type order by ts, event_id) as j from events), g as (select user_id, event_type, i - j as g, count(*) as length, min(i) as s from e group by 1, 2, 3) select user_id, row_number() over (partition by user_id order by s) as run, event_type, length from g")
def _(t):
    return windows.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type").withColumn("run", F.col("run").cast("long"))


@query("latest_per_key", "select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def _(t):
    return windows.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("multi_key_rank", "select s_suppkey, row_number() over (order by s_acctbal desc, s_name desc, s_suppkey) as rank from supplier")
def _(t):
    return windows.global_rank(t.supplier, [(F.col("s_acctbal"), True), (F.col("s_name"), True), (F.col("s_suppkey"), False)]).select("s_suppkey", F.col("rank").cast("long").alias("rank"))


@query("first_duplicate", "with l as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber) > 1 as again from lineitem) select l_orderkey, min(l_linenumber) filter (again) as repeated from l group by 1")
def _(t):
    return windows.first_repeat(t.lineitem, ["l_orderkey"], ["l_linenumber"], "l_suppkey", F.col("l_linenumber"))


@query("closed_loop", "select user_id, arg_min(event_type, (ts, event_id)) = arg_max(event_type, (ts, event_id)) as closed, count(*) as n from events group by 1")
def _(t):
    seqs = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return seqs.select("user_id", windows.closed_loop(F.col("s.event_type")).alias("closed"), F.size("s").cast("long").alias("n"))


@query("carry_forward", "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as bought from events")
def _(t):
    return windows.carried(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "bought").select("event_id", "bought")


@query("adjacent_gap", "select event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) // 60000000 as minutes from events")
def _(t):
    return windows.gaps(t.events, ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")), "us").select("event_id", F.floor(F.col("us") / 60000000).alias("minutes"))


@query("stratified_take", "with a as (select c_custkey, row_number() over (partition by c_mktsegment order by c_custkey) as n from customer), b as (select c_custkey, n, row_number() over (order by (n > 5)::int, c_custkey) as r from a where n <= 60) select c_custkey from b where r <= 60 or n <= 5")
def _(t):
    return windows.stratified(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], 5, 60).select("c_custkey")


@query("modulo_pick", "with s as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_name, s_suppkey) - 1 as i, count(*) over (partition by s_nationkey) as n from supplier) select s_nationkey, s_suppkey from s where i = 17 % n")
def _(t):
    return windows.modulo_pick(t.supplier.select("s_nationkey", "s_suppkey", "s_name"), ["s_nationkey"], ["s_name", "s_suppkey"], 17).select("s_nationkey", "s_suppkey")


@query("round_batches", "select c_custkey, ceil(row_number() over (partition by c_nationkey order by c_custkey) / 4)::bigint as round from customer")
def _(t):
    return windows.rounds(t.customer, ["c_nationkey"], ["c_custkey"], 4).select("c_custkey", "round")
