"""Trips and requests before a search or a model sees them: normalised trips, generated queries, candidates, plan rows, batches of
requests and their results, and small record work.

Picks are by md5 of a seed and a row's key, so they repeat and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.functions import numeric, text
from sojourn.operators import windows


def draw(*key: Column | str) -> Column:
    """A whole number from 0 to 2^32 - 1 from the md5 of the parts of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key))), 1, 8), 16, 10).cast("long")


def pick(options: Column, *key: Column | str) -> Column:
    """One of an array's values."""
    return F.get(options, (draw(*key) % F.size(options)).cast("int"))


def words(*values) -> Column:
    return F.array(*map(F.lit, values))


#: The wishes that a trip's constraints name, present or not.
WISHES = ["house rule", "cuisine", "room type", "transportation"]


def normalized_trips(trips: DataFrame, choices: list[int], seed: str = "trips") -> DataFrame:
    """trips (trip, people_number, query, budget, days, wishes map) with people (from the field, else the text, else 1; a single
    traveller becomes one of `choices`), its source, the budget scaled with it, and all wishes' keys in the map."""
    said = text.party_size(F.col("query")).cast("int")
    was = F.coalesce(F.col("people_number").cast("int"), said, F.lit(1))
    source = F.when(F.col("people_number").isNotNull(), "field").when(said.isNotNull(), "query").otherwise("default")
    out = trips.withColumn("people_original", was).withColumn("people_source", source)
    out = out.withColumn("people", F.when(F.col("people_original") >= 2, F.col("people_original")).otherwise(pick(words(*choices), seed, F.col("trip"))))
    scaled = F.when((F.col("people") != F.col("people_original")) & (F.col("people_original") > 0), numeric.rescale_budget(F.col("budget"), F.col("people"), F.col("people_original"))).otherwise(F.col("budget"))
    own = F.coalesce("wishes", F.create_map().cast("map<string,string>"))
    whole = F.map_from_arrays(words(*WISHES), F.array(*(F.element_at(own, F.lit(w)) for w in WISHES)))
    more = F.map_filter(own, lambda k, v: ~k.isin(*WISHES))
    return out.withColumn("budget_final", scaled.cast("long")).withColumn("upsampled", F.col("people") != F.col("people_original")).withColumn("days", F.coalesce("days", F.lit(1))).withColumn("wishes", F.map_concat(whole, more))


def strategy(tight: Column, short: Column, large: Column, several_cities: Column, days: Column) -> Column:
    """Which conflict a trip is searched for: the highest of four scores, the first of equals."""
    add = lambda c, n: F.when(c, n).otherwise(0)
    scores = {"budget_war": add(tight, 10), "pace_war": add(short, 5) + add(short & ~large, 3) - add(large, 2), "taste_war": add(large, 8), "adaptive": 1 + add(several_cities, 4) + add(~short & (days <= 7), 3)}
    return F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items()))))["n"]


#: What queries may wish for.
CUISINES = ["Chinese", "American", "Italian", "Mexican", "Indian", "Mediterranean", "French"]
HOUSE_RULES = ["parties", "smoking", "children under 10", "visitors", "pets"]
ROOM_TYPES = ["shared room", "not shared room", "private room", "entire room"]
#: How likely each kind of wish is drawn for a hard query.
HARD_WEIGHTS = {"house rule": 0.3, "cuisine": 0.1, "room type": 0.3, "transportation": 0.3}


def query_elements(ids: DataFrame, bands: DataFrame, level: str, seed: str = "queries", day_choices: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """For each id a query of a level (easy, medium, hard): id, place, days, people, wishes, budget. bands (place from 0 on, n of them,
    low, mean, high) are the price bands of pairs of cities; queries of a band without prices are dropped, and of equal ones all but
    the least id. Budgets are between mean and low for 3 days, the mean for 5, between mean and high for 7, in hundreds, for
    all travellers at three quarters (medium) or half (hard)."""
    at = lambda what: (seed, level, what, F.col("id"))
    count = bands.agg(F.max("place") + 1).first()[0]  # one number
    q = ids.select("id").withColumn("days", pick(words(*day_choices), *at("days"))).withColumn("place", draw(*at("place")) % F.lit(count))
    crowd = F.when(draw(*at("crowd")) % 3 == 0, F.lit(2)).when(draw(*at("crowd")) % 3 == 1, pick(words(3, 4), *at("people"))).otherwise(pick(words(5, 6, 7, 8), *at("people")))
    q = q.withColumn("people", F.lit(1) if level == "easy" else crowd)
    rooms = F.when(F.col("people") <= 2, words(*ROOM_TYPES)).otherwise(words(*ROOM_TYPES[2:]))
    dishes = F.array_sort(F.transform(words(*CUISINES), lambda c: F.struct(draw(seed, level, "dish", F.col("id"), c).alias("d"), c.alias("c"))))
    wish = {"house rule": pick(words(*HOUSE_RULES), *at("rule")), "cuisine": F.array_join(F.array_sort(F.transform(F.slice(dishes, 1, 2 if level == "medium" else 4), lambda d: d["c"])), ","), "room type": pick(rooms, *at("room")), "transportation": pick(words("no flight", "no self-driving"), *at("ban"))}
    if level == "easy":
        chosen = words().cast("array<string>")
    elif level == "medium":
        chosen = F.array(pick(words(*list(wish)[:3]), *at("wish")))
    else:  # three of four, by weight: the largest of u to the power 1 / w
        u = lambda k: F.log((draw(seed, level, "wish", F.col("id"), k) + 1) / F.lit(2.0**32))
        keyed = F.array_sort(F.array(*(F.struct((-u(k) / w).alias("u"), F.lit(k).alias("k")) for k, w in HARD_WEIGHTS.items())))
        chosen = F.transform(F.slice(keyed, 1, 3), lambda x: x["k"])
    q = q.withColumn("_c", chosen).select("id", "days", "place", "people", *(F.when(F.array_contains("_c", k), v).alias(k.replace(" ", "_")) for k, v in wish.items()))
    share = {"easy": F.lit(1.0), "medium": F.col("people") * 0.75, "hard": F.col("people") * 0.5}[level]
    between = F.when(F.col("days") == 3, (F.col("mean") + F.col("low")) / 2).when(F.col("days") == 5, F.col("mean")).otherwise(numeric.round_hundreds((F.col("mean") + F.col("high")) / 2))
    q = q.join(bands.select("place", "low", "mean", "high"), "place").where("low is not null and mean is not null and high is not null").withColumn("budget", numeric.round_hundreds(between * share)).drop("low", "mean", "high")
    same = [c for c in q.columns if c != "id"]
    return q.groupBy(*same).agg(F.min("id").alias("id"))


def candidates(trips: DataFrame, flights: DataFrame, lodgings: DataFrame, restaurants: DataFrame, sights: DataFrame) -> DataFrame:
    """trips (trip, org, dest) with all that a search may choose: trip, kind (outbound, return, hotel, restaurant, origin_restaurant,
    attraction), item, price, minutes, category. Cities match in any case and without what stands in parentheses. A meal takes 45
    minutes and one more for each 5 of its price, 90 at most; a sight costs 15 and takes 90."""
    plain = lambda c: F.lower(F.trim(text.before_parenthesis(F.col(c))))
    t = trips.select("trip", plain("org").alias("_o"), plain("dest").alias("_d"))
    none = F.lit(None)

    def part(kind: str, table: DataFrame, keys: dict[str, str], price: Column, minutes: Column, category: Column) -> DataFrame:
        own = table.select(*(F.lower(F.col(c)).alias(k) for k, c in keys.items()), F.col("name").alias("item"), price.cast("double").alias("price"), minutes.cast("long").alias("minutes"), category.cast("string").alias("category"))
        return t.join(own, list(keys)).select("trip", F.lit(kind).alias("kind"), "item", "price", "minutes", "category")

    meal = F.least(45 + F.floor(F.col("price") / 5), F.lit(90))
    out = part("outbound", flights, {"_o": "origin", "_d": "dest"}, F.col("price"), none, none)
    for more in (
        part("return", flights, {"_d": "origin", "_o": "dest"}, F.col("price"), none, none),
        part("hotel", lodgings, {"_d": "city"}, F.col("price"), none, F.col("house_rules")),
        part("restaurant", restaurants, {"_d": "city"}, F.col("price"), meal, F.col("cuisines")),
        part("origin_restaurant", restaurants, {"_o": "city"}, F.col("price"), meal, F.col("cuisines")),
        part("attraction", sights, {"_d": "city"}, F.lit(15.0), F.lit(90), F.lit("Attraction")),
    ):
        out = out.unionByName(more)
    return out


def allowed(found: DataFrame, wishes: DataFrame) -> DataFrame:
    """Candidates without those that a trip's wishes (trip, forbidden array, house_rule, ban) rule out: forbidden categories, lodgings
    whose rules don't name the house rule, flights for 'no flight'."""
    j = found.join(wishes, "trip", "left")
    banned = F.coalesce(F.array_contains("forbidden", F.col("category")), F.lit(False)) & F.col("kind").isin("hotel", "restaurant", "origin_restaurant", "attraction")
    unruly = (F.col("kind") == "hotel") & F.coalesce(~F.col("house_rule").isin("", "-") & ~F.lower("category").contains(F.lower("house_rule")), F.lit(False))
    grounded = F.col("kind").isin("outbound", "return") & F.coalesce(F.lower("ban").contains("no flight"), F.lit(False))
    return j.where(~banned & ~unruly & ~grounded).select(*found.columns)


def plan_rows(solved: DataFrame) -> DataFrame:
    """solved (trip, day, days, org, dest, outbound, back, hotel, breakfast, lunch, dinner, attractions array) as rows of a plan: where
    each day is spent, flights on the first and last day, the first breakfast at home, no lodging on the last day."""
    first, last = F.col("day") == 1, F.col("day") == F.col("days")
    flies, returns = first & F.col("outbound").isNotNull(), last & ~(first & F.col("outbound").isNotNull()) & F.col("back").isNotNull()
    leg = lambda n, a, b: F.concat(F.lit("Flight Number: "), n, F.lit(", from "), a, F.lit(" to "), b)
    org, dest = F.col("org"), F.col("dest")
    at = lambda c, city: F.when(F.col(c).isNotNull(), F.concat_ws(", ", c, city)).otherwise("-")
    route = lambda a, b: F.concat(F.lit("from "), a, F.lit(" to "), b)
    city = F.when(returns, route(dest, org)).when(first, route(org, dest)).otherwise(dest)
    sights = F.when(F.size("attractions") > 0, F.concat(F.array_join(F.transform("attractions", lambda a: F.concat_ws(", ", a, dest)), ";"), F.lit(";"))).otherwise("-")
    return solved.select("trip", "day", city.alias("current_city"), F.when(flies, leg(F.col("outbound"), org, dest)).when(returns, leg(F.col("back"), dest, org)).otherwise("-").alias("transportation"),
                         at("breakfast", F.when(first, org).otherwise(dest)).alias("breakfast"), at("lunch", dest).alias("lunch"), at("dinner", dest).alias("dinner"), F.coalesce(sights, F.lit("-")).alias("attraction"), F.when(~last, at("hotel", dest)).otherwise("-").alias("accommodation"))


def flattened(rows: DataFrame, group: str, items: str) -> DataFrame:
    """One request for each item of a group's array: custom_id (group_place from 0), place, item, how many the group has."""
    each = rows.select(group, F.posexplode(items).alias("place", "item"), F.size(items).cast("long").alias("n"))
    return each.withColumn("custom_id", F.concat_ws("_", F.col(group).cast("string"), F.col("place").cast("string")))


REPLY = "custom_id string, response struct<status_code:int, body:struct<choices:array<struct<message:struct<content:string>>>>>, error struct<message:string>"


def parsed_replies(lines: DataFrame, order: str) -> DataFrame:
    """lines (value, order) of a batch's results: custom_id, success, data (JSON text), error; the last line of an id counts, blank
    lines don't."""
    rows = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", REPLY)).select(order, "_r.*")
    rows = windows.latest(rows, ["custom_id"], [F.desc(order)])
    content = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    answered = F.coalesce(F.col("response.status_code") == 200, F.lit(False))
    good = answered & F.try_parse_json(content).isNotNull()
    error = F.when(answered, "JSON parse error").otherwise(F.coalesce("error.message", F.lit("Unknown error")))
    return rows.select("custom_id", good.alias("success"), F.when(good, content).alias("data"), F.when(~good, error).alias("error"))


def regrouped(requests: DataFrame, replies: DataFrame, group: str) -> DataFrame:
    """group, kept (how many of its requests succeeded), n: groups without a success stay with 0."""
    good = replies.where("success").select("custom_id", F.lit(1).alias("_good"))
    return requests.join(good, "custom_id", "left").groupBy(group).agg(F.count("_good").alias("kept"), F.count(F.lit(1)).alias("n"))


def rendered(rows: DataFrame, group: str, order: list[str], parts: list[str], between: str = ":", ends: str = "; ") -> DataFrame:
    """group, text: the group's rows in order, their parts joined."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, *(F.col(p).cast("string").alias(f"_{i}") for i, p in enumerate(parts))))).alias("_x"))
    return lists.select(group, F.array_join(F.transform("_x", lambda s: F.concat_ws(between, *(s[f"_{i}"] for i in range(len(parts))))), ends).alias("text"))


def merged_lists(rows: DataFrame, columns: list[str], days: str) -> DataFrame:
    """rows with `merged`: the elements (as text) of JSON arrays in the first, the first two or the first three columns, for trips of
    3, 5 or more days."""
    part = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    n = F.when(F.col(days) <= 3, 1).when(F.col(days) <= 5, 2).otherwise(3)
    return rows.withColumn("merged", F.flatten(F.slice(F.array(*map(part, columns)), F.lit(1), n)))


def nth_row(df: DataFrame, keys: list[tuple[Column, bool]], n: int, meta: list[str], references: list[str]) -> DataFrame:
    """The n-th row, from 0, as meta, references and whole row."""
    placed = windows.global_rank(df, keys, "_n").where(F.col("_n") == n + 1)
    return placed.select(F.struct(*meta).alias("meta"), F.struct(*references).alias("references"), F.struct(*df.columns).alias("row"))


def moved_after(df: DataFrame, names: list[str], anchor: str) -> DataFrame:
    """Columns `names` (those that are there) right after the anchor, or at the front without one."""
    moving = [c for c in names if c in df.columns]
    rest = [c for c in df.columns if c not in moving]
    at = rest.index(anchor) + 1 if anchor in rest else 0
    return df.select(*rest[:at], *moving, *rest[at:])


def condensed(df: DataFrame, fields: list[str], keep: list[str], name: str = "initial_info") -> DataFrame:
    """Some fields in one struct, and a few columns beside it."""
    return df.select(F.struct(*fields).alias(name), *keep)


def normalized_header(name: str) -> str:
    """A header without byte order mark and outer space, in lower case, inner space single."""
    return " ".join(name.replace("﻿", "").lower().split())


def with_normalized_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*map(normalized_header, df.columns))


def shortened(lines: Column, most: Column | int, cut: str = ": [truncated]") -> Column:
    """Lines of a log with the longest that begin with 'Observation' cut to their label, one after the other (of equals the last
    first), until all lines joined have at most so many characters."""
    most = F.lit(most) if isinstance(most, int) else most
    short = lambda x: F.concat(F.substring_index(x, ":", 1), F.lit(cut))
    placed = F.transform(lines, lambda x, i: F.struct(F.char_length(x).alias("n"), i.alias("i"), (F.char_length(x) - F.char_length(short(x))).alias("gain"), x.startswith("Observation").alias("o")))
    longest = F.sort_array(F.filter(placed, lambda s: s["o"]), asc=False)
    total = F.aggregate(lines, F.lit(-1), lambda a, x: a + F.char_length(x) + 1)
    start = F.struct(total.alias("left"), F.array().cast("array<int>").alias("gone"))
    done = F.aggregate(longest, start, lambda a, s: F.when(a["left"] > most, F.struct((a["left"] - s["gain"]).alias("left"), F.concat(a["gone"], F.array(s["i"])).alias("gone"))).otherwise(a))
    return F.transform(lines, lambda x, i: F.when(F.array_contains(done["gone"], i), short(x)).otherwise(x))


class Notebook:
    """Numbered notes of tables, each a temporary view."""

    def __init__(self, spark: SparkSession, name: str = "notebook") -> None:
        self.spark, self.name, self.notes = spark, name, []

    def _view(self, n: int) -> str:
        return f"{self.name}_{n}"

    def write(self, df: DataFrame, note: str) -> int:
        df.createOrReplaceTempView(self._view(len(self.notes)))
        self.notes.append(note)
        return len(self.notes) - 1

    def update(self, n: int, df: DataFrame, note: str) -> None:
        if not 0 <= n < len(self.notes):
            raise IndexError(n)
        df.createOrReplaceTempView(self._view(n))
        self.notes[n] = note

    def list(self) -> list[dict]:
        return [{"index": i, "note": n} for i, n in enumerate(self.notes)]

    def read(self, n: int) -> DataFrame:
        if not 0 <= n < len(self.notes):
            raise IndexError(n)
        return self.spark.table(self._view(n))

    def reset(self) -> None:
        for n in range(len(self.notes)):
            self.spark.catalog.dropTempView(self._view(n))
        self.notes = []


def write_artefacts(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One JSON folder for each kind."""
    paths = {kind: f"{folder.rstrip('/')}/{kind}" for kind in tables}
    for kind, df in tables.items():
        df.write.mode("errorifexists").json(paths[kind])
    return paths


def check_resumable(then: dict, now: dict, before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> None:
    """Raise if a run can't go on: a field of its configuration or the ids of its examples have changed."""
    changed = [f for f in fields if then.get(f) != now.get(f)]
    if changed:
        raise ValueError(f"changed since the run began: {', '.join(changed)}")
    if not before.select(key).exceptAll(after.select(key)).isEmpty() or not after.select(key).exceptAll(before.select(key)).isEmpty():
        raise ValueError("the run's examples have changed")


def swept(df: DataFrame, mode: str, statistics: dict[str, Callable[[DataFrame, list[str]], DataFrame]]) -> DataFrame:
    """Each statistic for every mode in one pass: mode, statistic, and its row as JSON."""
    out = None
    for name, f in statistics.items():
        found = f(df, [mode])
        row = found.select(mode, F.lit(name).alias("statistic"), F.to_json(F.struct(*(c for c in found.columns if c != mode))).alias("row"))
        out = row if out is None else out.unionByName(row)
    return out


def group_welfare(rows: DataFrame, group: str, member: str, alpha: str, ok: str, changed: str) -> DataFrame:
    """rows (group, member, alpha, ok, changed): group, least (satisfaction by importance of the worst-off member), cost (importance of
    what was changed for consensus), retained (share of wishes that hold)."""
    each = rows.groupBy(group, member).agg((F.sum(F.when(F.col(ok), F.col(alpha)).otherwise(0)) / F.nullif(F.sum(alpha), F.lit(0))).alias("_s"), F.sum(F.when(F.col(changed), F.col(alpha)).otherwise(0)).alias("_c"), F.count_if(F.col(ok)).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return each.groupBy(group).agg(F.min("_s").alias("least"), F.sum("_c").alias("cost"), (F.sum("_ok") / F.sum("_n")).alias("retained"))

