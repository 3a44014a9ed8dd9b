"""What the reference texts of a trip say: their sections, the numbers and names in their tables, and whether wishes agree with them.

A trip's reference is a literal list of sections {Description, Content}; contents are tables as text, or a sentence on a drive. Numbers
are found by where they stand in a line, as the tables have no reliable columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.functions import literals

#: What contents may name.
CUISINES = ["Chinese", "American", "Italian", "Mexican", "Indian", "Mediterranean", "French"]
ROOM_RULES = ["No parties", "No smoking", "No children under 10", "No pets", "No visitors"]
ROOM_TYPES = ["Entire Room", "Private Room", "Shared Room", "No Shared Room"]
ROOM_WORDS = {"entire home/apt": "Entire Room", "private room": "Private Room", "shared room": "Shared Room"}
MODES = ["flight", "self-driving", "taxi"]
#: How lines that are headers begin.
HEADERS = {"restaurant": ["name", "restaurants", "description"], "accommodation": ["name", "accommod", "description"], "attraction": ["name", "description"], "flight": ["flight", "description", "flightnumber", "flight_number"]}
FLOATS, INTS, CLOCK, NUMBER = r"\b(\d+\.\d+)\b", r"(?<!\.)\b(\d+)\b(?!\.)", r"^(?:[01]\d|2[0-3]):[0-5]\d$", r"^\d+(?:\.\d+)?$"


def sections(df: DataFrame, key: str, reference: str) -> DataFrame:
    """key, place, description, content of a reference's sections; references that are no list of objects have none."""
    rows = df.select(key, F.posexplode(F.from_json(literals.parsed(F.col(reference)), "array<struct<Description: string, Content: string>>")).alias("place", "s"))
    return rows.where(F.col("s").isNotNull()).select(key, "place", F.coalesce("s.Description", F.lit("")).alias("description"), F.coalesce("s.Content", F.lit("")).alias("content"))


def table_of(description: Column) -> Column:
    """The table that a section holds; null for others."""
    low = F.lower(description)
    return F.when(low.contains("restaurants"), "restaurant").when(low.contains("accommod"), "accommodation").when(low.contains("attractions"), "attraction").when(low.contains("flight"), "flight").when(low.contains("self-driving") | low.contains("taxi"), "ground")


def _lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), lambda t: F.trim(t, F.lit(" \t\x0b\x0c"))), lambda t: t != "")


def _found(t: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))


def _fields(table: Column, t: Column) -> Column:
    """struct(field, value) of the numbers in a line of a table; none in headers and in lines without what makes them a row."""
    one = lambda name, v: F.struct(F.lit(name).alias("field"), v.alias("value"))
    floats, ints = _found(t, FLOATS), _found(t, INTS)
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    words = F.split(t, r"\s+")
    clocks = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(CLOCK), i)), lambda i: i.isNotNull())
    before = F.get(words, F.get(clocks, F.lit(0)) - 1)
    flies = (F.size(clocks) >= 2) & F.coalesce(before.rlike(NUMBER), F.lit(False))
    hours = [F.regexp_extract(t, r"(?i)(\d+)\s*hours?\s*(\d+)\s*minutes?", i).try_cast("int") for i in (1, 2)]
    last = F.try_element_at(F.filter(words, lambda w: w.rlike(NUMBER)), F.lit(-1)).try_cast("double")
    several = lambda n, v: F.when(F.size(floats) >= n, v)
    every = {
        "restaurant": [one("restaurant.row", F.lit(1.0)), one("restaurant.avg_cost", at(ints, 1)), one("restaurant.rating", at(floats, 1))],
        "accommodation": [one("accommodation.row", F.lit(1.0)), one("accommodation.price", at(floats, 1)), one("accommodation.review", several(2, at(floats, -1))), one("accommodation.minimum_nights", several(3, at(floats, 2))), one("accommodation.maximum_occupancy", at(ints, -1))],
        "flight": [one("flight.row", F.when(flies, 1.0)), one("flight.price", F.when(flies, before.try_cast("double"))), one("flight.duration_minutes", F.when(flies, (hours[0] * 60 + hours[1]).cast("double"))), one("flight.distance", F.when(flies, last))],
    }
    out = F.array().cast("array<struct<field: string, value: double>>")
    for name, numbers in every.items():
        header = F.exists(F.array(*map(F.lit, HEADERS[name])), lambda h: F.startswith(F.lower(t), h))
        out = F.when(table == name, F.when(header, F.array().cast("array<struct<field: string, value: double>>")).otherwise(F.filter(F.array(*numbers), lambda x: x["value"].isNotNull()))).otherwise(out)
    return out


def _drives(content: Column, low: Column) -> Column:
    """Cost and minutes of a drive's sentence, for each mode that the description names."""
    cost = F.regexp_extract(content, r"(?i)cost:\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    hours = [F.regexp_extract(content, r"(?i)duration:\s*(\d+)\s*hours?\s*(\d+)\s*mins?", i).try_cast("int") for i in (1, 2)]
    one = lambda mode, name, v: F.struct(F.lit(f"ground.{name}").alias("field"), F.when(low.contains(mode), v.cast("double")).alias("value"))
    each = [one(m, f"{k}_{f}", v) for m, k in (("self-driving", "self_driving"), ("taxi", "taxi")) for f, v in (("cost", cost), ("duration_minutes", hours[0] * 60 + hours[1]))]
    return F.filter(F.array(*each), lambda x: x["value"].isNotNull())


def profile(parts: DataFrame, key: str, most: int = 10, names: int = 30, shown: int = 25) -> DataFrame:
    """key, table, field, type, count, least, most, values of what a key's sections (key, place, description, content) say.

    type number: the field's numbers; of several sections with numbers the last one counts, of flights all. type rows: count is the
    table's rows, of restaurants and lodgings one less a section, for the header. type names: the different names of the last
    section of attractions, up to `names` a section counted, `shown` of them listed. type values: which of the known values contents
    name, `most` of them. type section: which tables there are; count is how many sections."""
    rows = parts.withColumn("table", table_of(F.col("description"))).withColumn("low", F.lower("description"))
    own = _lines(F.col("content"))
    numbers = F.when(F.col("table") == "ground", _drives(F.col("content"), F.col("low"))).otherwise(F.flatten(F.transform(own, lambda t: _fields(F.col("table"), t))))
    each = rows.where("table <> 'attraction'").select(key, "table", "place", F.explode(numbers).alias("n")).select(key, "table", "place", "n.*")
    by = each.groupBy(key, "table", "place", "field").agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("least"), F.max("value").alias("most"))
    is_row, flown = F.col("field").endswith(".row"), F.col("table") == "flight"
    lists = F.lit(None).cast("array<string>")
    number = by.where(~is_row).groupBy(key, "table", "field").agg(F.max_by(F.struct("count", "least", "most"), "place").alias("l"), F.sum("count").alias("c"), F.min("least").alias("a"), F.max("most").alias("z"))
    number = number.select(key, "table", "field", F.lit("number").alias("type"), F.when(flown, F.col("c")).otherwise(F.col("l.count")).alias("count"), F.when(flown, F.col("a")).otherwise(F.col("l.least")).alias("least"), F.when(flown, F.col("z")).otherwise(F.col("l.most")).alias("most"), lists.alias("values"))
    less = F.when(flown, F.col("count")).otherwise(F.greatest(F.col("count") - 1, F.lit(0)))
    count = by.where(is_row).groupBy(key, "table").agg(F.sum(less).alias("count"))
    blank = [F.lit(None).cast("double").alias(c) for c in ("least", "most")]
    count = count.select(key, "table", F.concat("table", F.lit(".rows")).alias("field"), F.lit("rows").alias("type"), "count", *blank, lists.alias("values"))
    header = lambda t: F.startswith(F.lower(t), F.lit("name")) | F.startswith(F.lower(t), F.lit("description"))
    heads = F.transform(F.filter(own, lambda t: ~header(t) & t.rlike(FLOATS)), lambda t: F.trim(F.regexp_extract(t, r"(?s)^(.*?)\b\d+\.\d+\b", 1)))
    seen = rows.where("table = 'attraction'").select(key, "place", F.slice(F.array_distinct(F.filter(heads, lambda n: n != "")), 1, names).alias("v"))
    seen = seen.groupBy(key).agg(F.sum(F.size("v")).cast("long").alias("count"), F.max_by("v", "place").alias("v"))
    named = seen.select(key, F.lit("attraction").alias("table"), F.lit("attraction.name").alias("field"), F.lit("names").alias("type"), "count", *blank, F.slice("v", 1, shown).alias("values"))
    hits = lambda known: F.filter(F.array(*map(F.lit, known)), lambda v: F.regexp_like("content", F.concat(F.lit(r"\b"), v, F.lit(r"\b"))))
    told = {"restaurant.cuisine": ("restaurant", CUISINES), "accommodation.house_rule": ("accommodation", ROOM_RULES), "accommodation.room_type": ("accommodation", ROOM_TYPES)}
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col("table") == t, hits(k)).otherwise(F.array().cast("array<string>")).alias("v")) for f, (t, k) in told.items()))
    enums = rows.select(key, "table", F.explode(values).alias("e")).select(key, "table", "e.*").where(F.size("v") > 0)
    enums = enums.groupBy(key, "table", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))
    enums = enums.select(key, "table", "field", F.lit("values").alias("type"), F.size("v").cast("long").alias("count"), *blank, F.slice("v", 1, most).alias("values"))
    there = rows.where("table is not null").groupBy(key, "table").agg(F.count(F.lit(1)).alias("count"))
    there = there.select(key, "table", "table", F.lit("section").alias("type"), "count", *blank, lists.alias("values")).toDF(*enums.columns)
    return number.unionByName(count).unionByName(named).unionByName(enums).unionByName(there)


def summary(parts: DataFrame, key: str) -> DataFrame:
    """key, descriptions, cuisines, room_rules, room_types (sorted arrays) and counts, a map of a section's bucket to its lines less a header
    (1 for filled sections of other kinds)."""
    low, text = F.lower("description"), F.lower("content")
    bucket = F.when(low.contains("restaurants"), "restaurants").when(low.contains("accommodations"), "accommodations").when(low.contains("attractions"), "attractions").when(low.contains("flight"), "flights").when(low.contains("taxi"), "taxi").when(low.contains("self-driving"), "self_driving").otherwise("other")
    lines = F.size(_lines(F.col("content")))
    many = bucket.isin("restaurants", "accommodations", "attractions", "flights")
    rows = F.when(many, F.greatest(lines - 1, F.lit(0))).otherwise((lines > 0).cast("int"))
    cuisines = F.filter(F.array(*map(F.lit, CUISINES)), lambda c: F.regexp_like("content", F.concat(F.lit(r"(?i)\b"), c, F.lit(r"\b"))))
    rules = F.filter(F.array(*map(F.lit, ROOM_RULES)), lambda r: F.contains(text, F.lower(r)))
    types = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(raw)), F.lit(name)) for raw, name in ROOM_WORDS.items())))
    each = parts.select(key, F.when(F.col("description") != "", F.col("description")).alias("d"), bucket.alias("b"), rows.cast("long").alias("n"), cuisines.alias("c"), rules.alias("r"), types.alias("t"))
    counts = each.groupBy(key, "b").agg(F.sum("n").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("counts"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return each.groupBy(key).agg(F.array_sort(F.collect_set("d")).alias("descriptions"), union("c").alias("cuisines"), union("r").alias("room_rules"), union("t").alias("room_types")).join(counts, key)


#: The ranges of fields that no table gives, and the fields of each kind.
RANGES = {"restaurant.avg_cost": (0, 400), "restaurant.rating": (0, 5), "accommodation.price": (0, 2000), "accommodation.review": (0, 5), "accommodation.minimum_nights": (0, 60), "accommodation.maximum_occupancy": (1, 20), "flight.price": (0, 6000), "flight.duration_minutes": (0, 1440), "flight.distance": (0, 20000), "ground.cost": (0, 20000), "ground.duration_minutes": (0, 1440), "ground.distance": (0, 20000)}
COUNTS = {"restaurant.count": "restaurant.rows", "accommodation.count": "accommodation.rows", "attraction.count": "attraction.name", "flight.count": "flight.rows"}
ENUMS = {"restaurant.cuisine": (CUISINES, "cuisine_not_allowed"), "accommodation.room_type": (ROOM_TYPES, "room_type_not_allowed"), "accommodation.house_rule": (ROOM_RULES, "house_rule_not_allowed"), "ground.mode": (MODES, "ground_mode_not_allowed")}
TIMES = ["flight.depart_time", "flight.arrive_time"]
KEYWORDS = ["attraction.name_keyword", "attraction.address_keyword", "restaurant.name_keyword", "accommodation.name_keyword"]


def wish_faults(wishes: DataFrame, profiles: DataFrame, key: str, strict: bool = False, reject_loose: bool = False) -> DataFrame:
    """wishes with `faults`, an array in a fixed order, and `kept`, whether there is none.

    wishes (key, field, op, value: JSON text, hard, alpha, beta, description), profiles as `profile` gives them. Faults: a description of
    under five letters; alpha and beta that don't make up 1 (0.15 off at most); hard wishes of alpha under 0.8 or beta over 0.25, soft ones
    of alpha over 0.9; values that aren't known (if strict, that the key's tables don't name); times that aren't HH:MM; hard
    numbers out of the table's range (else the general one), or, if asked for, so loose that they say nothing; if strict, more than the table
    has; keywords of under two letters. A value that has to be a number and isn't is a fault, too; ranges of `between` aren't judged."""
    named = profiles.where("type = 'number'").select(key, "field", F.col("least").alias("_lo"), F.col("most").alias("_hi"))
    totals = F.create_map(*(F.lit(x) for kv in COUNTS.items() for x in kv))
    sizes = profiles.where(F.col("type").isin("rows", "names")).select(key, F.col("field").alias("_f"), F.col("count").alias("_rows"))
    lists = profiles.where("type = 'values'").select(key, "field", F.col("values").alias("_known"))
    w = wishes.join(named, [key, "field"], "left").join(lists, [key, "field"], "left").withColumn("_f", F.try_element_at(totals, F.col("field"))).join(sizes, [key, "_f"], "left").drop("_f")
    parsed = F.try_parse_json("value")
    number = F.when(F.schema_of_variant(parsed).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT|TINYINT|SMALLINT)"), F.col("value").try_cast("double"))
    text = F.try_variant_get(parsed, "$", "string")
    is_text = F.schema_of_variant(parsed) == "STRING"
    listed = F.from_json("value", "array<string>")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    items = F.when(is_list, listed).when(is_text, F.array(text)).otherwise(F.array().cast("array<string>"))
    hard, soft, alpha, beta, op, field = F.coalesce("hard", F.lit(False)), ~F.coalesce("hard", F.lit(True)), F.col("alpha"), F.col("beta"), F.col("op"), F.col("field")
    low = F.lit(None).cast("double")
    lo, hi = low, low
    for f, (a, b) in RANGES.items():
        lo, hi = F.when(field == f, F.lit(float(a))).otherwise(lo), F.when(field == f, F.lit(float(b))).otherwise(hi)
    lo, hi = F.when(F.col("_hi").isNotNull(), F.col("_lo")).otherwise(lo), F.coalesce("_hi", hi)
    faults = [
        (F.coalesce(F.length(F.trim("description")) < 5, F.lit(True)), "missing_description"),
        (F.abs((1 - alpha) - beta) > 0.15, "alpha_beta_inconsistent"),
        (hard & (alpha < 0.8), "hard_alpha_too_low"), (hard & (beta > 0.25), "hard_beta_too_high"), (soft & (alpha > 0.9), "soft_alpha_too_high"),
    ]
    for f, (known, name) in ENUMS.items():
        allowed = F.array(*map(F.lit, known))
        if strict and f != "ground.mode":
            allowed = F.when(F.size(F.coalesce("_known", F.array().cast("array<string>"))) > 0, F.col("_known")).otherwise(allowed)
        faults.append(((field == f) & F.exists(items, lambda x: ~F.array_contains(allowed, x)), name))  # noqa: B023
    clock = lambda x: F.coalesce(x.rlike(CLOCK), F.lit(False))
    faults.append((field.isin(*TIMES) & F.when(op == "between", ~(is_list & (F.size(listed) == 2) & F.forall(listed, clock))).otherwise(~(F.coalesce(is_text, F.lit(False)) & clock(text))), "time_format"))
    if strict:
        faults.append((field.isin(*COUNTS) & op.isin(">=", ">") & hard & (number > F.coalesce("_rows", F.lit(0))), "count_infeasible"))
    infeasible = F.when(op.isin("<=", "<"), number < lo).when(op.isin(">=", ">"), number > hi).when(op.isin("==", "!="), (number < lo) | (number > hi)).otherwise(F.lit(False))
    loose = F.when(op.isin("<=", "<"), number > hi * 3).when(op.isin(">=", ">"), (lo > 0) & (number < lo / 3)).otherwise(F.lit(False))
    sense = hard & (infeasible | (loose if reject_loose else F.lit(False)))
    faults.append((hi.isNotNull() & F.when(op == "between", F.lit(False)).otherwise(number.isNull() | sense), "numeric_infeasible_or_noop"))
    wordless = F.coalesce(F.exists(items, lambda x: F.coalesce(F.length(F.trim(x)) < 2, F.lit(True))), F.lit(True)) | ~(F.coalesce(is_text, F.lit(False)) | is_list | F.col("value").isNull() | (F.trim("value") == "null"))
    faults.append((field.isin(*KEYWORDS) & wordless, "keyword_not_string"))
    out = w.withColumn("faults", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in faults))))
    return out.withColumn("kept", F.size("faults") == 0).select(*wishes.columns, "faults", "kept")


def wish_sets(wishes: DataFrame, key: str, member: str, expected: DataFrame) -> DataFrame:
    """key, ok: whether a key's wishes come from members 0 to n - 1, each of them at least once. expected (key, n)."""
    got = wishes.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("_m"), F.count_if(F.col(member).isNull()).alias("_null"))
    j = expected.join(got, key, "left")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: i.cast("long"))
    own = F.transform(F.coalesce("_m", F.array().cast("array<long>")), lambda i: i.cast("long"))
    return j.select(key, ((F.coalesce("_null", F.lit(0)) == 0) & F.when(F.col("n") > 0, own == whole).otherwise(F.size(own) == 0)).alias("ok"))
