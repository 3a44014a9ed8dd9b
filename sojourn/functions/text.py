"""Text functions of itinerary data: column in, column out, all on built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.functions import literals
from sojourn.functions.binding import let


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def before_parenthesis(s: Column) -> Column:
    """What stands before the first closed parenthesis; the whole text if there is none."""
    pattern = r"(?s)^(.*?)\([^)]*\)"
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1)).otherwise(s)


def name_city(s: Column) -> Column:
    """struct(name, city) of 'Name, City(State)'; ('-', '-') if it has no such form."""
    pattern = r"(.*?),\s*([^,]+)(\(\w[\w\s]*\))?$"
    hit = s.rlike(pattern)
    city = before_parenthesis(F.trim(F.regexp_extract(s, pattern, 2)))
    return F.struct(F.when(hit, F.trim(F.regexp_extract(s, pattern, 1))).otherwise("-").alias("name"), F.when(hit, F.trim(city)).otherwise("-").alias("city"))


def name_city_last_comma(s: Column) -> Column:
    """struct(name, city) split at the last comma."""
    hit = s.contains(",")
    pattern = r"(?s)^(.*),([^,]*)$"
    return F.struct(*(F.when(hit, F.trim(F.regexp_extract(s, pattern, i))).otherwise("-").alias(n) for i, n in ((1, "name"), (2, "city"))))


def from_to(s: Column) -> Column:
    """struct(origin, destination) of 'from A to B'; nulls if it isn't there."""
    pattern = r"from\s+(.+?)\s+to\s+([^,]+)(?=[,\s]|$)"
    return F.struct(*(_or_null(F.regexp_extract(s, pattern, i)).alias(n) for i, n in ((1, "origin"), (2, "destination"))))


def transport_kind(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.contains("taxi"), "Taxi").when(low.contains("self-driving"), "Self-driving").when(low.contains("flight"), "Flight")


def flight_number(s: Column) -> Column:
    return F.when(s.contains("Flight Number: "), F.substring_index(F.substring_index(s, "Flight Number: ", -1), ",", 1))


def distance_km(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "km", ""), r"[,\s]", "").try_cast("double")


def ground_cost(km: Column, mode: Column) -> Column:
    """Whole dollars: any kind of driving 0.05 a km, a taxi 1."""
    return F.when(mode.contains("driving"), F.floor(km * 0.05)).when(mode.contains("taxi"), F.floor(km))


def duration_minutes(s: Column) -> Column:
    """Minutes of 'N hours M minutes', where either part may be missing; null if both are. A pattern looks once, and only in texts with its word."""
    part = lambda word, p: F.when(s.contains(word), F.regexp_extract(s, p, 1).try_cast("int"))
    h, m = part("hour", r"(\d+)\s*hours?"), part("min", r"(\d+)\s*min(?:ute)?s?")
    return let(F.array_compact(F.array(h * 60, m)), lambda a: F.when(F.size(a) > 0, F.get(a, F.lit(0)) + F.coalesce(F.get(a, F.lit(1)), F.lit(0))))


def duration_minutes_strict(s: Column) -> Column:
    pattern = r"(\d+)\s*hours?\s*(\d+)\s*mins?"
    part = lambda i: F.regexp_extract(s, pattern, i).try_cast("int")
    return F.when(s.contains("hour") & s.contains("min"), part(1) * 60 + part(2))


def money(s: Column) -> Column:
    """The first dollar amount in a text."""
    return F.replace(F.regexp_extract(s, r"\$\s*([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long")


#: Ordered phrases and the number of travellers that each tells; None stands for the number in the text.
_PERSONS = r"(?:people|persons|individuals|travelers)"
_NAMED = [("eight", 8), ("seven", 7), ("six", 6), ("five", 5), ("four", 4), ("three", 3), ("two", 2)]
PARTY_PHRASES = [
    (rf"\b(?:group|party|team)\s+of\s+(\d+)\s+{_PERSONS}", None),
    (rf"\b(\d+)\s+{_PERSONS}\b", None),
    (rf"\bfor\s+(\d+)\s+{_PERSONS}", None),
    *((rf"\b(?:{word}|{n})\s+{_PERSONS}\b", n) for word, n in _NAMED),
    (r"\b(?:solo|one\s+person|single\s+traveler|one\s+individual)\b", 1),
    (r"\b(?:couple|pair|duo|two\s+of\s+us)\b", 2),
    (r"\bfamily\s+of\s+(\d+)\b", None),
    (r"\bfor\s+(?:me|myself)\b", 1),
    (r"\bfor\s+us\b", 2),
]


def party_size(s: Column) -> Column:
    """Travellers that a request names: the first phrase that fits; numbers in texts count from 1 to 20 only."""
    low = F.lower(s)

    def told(pattern: str, fixed: int | None) -> Column:
        if fixed is not None:
            return F.when(low.rlike(pattern), F.lit(fixed))
        n = F.regexp_extract(low, pattern, 1).try_cast("int")
        return F.when(n.between(1, 20), n)

    return F.coalesce(*(told(p, n) for p, n in PARTY_PHRASES))


def literal_list(s: Column, kind: str = "array<string>") -> Column:
    """A list written as JSON or as a literal, with quotes of either kind, escapes, tuples and sets; null if it is neither."""
    return F.from_json(literals.parsed(s), kind)


def strip_fence(s: Column) -> Column:
    """The content of the first fenced block; the trimmed text if there is none."""
    pattern = r"(?s)```[A-Za-z]*\s*(.*?)```"
    return F.trim(F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1)).otherwise(s), F.lit(" \t\r\n"))


def slug(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}\-_.]", "-")


def stop_distance(s: Column) -> Column:
    return F.regexp_extract(s, r"([0-9.]+)m", 1).try_cast("double")


def poi_names(s: Column) -> Column:
    """Names in 'A, stay from ..; B, visit from ..'."""
    parts = F.filter(F.split(s, ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r"(?s)^(.*?)(?:stay|visit|$)", 1), r",\s*$", "")))


def clock_hours(s: Column) -> Column:
    """HH:MM in hours."""
    return F.regexp_extract(s, r"(\d+):(\d+)", 1).try_cast("int") + F.regexp_extract(s, r"(\d+):(\d+)", 2).try_cast("int") / 60


def stay_hours(s: Column) -> Column:
    """struct(start, end) of 'from HH:MM to HH:MM' in hours."""
    side = lambda i: clock_hours(F.regexp_extract(s, r"from (\d+:\d+) to (\d+:\d+)", i))
    return F.struct(side(1).alias("start"), side(2).alias("end"))


def hour_of(s: Column) -> Column:
    """The hour of HH:MM, else the first digits, else -1."""
    return F.coalesce(F.regexp_extract(s, r"(\d{1,2}):(\d{2})", 1).try_cast("int"), F.regexp_extract(s, r"(\d+)", 1).try_cast("int"), F.lit(-1))


def poi_kinds(s: Column) -> Column:
    """x for stays, y for meals, z for other visits, in order."""
    kind = lambda p: F.when(F.lower(p).contains("stay"), "x").when(F.lower(p).rlike("breakfast|lunch|dinner|restaurant"), "y").otherwise("z")
    return F.transform(F.filter(F.split(s, ";"), lambda p: F.trim(p) != ""), kind)


def answer_normalized(s: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    t = F.regexp_replace(F.lower(s), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def is_iso_date(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}$")


def city_error(city: Column, cities: Column) -> Column:
    """Why a city isn't one of a list of cities, as a text; null if it is."""
    named = F.concat(F.lit("["), F.array_join(F.transform(cities, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    return F.when(~F.coalesce(F.array_contains(cities, city), F.lit(False)), F.concat(F.coalesce(city, F.lit("None")), F.lit(" is not valid city in "), named, F.lit(".")))


#: Ordered words of an error text and its class.
ERROR_CLASSES = [
    ("parse_error", "parse_error"),
    ("invalid field", "invalid_field"),
    ("invalid op", "invalid_op"),
    ("invalid cuisine", "invalid_cuisine"),
    ("invalid room type", "invalid_room_type"),
    ("invalid room rule", "invalid_room_rule"),
    ("invalid ground mode", "invalid_ground_mode"),
    ("persona_index", "persona_index_mismatch"),
    ("must be a list", "shape_error"),
    ("must be objects", "shape_error"),
    ("no cuisines in snapshot", "snapshot_missing_cuisines"),
    ("no room types in snapshot", "snapshot_missing_room_types"),
    ("no room rules in snapshot", "snapshot_missing_room_rules"),
]


def error_class(s: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    low = F.lower(s)
    return reduce(lambda out, r: out.when(low.contains(r[0]), r[1]), rules or ERROR_CLASSES, F.when(F.lit(False), "")).otherwise("other")


#: First parts of a field's name.
CATEGORIES = ["restaurant", "accommodation", "attraction", "flight", "ground"]


def category_of(field: Column) -> Column:
    """The part of a field's name before its dot, if it is one of CATEGORIES."""
    head = F.substring_index(field, ".", 1)
    return F.when(field.contains(".") & head.isin(*CATEGORIES), head).otherwise("other")


def numbers_before_clock(s: Column) -> Column:
    """The numbers in a table row's text before its first HH:MM."""
    head = F.regexp_replace(s, r"(?s)\d{1,2}:\d{2}.*$", "")
    return F.transform(F.regexp_extract_all(head, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def enums_present(s: Column, values: list[str]) -> Column:
    """Which of the values a text names, in their order."""
    return F.filter(F.array(*map(F.lit, values)), lambda v: F.contains(F.lower(s), F.lower(v)))


def has_hangul(s: Column) -> Column:
    return s.rlike("[가-힣]")


def needs_translation(s: Column, least: int = 40) -> Column:
    return ~has_hangul(s) & (F.char_length(s) >= least)


def clock_tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\b\d{1,2}:\d{2}\b"), F.lit(0))


def outer_json(s: Column) -> Column:
    """From the first brace to the last."""
    return _or_null(F.regexp_extract(s, r"(?s)(\{.*\})", 1))


def until_sentinel(tokens: Column, stop: Column) -> Column:
    """The tokens before the first stop, without leading newlines."""
    own = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"] != "\n")
    first = F.coalesce(own[0]["i"], F.size(tokens))
    rest = F.slice(tokens, first + 1, F.size(tokens))
    at = F.array_position(rest, stop)
    return F.when(at > 0, F.slice(rest, F.lit(1), (at - 1).cast("int"))).otherwise(rest)


def split_of_path(s: Column) -> Column:
    return F.when(s.contains("train"), "train").when(s.contains("validation"), "validation").when(s.contains("test"), "test")


def words(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
