"""Numeric functions of itinerary data: prices, scores, distances of vectors and densities; column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(month: Column) -> Column:
    """0 December to February, 1 March to May, 2 June to August, 3 otherwise."""
    return F.when(month.isin(12, 1, 2), 0).when(month.isin(3, 4, 5), 1).when(month.isin(6, 7, 8), 2).otherwise(3)


def per_person_night(budget: Column, people: Column, days: Column) -> Column:
    return F.when((budget > 0) & (people > 0) & (days > 0), budget / (people * days))


def quantile_bucket(x: Column, q25: Column, q50: Column, q75: Column) -> Column:
    return F.when(x <= q25, 0).when(x <= q50, 1).when(x <= q75, 2).otherwise(3)


def fallback_bucket(x: Column) -> Column:
    return F.when(x < 50, 0).when(x < 100, 1).when(x < 250, 2).otherwise(3)


def round_hundreds(x: Column) -> Column:
    """Half to even, as budgets are rounded."""
    return F.bround(x / 100) * 100


def rescale_budget(budget: Column, people: Column, was: Column) -> Column:
    return F.bround(budget * people / was).cast("long")


#: How many travellers a car, a taxi hold.
SEATS = {"Self-driving": 5, "Taxi": 4}


def party_units(people: Column, mode: Column, occupancy: Column | None = None) -> Column:
    """Cars, taxis, or rooms that a party needs; otherwise tickets."""
    rooms = F.ceil(people / occupancy) if occupancy is not None else people
    return F.when(mode == "Self-driving", F.ceil(people / SEATS["Self-driving"])).when(mode == "Taxi", F.ceil(people / SEATS["Taxi"])).when(mode == "room", rooms).otherwise(people).cast("long")


def weighted_l2(a: Column, b: Column, w: Column) -> Column:
    """Length of (a - b) * w; the weight is inside the square."""
    d = F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), w, lambda x, y: x * y)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def multi_hot_jaccard(a: Column, b: Column) -> Column:
    total = lambda pick: F.aggregate(F.zip_with(a, b, lambda x, y: pick(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    both, either = total(F.least), total(F.greatest)
    return F.when(either == 0, 0.0).otherwise(both / either)


def spatial_decay(d: Column) -> Column:
    """From 1 at the stop to 0.5 at 5 km, then exponential."""
    return F.when(d <= 5000, 1 - 0.5 * d / 5000).otherwise(0.5 * F.exp(-0.0002 * (d - 5000)))


def normal_score(x: Column, y: Column, mx: float, my: float, sx: float, sy: float, beta: float) -> Column:
    """A bivariate normal density over its peak."""
    a, b = (x - mx) / sx, (y - my) / sy
    return F.exp(-0.5 * (a * a - 2 * beta * a * b + b * b) / (1 - beta * beta))


def poisson(n: Column, rate: float) -> Column:
    return F.exp(F.lit(-rate)) * F.pow(F.lit(rate), n) / F.factorial(n)


def gaussian_score(x: Column, mean: Column, sd: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, 2))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)) * 111


#: Dollars for 1000 completion and prompt tokens by a part of a model's name, in the order of matching.
UNIT_PRICES = [("gpt-4", 0.06, 0.03), ("gpt-3.5-turbo", 0.002, 0.002), ("davinci", 0.02, 0.02), ("curie", 0.002, 0.002), ("babbage", 0.0005, 0.0005), ("ada", 0.0004, 0.0004)]


def token_cost(model: Column, tokens: Column, prompt: bool = False) -> Column:
    """Dollars; an unknown model has a unit price of -1."""
    unit = F.lit(-1.0)
    for part, completion, own in reversed(UNIT_PRICES):
        unit = F.when(model.contains(part), own if prompt else completion).otherwise(unit)
    return F.bround(unit * tokens / 1000, 4)


def importance_band(x: Column) -> Column:
    return F.when(x >= 9, "must_have").when(x >= 7, "should_have").when(x >= 4, "could_have").otherwise("indifferent")


def clamped(x: Column, least: float, most: float, otherwise: float) -> Column:
    """A number in text, held between bounds; `otherwise` if it is none."""
    n = x.try_cast("double")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(least)), F.lit(most))).otherwise(otherwise)


#: Shares of a budget for lodging, flights and food by tier; other tiers get the last.
BUDGET_SHARES = {"Frugal": (0.25, 0.40, 0.18), "Budget": (0.33, 0.35, 0.20), "Comfort": (0.40, 0.30, 0.22), "Luxury": (0.50, 0.25, 0.25), "": (0.33, 0.35, 0.20)}


def budget_tier(s: Column) -> Column:
    """The tier that a free text names; the trimmed text if it names none."""
    low = F.lower(s)
    return F.when(low.contains("frugal"), "Frugal").when(low.contains("budget"), "Budget").when(low.contains("comfort"), "Comfort").when(low.contains("lux"), "Luxury").otherwise(F.trim(s))


def budget_guidance(total: Column, days: Column, people: Column, named: Column) -> Column:
    """Most to pay for a night, a flight one way and person, and a meal and person; null without a positive budget."""

    def share(i: int) -> Column:
        out = F.lit(BUDGET_SHARES[""][i])
        for name, shares in BUDGET_SHARES.items():
            out = F.when(named == name, shares[i]).otherwise(out)
        return out

    at_least = lambda c: F.greatest(F.lit(1), c)
    night = total / at_least(days) * share(0)
    flight = total * share(1) / at_least(2 * people)
    meal = total * share(2) / at_least(days * 2 * people)
    return F.when(total > 0, F.struct(*(F.bround(c).cast("long").alias(n) for c, n in ((night, "night"), (flight, "flight"), (meal, "meal")))))


def feasibility(op: Column, bound: Column, lo: Column, hi: Column) -> Column:
    """What a threshold does to a column of a known range: infeasible, no_op or ok."""
    never = ((op == "<=") & (bound < lo)) | ((op == ">=") & (bound > hi))
    always = ((op == "<=") & (bound >= hi)) | ((op == ">=") & (bound <= lo))
    return F.when(never, "infeasible").when(always, "no_op").otherwise("ok")


def shares_balanced(alpha: Column, beta: Column, tolerance: float = 0.15) -> Column:
    return F.abs(1 - alpha - beta) <= tolerance


def date_run(start: Column, days: Column) -> Column:
    return F.sequence(start, F.date_add(start, days - 1))


def visit_minutes(cost: Column) -> Column:
    return F.least(45 + F.floor(cost / 5), F.lit(90))


def stable_id(s: Column, digits: int = 16) -> Column:
    return F.substring(F.sha1(s), 1, digits)


def stable_seed(s: Column, seed: int) -> Column:
    return F.conv(F.substring(F.sha1(s), 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(seed))


def perplexity(logs: Column) -> Column:
    """An aggregate."""
    return F.exp(-F.avg(logs))
