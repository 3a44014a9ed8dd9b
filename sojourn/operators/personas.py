"""Travellers as vectors: relevance to a trip, conflict with others, and selection that balances the two."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.functions import numeric
from sojourn.operators.greedy import chosen_in_turn
from sojourn.operators.prepare import draw

#: The places of a vector. 0-2 are hard, 3-5 behaviour, 6-13 experiences, 14-21 scenery.
EXPERIENCES = ["Beach", "Adventure", "Nature", "Culture", "Nightlife", "History", "Shopping", "Cuisine"]
SCENERY = ["Urban", "Rural", "Sea", "Mountain", "Lake", "Desert", "Plains", "Jungle"]
AGES = ["0-19", "20-39", "40-59", "60+"]
PARTS = {"hard": (1, 3), "behavior": (4, 3), "experiences": (7, 8), "scenery": (15, 8)}
#: Weights that differ from 1, by strategy and place.
PROFILES = {"default": {}, "budget_war": {0: 3.0, 1: 0.5, 3: 1.5}, "pace_war": {3: 4.0, 5: 2.0, 0: 0.8}, "taste_war": {0: 0.7, 1: 0.5} | dict.fromkeys(range(6, 14), 3.0)}


def decoded(codes: Column, names: list[str], most: int) -> Column:
    """Names of a list of codes written as '[0, 1]' or '0'; unknown codes go, the first `most` stay."""
    found = F.transform(F.regexp_extract_all(F.coalesce(codes, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda c: F.get(F.array(*map(F.lit, names)), c.cast("int")))
    return F.slice(F.filter(found, lambda n: n.isNotNull()), 1, most)


def vector(budget: Column, season: Column, ages: Column, activity: Column, safety: Column, popularity: Column, experiences: Column, scenery: Column) -> Column:
    """22 numbers from 0 to 1; what is missing is 0."""
    third = lambda c: F.when(c.between(0, 3), c / 3.0).otherwise(0.0)
    codes = F.filter(F.transform(ages, lambda a: F.array_position(F.array(*map(F.lit, AGES)), a) - 1), lambda i: i >= 0)
    level = lambda c, mid, high: F.when(c.rlike(mid), 0.5).when(c.rlike(high), 1.0).otherwise(0.0)
    calm = F.when(activity.rlike("Chill|Relaxed"), 0.0).otherwise(level(activity, "Balanced", "Active"))
    care = F.when(safety.rlike("Very Safety"), 0.0).otherwise(level(safety, "Balanced", "Ready for Anything"))
    fame = F.when(popularity.rlike("Off the Beaten"), 0.0).otherwise(level(popularity, "Classic", "Mainstream|Trendy"))
    hot = lambda c, names: [F.coalesce(F.array_contains(c, n), F.lit(False)).cast("double") for n in names]
    youngest = F.coalesce(F.array_min(codes) / 3.0, F.lit(0.0))
    return F.array(*(F.coalesce(c, F.lit(0.0)) for c in (third(budget), third(season), youngest, calm, care, fame)), *hot(experiences, EXPERIENCES), *hot(scenery, SCENERY))


def part(v: Column, name: str) -> Column:
    return F.slice(v, *PARTS[name])


def weights(strategy: str) -> Column:
    return F.array(*(F.lit(float(PROFILES[strategy].get(i, 1.0))) for i in range(22)))


def adaptive_weights(budget: Column, people: Column, days: Column) -> Column:
    """Weights of a trip: dear places for tight budgets, pace for short trips, taste for large parties."""
    tight = F.coalesce(budget, F.lit(0)) / F.greatest(F.lit(1), people * days) < 100
    short, many = days < 4, people >= 4
    taste = F.when(many, 2.0).when(short, 2.5).otherwise(1.0)
    return F.array(*({0: F.when(tight, 3.0).otherwise(1.0), 3: F.when(short, 3.5).otherwise(1.0)}.get(i, taste if 6 <= i < 14 else F.lit(1.0)) for i in range(22)))


def conflict(a: Column, b: Column, w: Column) -> Column:
    """How far two travellers are apart, over the most that the weights allow."""
    own = lambda v: F.slice(v, 1, 6)
    mean = lambda name: F.aggregate(part(w, name), F.lit(0.0), lambda s, x: s + x) / 8
    apart = lambda name: (1 - numeric.multi_hot_jaccard(part(a, name), part(b, name))) * mean(name) * 8
    most = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    return (numeric.weighted_l2(own(a), own(b), own(w)) + apart("experiences") + apart("scenery")) / F.greatest(most, F.lit(1e-6))


def relevance(v: Column, budget: Column, season: Column, trip_budget: Column, trip_season: Column, short: Column, many_cities: Column, with_budget: bool = True) -> Column:
    """How well a traveller fits a trip: budget 2.5, 1.5 or 0.5, season 1.5 or 0.3, pace, daring, interests up to 1."""
    off = F.abs(budget - trip_budget)
    money = F.coalesce(F.when(off == 0, 2.5).when(off == 1, 1.5).when(off == 2, 0.5), F.lit(0.0)) if with_budget else F.lit(0.0)
    time = F.coalesce(F.when(season == trip_season, 1.5).when(season.isNotNull() & trip_season.isNotNull(), 0.3), F.lit(0.0))
    pace = F.when(short, v[3] * 0.8).otherwise((1 - F.abs(v[3] - 0.5)) * 0.5)
    interests = F.aggregate(F.slice(v, 7, 16), F.lit(0.0), lambda s, x: s + x)
    return money + time + pace + F.when(many_cities, v[4] * 0.5).otherwise(0.0) + F.least(interests * 0.15, F.lit(1.0))


def top(df: DataFrame, group: list[str], score: str, key: str, n: int) -> DataFrame:
    """The n best of each group, ties by key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), key))).where(F.col("_n") <= n).drop("_n")


def weighted_pick(df: DataFrame, group: list[str], weight: str, key: str, seed: int) -> DataFrame:
    """One row per group, by weight: the largest of u to the power 1 / w, where u comes from a hash of seed and key."""
    u = (draw(str(seed), F.col(key)) + 1) / F.lit(2.0**32 + 1)
    rows = df.withColumn("_k", F.log(u) / F.col(weight))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_k"), key))).where("_n = 1").drop("_n", "_k")


def opponents(pool: DataFrame, group: str, key: str, score: str, vectors: str, w: list[float], k: int, balance: float = 0.6, candidates: int | None = None) -> DataFrame:
    """k of each group in order: first the best, then, again and again, that of the highest
    balance * score + (1 - balance) * least conflict with those chosen. Groups are cut to their best `candidates` (10 k) before; 0
    cuts none, and then whole groups, of any size, are chosen from in parts (see greedy)."""
    if candidates == 0:
        far = F.array(*(F.lit(float(x)) for x in w))
        return chosen_in_turn(pool, group, key, score, vectors, k, lambda s, least: balance * s + (1 - balance) * least, lambda a, b: conflict(a, b, far))
    cut = top(pool.select(group, key, score, vectors), [group], score, key, candidates or 10 * k)
    weight = np.array(w)
    most = max(1e-6, float(np.sqrt((weight**2).sum())))

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each row of b from a."""
        out = np.sqrt((((b[:, :6] - a[:6]) * weight[:6]) ** 2).sum(axis=1))
        for lo in (6, 14):
            x, y = a[lo : lo + 8], b[:, lo : lo + 8]
            either = np.maximum(x, y).sum(axis=1)
            same = np.where(either == 0, 0.0, np.minimum(x, y).sum(axis=1) / np.where(either == 0, 1, either))
            out = out + (1 - same) * weight[lo : lo + 8].mean() * 8
        return out / most

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        v, s = np.stack(rows[vectors].to_numpy()), rows[score].to_numpy()
        chosen, least = [0], apart(v[0], v)
        while len(chosen) < min(k, len(rows)):
            value = balance * s + (1 - balance) * least
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            least = np.minimum(least, apart(v[chosen[-1]], v))
        return pd.DataFrame({group: rows[group].iloc[chosen], key: rows[key].iloc[chosen], "place": np.arange(1, len(chosen) + 1)})

    kinds = dict(pool.dtypes)
    return cut.groupBy(group).applyInPandas(select, f"{group} {kinds[group]}, {key} {kinds[key]}, place long")


def spread(pool: DataFrame, group: str, key: str, score: str, vectors: str, k: int, balance: float = 0.6, candidates: int | None = None) -> DataFrame:
    """As `opponents`, by balance * score - (1 - balance) * greatest cosine similarity with those chosen. Groups are cut to
    their best `candidates` before: 500, or k if that is more, as the original preselects; 0 cuts none, as in `opponents`."""
    if candidates == 0:
        return chosen_in_turn(pool, group, key, score, vectors, k, lambda s, least: balance * s - (1 - balance) * (1 - least), numeric.cosine_distance)
    cut = top(pool.select(group, key, score, vectors), [group], score, key, candidates or max(500, k))

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        v, s = np.stack(rows[vectors].to_numpy()).astype(float), rows[score].to_numpy().astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        chosen, most = [0], v @ v[0]
        while len(chosen) < min(k, len(rows)):
            value = balance * s - (1 - balance) * most
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            most = np.maximum(most, v @ v[chosen[-1]])
        return pd.DataFrame({group: rows[group].iloc[chosen], key: rows[key].iloc[chosen], "place": np.arange(1, len(chosen) + 1)})

    kinds = dict(pool.dtypes)
    return cut.groupBy(group).applyInPandas(select, f"{group} {kinds[group]}, {key} {kinds[key]}, place long")


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(numeric.jaccard(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), F.lit(0.0))


def feature_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How alike two travellers (experiences, scenery, budget, season) are, 1 at most."""
    equal = lambda k: F.coalesce(a[k] == b[k], F.lit(False))
    return F.least(0.6 * _jaccard(a["experiences"], b["experiences"]) + 0.4 * _jaccard(a["scenery"], b["scenery"]) + F.when(equal("budget"), 0.2).otherwise(0.0) + F.when(equal("season"), 0.1).otherwise(0.0), F.lit(1.0))


def rule_score(trip_budget: Column, trip_season: Column, who: dict[str, Column]) -> Column:
    """How well a traveller fits a trip by rule: budget 2 or, one step off, 1; season 1; a little for many interests."""
    off = F.abs(trip_budget - who["budget"])
    size = lambda k: F.least(F.greatest(F.size(who[k]), F.lit(0)), F.lit(4))
    return F.coalesce(F.when(off == 0, 2.0).when(off == 1, 1.0), F.lit(0.0)) + F.when(trip_season == who["season"], 1.0).otherwise(0.0) + 0.05 * size("experiences") + 0.03 * size("scenery")
