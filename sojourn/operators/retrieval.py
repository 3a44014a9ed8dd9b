"""Groups of travellers for trips: a leader who fits the trip, and others who fit it and differ, chosen from pools of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators import personas
from sojourn.operators.greedy import chosen_in_turn
from sojourn.operators.steps import kept


def conflicting_groups(pool: DataFrame, trips: DataFrame, k: int = 4, balance: float = 0.6, strategy: str = "adaptive", prefilter: int = 0, leaders: int = 10, seed: int = 42, part_rows: int = 10_000) -> DataFrame:
    """trip, key, place: k travellers for each trip, the leader first.

    pool (trip, key, v, budget, season), v as personas.vector gives it; trips (trip, trip_budget, trip_season, budget, people, days,
    cities). A trip's pool is first cut to its `prefilter` best fits (0: 10 k; -1: none is cut), where the strategy budget_war leaves budgets
    out of the fit. The leader is drawn by weight (fit and 0.1 more) among the `leaders` best fits; the others follow in turn, each of the
    highest balance * fit + (1 - balance) * least conflict with those chosen, by the strategy's weights. Trips without travellers have
    no rows. Draws are by a hash of seed and key; keys are unique within a trip."""
    own = trips.select("trip", "trip_budget", "trip_season", "budget", "people", "days", "cities")
    rows = pool.select("trip", "key", "v", F.col("budget").alias("_level"), F.col("season").alias("_season")).join(own, "trip")
    fits = lambda with_budget: personas.relevance(F.col("v"), F.col("_level"), F.col("_season"), F.col("trip_budget"), F.col("trip_season"), F.col("days") < 4, F.col("cities") > 1, with_budget)
    rows = rows.withColumn("fit", fits(True)).withColumn("loose", fits(False) if strategy == "budget_war" else F.col("fit"))
    if prefilter >= 0:
        rows = personas.top(rows, ["trip"], "loose", "key", prefilter or 10 * k)
    w = personas.adaptive_weights(F.col("budget"), F.col("people"), F.col("days")) if strategy == "adaptive" else personas.weights(strategy)
    # a trip's weights travel with its vectors
    rows = kept(rows.select("trip", "key", "fit", F.struct("v", w.alias("w")).alias("vw")), "pool")
    heads = personas.top(rows.select("trip", "key", "fit"), ["trip"], "fit", "key", leaders).withColumn("_w", F.col("fit") + 0.1)
    lead = personas.weighted_pick(heads, ["trip"], "_w", "key", seed).select("trip", "key")
    return chosen_in_turn(rows, "trip", "key", "fit", "vw", k, lambda s, x: balance * s + (1 - balance) * x, lambda a, b: personas.conflict(a["v"], b["v"], a["w"]), lead, part_rows)
