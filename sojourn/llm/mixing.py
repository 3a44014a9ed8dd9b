"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target is its share of all words by weight, at most `cap` times its size, the excess shared again by weight.
Blocks of `block` words are given to sources by the highest quotients target / (2k + 1), then each source's blocks to its
shards by the same rule; a shard holds about `shard_docs` documents, or more if shards would else outnumber a shard's documents by
far, so a source with a third of all rows is many tasks.
Inside a shard the documents lie in seeded order and a run of blocks, starting at a seeded block and going round, is taken.
No quotient list grows with the number of blocks: seats that are certain come from a divisor, and only about two candidates
for each party are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import WORD, broadcast_if_small, materialize, text_key, text_or_empty

WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """sizes (source, source_size, docs) with sid (its place by code point, null last), weight and target added.

    One row per source goes through one window; this table has no row per document."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    up = every.orderBy("ratio", "sid")
    ranked = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    total = F.sum("source_size").over(every)
    left = total - F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("most")
    level = left / F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = ranked.withColumn("total", total).withColumn("level", level)
    share = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    target = F.when(F.col("ratio") <= F.col("level"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), share * F.col("weight")))
    return leveled.withColumn("target", target).select("sid", "source", "docs", "source_size", "weight", "total", "target")


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Add `out`: the seats of each party in its group, by the highest quotients votes / (2k + 1), ties by party.

    With V votes, S parties and N seats, the divisor V / (N - S/2) gives at most N seats, all among the N highest, and
    V / (N + S/2) at least N; only the quotients between are ranked, about 2S."""
    g = Window.partitionBy(*group)
    p = parties.withColumn("_v", F.sum(F.col(votes).cast("double")).over(g)).withColumn("_s", F.count(F.lit(1)).over(g))
    fit = lambda n: F.when((F.col("_v") > 0) & (n > 0), F.floor(F.col(votes) / F.col("_v") * n + 0.5)).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_lo", fit(F.col(seats) - F.col("_s") / 2)).withColumn("_hi", F.when(F.col(votes) > 0, fit(F.col(seats) + F.col("_s") / 2) + 1).otherwise(F.col("_lo")))
    p = p.withColumn("_open", F.col(seats) - F.sum("_lo").over(g))
    seat = F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1)))
    c = p.select("*", seat.alias("_k"))
    c = c.withColumn("_r", F.row_number().over(g.orderBy(F.desc_nulls_last(F.col(votes) / (2 * F.col("_k") + 1)), *party, "_k")))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_r") <= F.col("_open")), 1).otherwise(0))
    keep = [x for x in parties.columns if x not in {*group, *party}]
    return c.groupBy(*group, *party).agg(*(F.first(x).alias(x) for x in keep), (F.first("_lo") + won).cast("long").alias(out))


def mix(docs: DataFrame, seed: int = 7, block: int = 16, shard_docs: int = 2_000, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, text_key (a hash of the text).

    size counts the words of the whole text (null: 0). taken is how many words of the document the mix holds, at most `cap`
    times its size; copies is how often the whole document is used if only whole documents can be (its first word decides).
    Null doc_id or source are values like any other; of repeated rows each is a document; empty texts have 0 taken; an empty
    table gives no rows; further columns are ignored. The same rows give the same result in any order and partitioning.
    """
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), text_key().alias("text_key")), "mix-sizes")
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, cap), "mix-sources")
    seated = sainte_lague(sources.withColumn("blocks", F.round(F.col("total") / block).cast("long")).withColumn("g", F.lit(0)), ["g"], ["sid"], "target", "blocks", "quota")
    small = broadcast_if_small(sources.select("source", "sid", "docs", "source_size", "target"), sources.count())
    rows = sized.alias("d").join(small.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "text_key", "d.source", "size", "sid", "source_size", "target", F.ceil(F.col("docs") / F.greatest(F.lit(shard_docs), 10 * F.sqrt("docs"))).alias("shards"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.col("shards")))
    shards = rows.groupBy("sid", "shard").agg(F.sum("size").alias("n"))
    plan = sainte_lague(shards.join(seated.select("sid", "quota"), "sid"), ["sid"], ["shard"], "n", "quota", "blocks").select("sid", "shard", "n", "blocks")
    w = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("b", F.sum("size").over(w)).withColumn("a", F.col("b") - F.col("size")).join(plan, ["sid", "shard"], "left")
    words = F.least(F.col("blocks") * block, cap * F.col("n"))
    placed = placed.withColumn("rounds", F.when(F.col("n") > 0, F.floor(words / F.col("n"))).otherwise(0)).withColumn("rest", F.when(F.col("n") > 0, words % F.col("n")).otherwise(0))
    placed = placed.withColumn("o", block * F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), F.greatest(F.ceil(F.col("n") / block), F.lit(1)))).withColumn("z", F.col("o") + F.col("rest"))
    inside = lambda lo, hi: F.greatest(F.least(F.col("b"), hi) - F.greatest(F.col("a"), lo), F.lit(0))
    part = inside(F.col("o"), F.col("z")) + inside(F.col("o") - F.col("n"), F.col("z") - F.col("n"))
    first = ((F.col("a") >= F.col("o")) & (F.col("a") < F.col("z"))) | (F.col("a") < F.col("z") - F.col("n"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"), (F.col("rounds") + first.cast("long")).cast("long").alias("copies"), "text_key")
