r"""Exact deduplication with content-defined chunk recipes; DataFrame functions only.

A text without its white space is cut into chunks whose ends depend on nearby content. A chunk's identifier is a 64-bit hash,
verified over the whole corpus: distinct (hash, chunk) pairs are counted per hash, after a map-side distinct, so every chunk
text moves once at most and each long document never. Hashes that stand for several chunk texts get an ordinal for each of
them. Two texts are equal when their ordered identifier lists are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.common import SPACES, materialize, text_or_empty

#: A chunk ends at the first of these character pairs after 256 characters, at 2048 characters, or with the text.
CHUNK = r"(?s).{256,2046}?[aeiou0-9\x{80}-\x{10FFFF}][nrst]|.{1,2048}"


def normalized(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def cut(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def dedup(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks; one row per row of docs.

    Texts are equal when identical without white space; null counts as empty, and empty texts equal each other. Of equal texts
    the one with the most code points stays, then the smallest doc_id; null doc_id stays only if no other does. Rows that repeat
    the doc_id that stays are all kept. An empty table gives no rows; further columns are ignored.
    """
    base = docs.select("doc_id", F.char_length(text_or_empty()).alias("points"), normalized(text_or_empty()).alias("norm"))
    cuts = base.select("doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), cut(F.col("norm")).alias("chunks"))
    recipes = materialize(cuts.select("doc_id", "points", "text_sha256", F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe")), "dedup-recipes")
    chunks = base.select(F.explode(cut(F.col("norm"))).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
    distinct = chunks.distinct()
    shared = materialize(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "dedup-shared")
    keys = ["recipe"]
    if not shared.isEmpty():
        order = Window.partitionBy("h").orderBy("chunk")
        told = materialize(distinct.join(shared, "h").withColumn("ordinal", F.row_number().over(order)), "dedup-told")
        places = cuts.select("text_sha256", F.posexplode("chunks").alias("at", "chunk")).distinct().withColumn("h", chunk_hash(F.col("chunk")))
        lists = places.join(told, ["h", "chunk"]).groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("at", "ordinal"))).alias("ordinals"))
        recipes = recipes.join(lists, "text_sha256", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<struct<at:int,ordinal:int>>")))
        keys.append("ordinals")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = recipes.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1").select(*keys, "group_size", F.col("best.id").alias("best_id"))
    rows = recipes.join(materialize(groups, "dedup-groups"), keys, "left")  # groups lie apart, so the join of a large one can be split
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))
