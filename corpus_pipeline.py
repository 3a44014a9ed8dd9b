"""The corpus pipeline: toxic documents out, exact and near copies out, sources mixed to target weights, then BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of documents; further columns are dropped. Decisions are brought back to rows by doc_id and a hash of
the text, so rows without a doc_id and rows that share one are documents like any other. Null and empty texts are empty
documents: not toxic, copies of each other, near copies of nothing, with no words to mix (the place of their first word decides).
Of repeated rows one stays. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sojourn.llm import bpe, exact_dedup, minhash, mixing, toxicity
from sojourn.llm.common import broadcast_if_small, materialize, table, text_key, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, learnt from the labels, doesn't hold for toxic. The rows are filtered where
    they lie."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def once(docs: DataFrame, judged: DataFrame, key: Column) -> DataFrame:
    """The rows of docs that `kept` says, told apart by doc_id and key; of rows that repeat both, the longest text stays."""
    docs = docs.select(*COLUMNS, key.alias("_key"))
    counts = judged.groupBy("doc_id", "_key").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    odd = materialize(counts.where("not kept or rows > 1").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "kept"), "dropped")
    n = odd.count()
    same = lambda o: docs["doc_id"].eqNullSafe(o["_id"]) & (docs["_key"] == o["_k"])
    few = broadcast_if_small(odd, n, 100)
    out = docs.join(few, same(odd), "left_anti")
    again = odd.where("kept")
    if not again.isEmpty():
        order = Window.partitionBy("doc_id", "_key").orderBy(F.char_length("text").desc(), "text", *(c for c in COLUMNS if c != "text"))
        rows = docs.join(broadcast_if_small(again, again.count(), 100), same(again), "left_semi").withColumn("_n", F.row_number().over(order))
        out = out.unionByName(rows.where("_n = 1").drop("_n"))
    return out.select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: that which exact_dedup keeps."""
    judged = exact_dedup.dedup(docs).select("doc_id", "kept", F.col("text_sha256").alias("_key"))
    return once(docs, judged, F.sha2(exact_dedup.normalized(text_or_empty()), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of five-word shingles and a similarity of 0.8: that of the smallest id."""
    judged = minhash.near_duplicates(docs).select("doc_id", "kept", F.col("text_key").alias("_key"))
    return once(docs, judged, text_key())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it whole, so that sources come near their targets."""
    used = mixing.mix(docs).groupBy("doc_id", "source", "text_key").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    used = materialize(used.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_key").alias("_k"), "copies"), "mix-copies")
    rows = docs.select(*COLUMNS, text_key().alias("_key"))
    match = rows["doc_id"].eqNullSafe(used["_id"]) & rows["source"].eqNullSafe(used["_source"]) & (rows["_key"] == used["_k"])
    joined = rows.join(broadcast_if_small(used, used.count(), 100), match)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("source mixing", mix_sources), ("bpe", encode)]
#: SQL can express neither the trained model of the first stage nor the vocabulary of the last; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not encode:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
