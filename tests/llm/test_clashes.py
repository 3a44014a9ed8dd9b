"""Further columns, named as what the operators use and return, change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sojourn.llm import alignment, bpe, exact_dedup, lm, media, minhash, mixing, packing, repeats, runs, toxicity, urls

BYTE, PIECE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
TEXTS = ["one two three four five six seven", "one two three four five six seven", "a scum b. fine day", None, "", "x " * 300, "lorem ipsum dolor " * 40, "lorem ipsum dolor " * 40 + "sit"]
NAMES = "id key keys key_1 node n sig same bucket block at words counts ids sizes codes flag flags size target taken copies sid shard row length offset piece start sequence_id gram anchor lo hi first last spans score held_out predicted offending kept keep_id group_size text_key component_id runs collapsed n_words pair count best a b media feature _k _s _v d s".split()


def table(spark, clashes):
    rows = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    for i, name in enumerate(NAMES if clashes else []):
        rows = rows.withColumn(name, F.lit("clash") if i % 2 else F.lit(i))
    return rows


OPERATORS = {
    "media": media.store_and_read,
    "bpe": lambda d: bpe.digests(d, BYTE),
    "mixing": mixing.mix,
    "exact_dedup": exact_dedup.dedup,
    "minhash": lambda d: minhash.near_duplicates(d, 4),
    "repeats": lambda d: repeats.remove_repeats(d, 64),
    "lm": lambda d: lm.score(d).withColumn("score", F.round("score", 4)),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", (F.col("doc_id") == 2).cast("int").alias("toxic"), F.lit(1).alias("n"), F.lit("x").alias("text")))),
    "alignment": lambda d: alignment.align(d, BYTE, PIECE)[0],
    "packing": lambda d: packing.pack(d, WORD).drop("sequence_id", "offset"),
    "runs": runs.find_runs,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    plain, clashing = (OPERATORS[name](table(spark, c)) for c in (False, True))
    assert plain.columns == clashing.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, clashing.collect()))


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.net/es/x", "http://b.com/", None, "ftp://c.org/q?x=1", "http://www.example.com/en/"])], "page_id long, url string")
    more = pages
    for name in ("host", "path", "rule", "verdict", "label", "suffix", "fold", "n", "length", "depth", "chance", "judged", "features"):
        more = more.withColumn(name, F.lit("clash"))
    assert sorted(map(str, urls.judge(pages).collect())) == sorted(map(str, urls.judge(more).collect()))
