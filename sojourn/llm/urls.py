"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for what no rule fits.

Suffix statistics come from all rows that the rules label; a URL that trains has those of the other folds of URLs, so that its own
label is no part of what it learns from. The trees alone are trained on a sample of the labelled URLs, at most
`sample_urls` different ones. Judging is a projection and one join over all rows, a broadcast if the suffixes are counted few.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import broadcast_if_small, least_hashes, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
FOLDS = 5
FEATURES = ["length", "host_length", "labels", "depth", "digits", "entropy", "params", "hyphens", "suffix_rate", "suffix_count"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_by(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """Struct rule, verdict of the longest rule that fits; null if none does. Rules are a parameter, a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the address alone; null counts as empty."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)

    def part(total: Column, c: Column) -> Column:
        p = (F.char_length(u) - F.char_length(F.replace(u, c, F.lit("")))) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    letters = F.array_distinct(F.filter(F.split(u, ""), lambda c: c != ""))
    return {
        "length": F.char_length(u).cast("double"), "host_length": F.char_length(host).cast("double"), "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.regexp_count(path, F.lit("[^/]+")).cast("double"), "digits": F.regexp_count(u, F.lit("[0-9]")) / n, "entropy": F.aggregate(letters, F.lit(0.0), part),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")), "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "suffix": F.concat_ws("/", F.substring_index(host, ".", -1), F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5})\z", 1)),
    }


def parsed(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    out = base.withColumn("judged", judged_by(rules, F.col("host"), F.col("path")))
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), F.col("judged.verdict").alias("ruled"), *(c.alias(k) for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()))


def with_suffixes(rows: DataFrame, suffixes: DataFrame, count: int, rate: float) -> DataFrame:
    joined = rows.join(broadcast_if_small(suffixes, count), "suffix", "left")
    return joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(rate))).withColumn("suffix_count", F.coalesce("suffix_count", F.lit(0.0)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample_urls: int = 20_000, trees: int = 10, depth: int = 4, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, chance (of block; null where a rule decides); one row per row of pages.

    labelled: rows (url, block 0/1) to learn from instead of those the rules label. With one label only, or none, every URL
    without a rule is allowed, or blocked if all labels say block. Null and empty URLs are judged like others, by no rule.
    Repeated rows are each judged, alike; an empty table gives no rows; further columns are ignored.
    """
    rows = parsed(pages, rules)
    source = rows.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    if labelled is not None:
        named = labelled.select(F.col("block").cast("double").alias("page_id"), "url").where("page_id is not null")
        source = parsed(named, []).withColumnRenamed("page_id", "label")
    source = source.withColumn("fold", F.pmod(F.xxhash64(F.lit(4), "host", "path"), F.lit(FOLDS)))
    folds = materialize(source.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count("label").alias("n")), "url-suffixes")
    counts = folds.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("suffixes"), F.coalesce(F.sum("blocked") / F.sum("n"), F.lit(0.0)).alias("rate")).first()
    if total.rate in (0.0, 1.0):
        scored = rows.withColumn("chance", F.lit(total.rate))
    else:
        share = lambda blocked, n: (blocked + 5 * total.rate) / (n + 5)
        suffixes = counts.select("suffix", share(F.col("blocked"), F.col("n")).alias("suffix_rate"), F.log1p("n").alias("suffix_count"))
        learned = ["label", "suffix", "fold", *FEATURES[:-2]]
        chosen = source.select(F.xxhash64(F.lit(3), "host", "path", *learned).alias("n"), *learned)
        different = chosen.agg(F.approx_count_distinct("n", 0.02)).first()[0]
        first = least_hashes(chosen.select(F.col("n").alias("h")).distinct(), F.col("h"), different, sample_urls).select("n")  # copies of a URL count once
        sample = materialize(chosen.join(F.broadcast(first), "n", "left_semi").distinct().orderBy("n", *learned).limit(sample_urls), "url-sample")
        columns = VectorAssembler(inputCols=FEATURES, outputCol="features")
        whole = counts.select("suffix", F.col("blocked").alias("b"), F.col("n").alias("m"))
        others = folds.join(whole, "suffix").select("suffix", "fold", share(F.col("b") - F.col("blocked"), F.col("m") - F.col("n")).alias("suffix_rate"), F.log1p("m").alias("suffix_count"))
        data = sample.join(others, ["suffix", "fold"])
        data = columns.transform(data).select("label", "features").coalesce(1)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=3).fit(data)
        scored = model.transform(columns.transform(with_suffixes(rows, suffixes, total.suffixes, total.rate))).withColumn("chance", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("chance") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("chance")).alias("chance"))
