r"""Toxicity by multiple-instance learning.

A sentence's chance is the logistic of a bias and its words' weights; a document's is their noisy-or, 1 - prod(1 - p). Weights
are learnt from document labels alone, by gradient descent on the noisy-or likelihood, over a bounded sample of labelled rows in
one task (`sample_docs`); scoring is map-only over all rows and whole texts, and tells which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import bound_batches, least_hashes, materialize, text_or_empty

#: Words and sentence ends; a sentence is what lies between two ends.
TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")


class Words(dict):
    """A word's feature: 63 bits of its hash, -1 for a sentence end. Emptied at a bound, so memory doesn't grow with a corpus."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = x = -1 if word in ENDS else xxhash.xxh3_64_intdigest(word.encode(errors="surrogatepass")) >> 1
        return x


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature and sentence of each word, and how many sentences there are (one at least)."""
    found = TOKEN.findall(text.lower())
    ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    end = ids < 0
    sentence = np.cumsum(end)
    real = ~end
    sentence = sentence[real]
    if not len(sentence):
        return ids[real], sentence, 1
    fresh = np.r_[True, sentence[1:] != sentence[:-1]]
    return ids[real], np.cumsum(fresh) - 1, int(fresh.sum())


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(texts: list[str], labels: list[int], evidence: float = 20.0, steps: int = 200, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted), their weights, and the bias. Words are features if their documents are toxic more often than others by a
    likelihood ratio of `evidence` at least. Without both labels there are no features, and all documents score alike."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), -6.0 if len(y) == 0 or y[0] == 0 else 6.0
    words, ids, sent, first, n = Words(), [], [], [0], 0
    for t in texts:
        f, s, k = features(t, words)
        ids.append(f)
        sent.append(s + n)
        n += k
        first.append(n)
    ids, sent, first = np.concatenate(ids), np.concatenate(sent), np.array(first)
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    vocabulary, code = np.unique(ids, return_inverse=True)
    pairs = np.unique(owner[sent] * len(vocabulary) + code)
    docs = np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
    toxic = np.bincount(pairs % len(vocabulary), y[pairs // len(vocabulary)], len(vocabulary))
    share = y.mean()
    a, b = toxic, docs - toxic
    part = lambda x, e: x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9))
    ratio = 2 * (part(a, docs * share) + part(b, docs * (1 - share)))
    keep = (a > docs * share) & (ratio >= evidence)
    new = np.cumsum(keep) - 1
    on = keep[code]
    code, sent, m = new[code[on]], sent[on], int(keep.sum())
    odds = np.log((a[keep] + share) / (b[keep] + 1 - share)) - np.log(share / (1 - share))
    w, bias = np.clip(odds, 0, 5) + 2, -float(np.log(n / len(y)) + 4)
    g2, gm, scale = np.zeros(m + 1), np.zeros(m + 1), len(y)
    for t in range(1, steps + 1):
        z = bias + np.bincount(sent, w[code], n)
        total = np.add.reduceat(softplus(z), first[:-1])
        slope = np.where(y == 1, -np.exp(-total) / -np.expm1(-np.maximum(total, 1e-9)), 1.0)
        dz = slope[owner] / (1 + np.exp(-np.clip(z, -50, 50))) / scale
        g = np.r_[np.bincount(code, dz[sent], m) + ridge * w, dz.sum()]
        gm, g2 = 0.9 * gm + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        move = rate * (gm / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return vocabulary[keep], w, float(bias)


def chances(text: str, model: tuple[np.ndarray, np.ndarray, float], words: Words) -> np.ndarray:
    """The log odds of each sentence."""
    vocabulary, w, bias = model
    ids, sent, n = features(text, words)
    if not len(ids) or not len(vocabulary):
        return np.full(n, bias)
    at = np.minimum(np.searchsorted(vocabulary, ids), len(vocabulary) - 1)
    return bias + np.bincount(sent, np.where(vocabulary[at] == ids, w[at], 0.0), n)


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of each sentence that has a word, in the order of `chances`. Lower case may have more code points,
    but no other sentences."""
    out, at = [], 0
    for m in re.finditer(r"[.!?\n]|\Z", text):
        if re.search(r"\w", text[at : m.start()]):
            out.append((at, m.start()))
        at = m.end()
    return out


def held_out(doc_id: str = "doc_id"):
    """Rows that labels aren't learnt from: crc32 of the id as text, mod 5, is 0; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most `sample_docs` labelled rows, chosen by a hash of their ids. Of several labels of an id the largest
    counts; null labels count as none. What comes to the driver is bounded by the words of the sample."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = materialize(least_hashes(own, F.xxhash64(F.lit(5), "doc_id"), own.count(), sample_docs).select("doc_id", "toxic"), "toxic-sample")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_docs ids
    texts = texts.withColumn("n", F.xxhash64(F.lit(6), "doc_id", "text")).orderBy("n", "doc_id").limit(sample_docs)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches]
        x = [t for b in rows for t in b.column("text").to_pylist()]
        vocabulary, w, bias = fit(x, [t for b in rows for t in b.column("toxic").to_pylist()])
        on = np.abs(w) > 1e-3
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[vocabulary[on], -1].astype(np.int64)), pa.array(np.r_[w[on], bias])], names=["word", "weight"])

    got = texts.select("text", "toxic").coalesce(1).mapInArrow(learn, "word long, weight double").toPandas()
    word, weight = got["word"].to_numpy(), got["weight"].to_numpy()
    if not len(word):  # nothing is labelled
        return fit([], [])
    return word[:-1], weight[:-1], float(weight[-1])


SCORED = "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>"


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (sentences of a chance of 0.5 or more, by code points); one row per row.

    Null and empty texts are one empty sentence. Equal texts have equal scores; null ids stay; further columns are ignored."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), sent.value
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = b.column("text").to_pylist()
                z = [chances(t, model, words) for t in texts]
                p = np.array([-np.expm1(-softplus(x).sum()) for x in z])
                bad = [[{"start": s, "end": e, "score": float(1 / (1 + np.exp(-v)))} for (s, e), v in zip(spans(t), x) if v >= 0] if (x >= 0).any() else [] for t, x in zip(texts, z)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(bad, kind)], names=["doc_id", "held_out", "score", "predicted", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows of docs, all columns, that aren't predicted to be toxic."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), sent.value
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = b.column("text").to_pylist()
                yield b.filter(pa.array([-np.expm1(-softplus(chances(t or "", model, words)).sum()) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
