import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from sojourn.llm import anchors, repeats

SCHEMA = "doc_id long, text string, same string, n_bytes string, spans string"


def brute(rows, length):
    where = defaultdict(set)
    texts = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where[t[p : p + length]].add((i, p))
    out = []
    for (d, _), (i, t) in zip(rows, enumerate(texts)):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if len(where[t[p : p + length]]) > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(5))
    text = lambda n: "".join(word() for _ in range(n))[:n]
    passage, base = text(700), text(3000)
    out = [None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 2500, base, base, base[:2999], base[1:]]
    out += [text(rnd.randint(0, 800)) + passage[rnd.randint(0, 200) : rnd.randint(420, 700)] + text(rnd.randint(0, 800)) for _ in range(12)]
    for _ in range(25):
        b = list(base)
        for _ in range(rnd.randint(1, 6)):
            b[rnd.randrange(len(b))] = "#€\n"[rnd.randrange(3)]
        out.append("".join(b))
    out += [passage + "|" + passage, passage[:400], text(5000) + passage[100:500]]
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_as_brute_force(spark, hot):
    rows = list(enumerate(corpus(1))) + [(None, "q" * 300 + "r" * 300), (None, "another without id"), (6, "an id that is there")]
    got = repeats.remove_repeats(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(3), hot_classes=hot).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 400)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_family_over_batches(batch):
    rnd = random.Random(batch)
    base, length = bytes(rnd.choice(b"ab") for _ in range(120)), 30
    contexts = []
    for i in range(60):
        b = bytearray(base)
        for _ in range(rnd.randint(0, 3)):
            b[rnd.randrange(120)] = rnd.choice(b"cd")
        b[50:60] = base[50:60]
        contexts.append((bytes(b), 50, rnd.randint(0, 5), rnd.randint(6, 20), i))
    family, found = repeats.Family(repeats.Units(length, 1)), set()
    for i in range(0, len(contexts), batch):
        found |= {(o, t) for o, first, last in family.add(contexts[i : i + batch]) for t in range(first, last + 1)}
    want = {(i, t) for x, a, lo, hi, i in contexts for t in range(lo, hi + 1) if any(j != i and l2 <= t <= h2 and y[a - t : a - t + length] == x[a - t : a - t + length] for y, _, l2, h2, j in contexts)}
    assert found == want
    assert len(family.levels) <= 8


def test_runs_cover_all_windows_and_depend_on_them_alone(monkeypatch):
    rng = np.random.default_rng(0)
    for place in (22, 10):
        monkeypatch.setattr(anchors, "PLACE", place)
        data = rng.integers(0, 4, 5000, dtype=np.uint8)
        gram, at, lo, hi = anchors.runs(data, 100, 16)
        assert lo[0] == 0 and hi[-1] == 4900 and (lo[1:] == hi[:-1] + 1).all() and (at >= hi).all() and (at + 16 <= lo + 100).all()
        moved = anchors.runs(np.r_[rng.integers(0, 4, 77, dtype=np.uint8), data[1000:2000]], 100, 16)
        by = lambda r, p: next((g, a - p) for g, a, x, y in zip(*r) if x <= p <= y)
        for p in range(1000, 1900, 37):
            assert by((gram, at, lo, hi), p) == by(moved, p - 1000 + 77)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_contexts_of_a_hot_passage_are_merged(spark, monkeypatch):
    """One passage in many texts: no shard gets more contexts than the limit, and results are whole."""
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, most, real = text(900), [], repeats.common_spans
    rows = [(i, text(500) + passage + text(500)) for i in range(40)] + [(40, passage[:600]), (41, text(9) + passage[100:700] + "!")]

    def spy(contexts, *more):
        most.extend(r["count"] for r in contexts.groupBy("shard").count().collect())
        return real(contexts, *more)

    monkeypatch.setattr(repeats, "common_spans", spy)
    got = repeats.remove_repeats(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(3), hot_classes=10).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 400)
    assert max(most) <= 10


@pytest.mark.parametrize("batch", [1, 3, 8, 1000])
def test_families_end_with_their_shard(monkeypatch, batch):
    rnd, length, kept, real = random.Random(4), 30, [], repeats.Family.add
    shards, texts = [s for s, n in enumerate([1, 7, 2, 30, 1, 1, 9, 16]) for _ in range(n)], [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(6)]
    rows = [{"shard": s, "doc_id": i, "same": b"", "anchor": 1000, "text": rnd.choice(texts) + bytes([97 + i % 26, 97 + i // 26]), "at": 20, "least": 0, "most": 20} for i, s in enumerate(shards)]

    def add(self, contexts):
        owners = [shards[c[-1][0]] for c in contexts]
        old = {shards[o[0]] for level in self.levels for o in level.owner}
        kept.append(not old or old == set(owners))
        return real(self, contexts)

    monkeypatch.setattr(repeats.Family, "add", add)
    got = [tuple(r.values()) for b in repeats.shard_spans(iter([repeats.pa.RecordBatch.from_pylist(rows)]), repeats.Units(length, 1), batch) for r in b.to_pylist()]
    found = {(d, t) for d, _, first, last in got for t in range(1000 - last, 1000 - first + 1)}
    cut = lambda r, t: r["text"][20 - t : 20 - t + length]
    want = {(r["doc_id"], t) for r in rows for t in range(21) if any(o is not r and o["shard"] == r["shard"] and cut(o, t) == cut(r, t) for o in rows)}
    assert want <= found and all(kept)


def brute_passages(rows, words):
    """Words of each (id, text) in windows that another (id, text) has too."""
    docs = sorted({(d, t or "") for d, t in rows}, key=str)
    where = defaultdict(set)
    split = [t.encode().split() for _, t in docs]
    for i, w in enumerate(split):
        for p in range(len(w) - words + 1):
            where[tuple(w[p : p + words])].add(i)
    out = {}
    for (d, t), (i, w) in zip(docs, enumerate(split)):
        hit = np.zeros(len(w), bool)
        for p in range(len(w) - words + 1):
            if len(where[tuple(w[p : p + words])]) > 1:
                hit[p : p + words] = True
        out[d, t] = int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum())
    return out


def wordy(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(["the", "of", "a", "Été", "rain", "in"]) + rnd.choice("abcdefgh") for _ in range(n))
    passage, line = text(90), text(20)
    out = [None, "", "one", passage, " ".join([line] * 9), text(5) + " " + " ".join([line] * 9), text(60), passage + "\n" + passage]
    out += [text(rnd.randint(0, 90)) + " " + " ".join(passage.split()[rnd.randint(0, 40) : rnd.randint(60, 90)]) + "\t" + text(rnd.randint(0, 90)) for _ in range(30)]
    return out + [" ".join([text(20), *[text(3)] * 30])]


@pytest.mark.parametrize("hot", [2000, 3])
def test_passages_across_documents(spark, hot):
    rows = list(enumerate(wordy(3))) + [(3, wordy(3)[3]), (None, wordy(3)[3]), (5, "an id that is there")]
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(3)
    got = {(r.doc_id, r.same): (r.passage_words, r.n_passages) for r in repeats.shared_passages(docs, 31, hot).collect()}
    want = {(d, repeats.text_digest(t.encode())): x for (d, t), x in brute_passages(rows, 31).items() if x[0]}
    assert got == want and len(want) > 20
    every = repeats.remove_repeats(docs, passage_words=31).collect()
    assert sorted((str(r.doc_id), r.passage_words) for r in every) == sorted((str(d), brute_passages(rows, 31)[d, t or ""][0]) for d, t in rows)


def test_index_takes_batches(spark):
    rows = list(enumerate(corpus(2)))
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    index, spans = repeats.RepeatIndex(spark, repeats.byte_units()), None
    for k in range(5):
        own = index.add(docs.where(f"doc_id % 5 = {k}"))
        spans = own if spans is None else spans.unionByName(own)
    got = {r.doc_id: r.units for r in repeats.covered(spans, 400).collect()}
    assert got == {d: n for d, _, n, *_ in brute(rows, 400) if n}
    assert len(index.levels) <= 3


@pytest.mark.parametrize("doc", [7, None])
def test_one_id_for_many_texts(spark, doc):
    """Texts of one id, or of none, are read once each: the rows that are read again don't grow with the square of their number."""
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(600))
    rows = [(doc, "".join(rnd.choice("abcdefgh ") for _ in range(500)) + passage[: rnd.randint(450, 600)]) for _ in range(40)]
    table = spark.createDataFrame([(d, t, "", "", "") for d, t in rows], SCHEMA).repartition(4)
    got = repeats.remove_repeats(table)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == brute(rows, 400)
    lists = table.select("doc_id", repeats.same_of().alias("same"))
    assert repeats.texts_of(table, lists).count() == 40


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_runs_of_texts_side_by_side(kind, monkeypatch):
    monkeypatch.setattr(anchors, "TOGETHER", 900)
    rng = np.random.default_rng(5)
    sizes = [0, 30, 99, 100, 101, 0, 0, 2000, *rng.integers(0, 400, 60).tolist(), 5, 0]
    starts = np.cumsum([0, *sizes])
    data = rng.integers(0, 3, starts[-1]).astype(kind)
    *got, counts = anchors.runs_of_many(data, starts, 100, 16)
    each = [anchors.runs(data[a:b], 100, 16) for a, b in zip(starts[:-1], starts[1:])]
    assert counts.tolist() == [len(x[0]) for x in each] and counts.sum() > 100
    assert all(np.array_equal(x, np.concatenate(y)) for x, y in zip(got, zip(*each)))
    assert [len(x) for x in anchors.runs_of_many(data[:0], np.zeros(1, np.int64), 100, 16)] == [0] * 5


def test_texts_are_hashed_side_by_side(monkeypatch):
    calls, hashes = [], anchors.gram_hashes
    monkeypatch.setattr(anchors, "gram_hashes", lambda data, k: calls.append(len(data)) or hashes(data, k))
    texts = [bytes(np.random.default_rng(i).integers(97, 120, 500).astype(np.uint8)) for i in range(40)]
    anchors.runs_of_many(np.frombuffer(b"".join(texts), np.uint8), np.arange(41) * 500, 400, 64)
    assert calls == [20_000]
