import random
import zlib

import numpy as np

from sojourn.llm import toxicity

SCHEMA = "doc_id long, text string, toxic string, score string"


def brute(text, model):
    """A document's chance by plain loops."""
    import re

    import xxhash

    weights, left = dict(zip(model[0].tolist(), model[1].tolist())), 1.0
    sentences = [re.findall(r"\w+", s) for s in re.split(r"[.!?\n]", text.lower())]
    for s in [s for s in sentences if s] or [[]]:
        z = model[2] + sum(weights.get(xxhash.xxh3_64_intdigest(w.encode()) >> 1, 0.0) for w in s)
        left *= 1 - 1 / (1 + np.exp(-z))
    return 1 - left


def made(n, seed=0):
    rnd = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(300)], ["scum", "trash", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.15
        sentences = [[rnd.choice(plain) for _ in range(rnd.randint(3, 12))] for _ in range(rnd.randint(1, 30))]
        if toxic:
            s = rnd.choice(sentences)
            s[rnd.randrange(len(s))] = rnd.choice(bad)
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", "x", "y"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_offending_sentences(spark):
    rows, labels = made(1500)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(1, 0, None), (99999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    want = {i: t for i, _, t in labels}
    got = toxicity.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == want[r.doc_id] for r in out]) > 0.99
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert abs(r.score - brute(texts[r.doc_id], model)) < 1e-9 and r.predicted == int(r.score >= 0.5)
        for s in r.offending:
            assert any(w in texts[r.doc_id][s.start : s.end] for w in ("scum", "trash", "moron"))
    assert sum(bool(r.offending) for r in got) > 100


def test_odd_rows(spark):
    model = (np.array(sorted(toxicity.Words()[w] for w in ("scum",))), np.array([9.0]), -4.0)
    texts = [None, "", "...", "scum", "SCUM!", "a scum b\nscum", "x " * 60_000 + "scum", "é\u2028ß", "scum"]
    docs = spark.createDataFrame([(i if i else None, t, "a", "b") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i or None].score - brute(t or "", model)) < 1e-9
    assert got[None].held_out and 0 < got[1].score < 0.5 and got[6].predicted == 1
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", ""), (2, "b", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0, 0]


def test_offsets_of_letters_that_grow_in_lower_case(spark):
    """Lower case of U+0130 has two code points; sentences are told in those of the text."""
    words = toxicity.Words()
    model = (np.array(sorted(words[w] for w in ("scum",))), np.array([9.0]), -4.0)
    text = "İİİ. scum here! İ ok"
    row = toxicity.score(spark.createDataFrame([(1, text, "", "")], SCHEMA), model).first()
    assert [(x.start, x.end) for x in row.offending] == [(4, 14)] and len(toxicity.chances(text, model, words)) == len(toxicity.spans(text)) == 3
