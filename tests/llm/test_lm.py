import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sojourn.llm import lm

SCHEMA = "doc_id long, text string, score string, flag string"


def test_gradients():
    rng = np.random.default_rng(2)
    p = {k: rng.normal(0, 0.3, s).astype(np.float64) for k, s in lm.SHAPES.items()}
    sequences = [rng.integers(0, lm.CLASSES, n) for n in (9, 4, 12, 0)]

    def loss(q):
        (m, given, targets, there), = lm.Lanes(sequences).windows()
        states, kept = lm.forward(q, np.zeros((m, lm.HIDDEN)), given)
        logs, own, slope = lm.class_logs(q, states.astype(np.float64), targets, there)
        return -(logs * there).sum() / there.sum(), lambda: own | lm.backward(q, kept, given, states, slope)

    g = loss(p)[1]()
    for k in p:
        for i in rng.integers(0, p[k].size, 8):
            e = np.zeros(p[k].size)
            e[i] = 1e-2
            e = e.reshape(p[k].shape)
            slope = (loss(p | {k: p[k] + e})[0] - loss(p | {k: p[k] - e})[0]) / 2e-2
            assert g[k].ravel()[i] == pytest.approx(slope, abs=2e-4)


def plain(p, classes):
    """The chance of one sequence, a step at a time."""
    h, total, n, sig = np.zeros(lm.HIDDEN), 0.0, lm.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    for given, target in zip([0, *classes], [*classes, 0]):
        x, a = p["x"][given].astype(float), h @ p["u"].astype(float)
        z, r = sig(x[:n] + a[:n]), sig(x[n : 2 * n] + a[n : 2 * n])
        h = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * h
        s = h @ p["v"].astype(float) + p["c"]
        total += s[target] - np.log(np.exp(s).sum())
    return total


def test_state_is_carried_over_whole_documents():
    rng = np.random.default_rng(1)
    p = lm.fresh()
    sequences = [rng.integers(0, lm.CLASSES, n) for n in (0, 1, 15, 16, 17, 400, 31)]
    assert lm.class_scores(p, sequences) == pytest.approx([plain(p, s) for s in sequences], rel=1e-4)


def test_scores(spark):
    rng = np.random.default_rng(3)
    chain = {w: rng.choice([f"w{i}{'xyz'[i % 3]}" for i in range(60)], 3) for w in [f"w{i}{'xyz'[i % 3]}" for i in range(60)]}

    def text():
        w, out = "w0x", []
        for _ in range(rng.integers(1, 80)):
            w = str(rng.choice(chain[w]))
            out.append(w if rng.random() < 0.98 else f"rare{rng.integers(0, 10**6)}")
        return " \n".join(out).title()

    rows = [(i, text(), "", "") for i in range(600)] + [(700, None, "", ""), (701, "", "", ""), (None, "W1y", "", ""), (5, "w1y  w2z", "", ""), (703, "new words only", "", ""), (704, "w0x " * 30_000, "", "")]
    got = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(4), sample_docs=200).collect()
    assert len(got) == len(rows)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t, *_ in rows]
    out = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows]
    counts = Counter(w for ws, o in zip(words, out) if not o for w in [*ws, None])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((d, o, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), total, sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*ws, None])) for (d, *_), ws, o in zip(rows, words, out)), key=str)
    for r, w in zip(sorted(map(tuple, got), key=str), want, strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5]) and r[6] < 0
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.8


def blocks_of(spark, rows):
    return lm.dictionary.split_blocks(spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "true as flag", "coalesce(text, '') as text"), lambda: lm.words_of)


def test_chances_of_known_words_sum_to_one_at_most(spark):
    text = " ".join(f"w{i}{'ab'[i % 2]}{'c.'[i % 2]} " * (1 + i % 4) for i in range(2500))
    blocks = blocks_of(spark, [(1, text, "", ""), (2, "a, a, a, once", "", "")])
    counts = lm.survey(lm.dictionary.resolve(blocks, lm.surveyor))
    own = Counter(w.decode() for w in lm.words_of(text + " a, a, a, once"))
    share, once, units = Counter(), Counter(), Counter()
    for w, n in own.items():
        u = counts.known.unit(w)
        units[u] += n
        if u < lm.CLASSES:
            once[u] += n == 1
            share[u] += n / (counts.units[u] + counts.once[u] + 1)
    assert counts.distinct == len(own) and all(v < 1 for v in share.values())
    assert counts.units.tolist() == [units[u] for u in range(len(counts.units))] and counts.once.tolist() == [once[u] for u in range(lm.CLASSES)]


def test_scores_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{j}x" for j in rng.integers(0, 50, rng.integers(1, 60))), "", "") for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, other = ({r.doc_id: r.score for r in lm.score(d, 40, 1500).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(7)))
    assert one == pytest.approx(other, rel=1e-4)


def test_nothing_to_learn_from(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = lm.score(spark.createDataFrame([(None, "a b", "", "")], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_words_are_predicted_within_their_class():
    """Two words of one class, each told by the word before it: the state has to reach the softmax within the class."""
    known = lm.Inventory([], [], ["aab", "bab", "cab", "dab"])
    a, b, c, d = map(known.unit, ["aab", "bab", "cab", "dab"])
    assert len({known(w) for w in known.named}) == 1 and known.unit("other") == known("other")
    rng = np.random.default_rng(1)
    p = lm.fresh() | {"w": rng.normal(0, 0.1, (len(known.class_of), lm.HIDDEN)).astype(np.float32), "b": np.zeros(len(known.class_of), np.float32), "a": np.zeros((lm.HIDDEN, 3 * lm.HIDDEN), np.float32)}
    p = lm.train(p, known, [np.array([a, c] if i % 2 else [b, d]) for i in range(200)], 20, 0.02, 40)
    right, wrong = lm.class_scores(p, [np.array([a, c]), np.array([a, d])], known)
    assert right > wrong + 2


def test_gradients_of_words():
    rng = np.random.default_rng(2)
    known = lm.Inventory(["a"], ["bc"], ["xbc", "ybc", "zbc", "q"])
    p = {k: rng.normal(0, 0.3, s) for k, s in lm.shapes(known).items()}
    sequences = [rng.choice([known("a"), known("bc"), *known.named.values()], n) for n in (9, 4, 12, 0)]

    def loss(q):
        (m, given, targets, there), = lm.Lanes(sequences).windows()
        states, _ = lm.forward(q, np.zeros((m, lm.HIDDEN)), given, lm.inputs(q, known))
        logs = lm.class_logs(q, states, known.class_of[targets])[0] + lm.word_logs(q, known, states, targets, there)[0]
        return -(logs * there).sum() / there.sum(), lm.slopes(q, known, np.zeros((m, lm.HIDDEN)), given, targets, there)[0]

    _, g = loss(p)
    for k in p:
        for i in [*rng.integers(0, p[k].size, 6), *np.argsort(-np.abs(g[k]).ravel())[:4]]:
            e = np.zeros(p[k].size)
            e[i] = 1e-3
            slope = (loss(p | {k: p[k] + e.reshape(p[k].shape)})[0] - loss(p | {k: p[k] - e.reshape(p[k].shape)})[0]) / 2e-3
            assert g[k].ravel()[i] == pytest.approx(slope, abs=2e-5)


def test_survey_reads_all_training_documents(spark):
    """Heads and named words are those of the counts of all documents, whichever a sample holds."""
    rows = [(i, f"common{i % 90}aa " * 3 + f"rare{i}zz", "", "") for i in range(400)]
    known = lm.survey(lm.dictionary.resolve(blocks_of(spark, rows), lm.surveyor)).known
    counts = Counter(w for _, t, *_ in rows for w in t.split())
    top = sorted(counts, key=lambda w: (-counts[w], w))
    assert list(known.heads) == top[: lm.HEADS] and list(known.named) == top[lm.HEADS : lm.HEADS + lm.WORDS]
    assert set(known.suffixes) == {"aa", "zz"}


def test_units_of_many_words_are_those_of_each():
    rng = np.random.default_rng(6)
    letters = list("abcé.,)\u2019ßж日") + ["\U0001f600"]
    words = ["".join(rng.choice(letters, rng.integers(0, 6))) for _ in range(3000)] + ["", ".", "a", "ab", "ab."]
    known = lm.Inventory(["ab", "é."], ["ab", "жa", "日"], ["abc", "a.", "\U0001f600"])
    assert known.units(pa.array(words, pa.string())).tolist() == [known.unit(w) for w in words]
    assert known.units(pa.array([], pa.string())).tolist() == []
    assert lm.Inventory([], []).units(pa.array(["x", ""])).tolist() == [lm.Inventory([], []).unit(w) for w in ("x", "")]


def test_gates_lie_together_and_agree_with_the_formula():
    rng = np.random.default_rng(3)
    p = {"x": rng.normal(0, 1, (9, 3 * lm.HIDDEN)), "u": rng.normal(0, 1, (lm.HIDDEN, 3 * lm.HIDDEN))}
    h, given, n = rng.normal(0, 0.5, (5, lm.HIDDEN)), rng.integers(0, 9, (7, 5)), lm.HIDDEN
    states, kept = lm.forward(p, h, given)
    assert all(x.flags["C_CONTIGUOUS"] for step in kept for x in step)
    for t, own in enumerate(given):
        x, a = p["x"][own], h @ p["u"]
        z, r = (1 / (1 + np.exp(-x[:, i : i + n] - a[:, i : i + n])) for i in (0, n))
        h = z * h + (1 - z) * np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        assert np.allclose(states[t], h, atol=1e-12)
