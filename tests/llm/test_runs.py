"""Runs against a plain search by period, on random sequences and on the registered query's whole small table."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

import __spark_entry__
from sojourn.llm import runs

SCHEMA = "doc_id long, text string, runs string, n_words string, collapsed int"


def plain_runs(s, exponent=4, least=6):
    """start, length, period: stretches where words q apart are equal, kept if no shorter period fits them."""
    found = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            part = s[i : i + n]
            if j > i and n >= max(least, exponent * q) and not any(part[r:] == part[: n - r] for r in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 5)])
def test_random_sequences(exponent, least):
    rnd = random.Random(exponent)
    for _ in range(400):
        many = []
        for _ in range(rnd.randint(1, 5)):
            k = rnd.choice([1, 2, 3, 5])
            many.append([rnd.randrange(k) for _ in range(rnd.randint(0, 12))] * rnd.randint(1, 6) + [rnd.randrange(k) for _ in range(rnd.randint(0, 8))])
        starts = np.r_[0, np.cumsum(list(map(len, many)))]
        got = runs.maximal_runs(np.array([x for s in many for x in s], np.int64), starts, exponent, least)
        assert list(zip(*(x.tolist() for x in got))) == [(a + int(b), n, q) for s, b in zip(many, starts) for a, n, q in plain_runs(s, exponent, least)]


def test_few_leaves_at_once():
    codes = np.array([0, 1] * 30 + [2] * 9 + [0, 1, 2] * 8, np.int64)
    tree = runs.SuffixTree(codes, np.array([0, len(codes)]))
    whole, parts = ({*zip(*(x.tolist() for x in runs.branching_repeats(tree, most)))} for most in (1 << 20, 5))
    assert whole == parts and (4, 28) in whole


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 500)
    rnd = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "A a A a A a A a", "x y " * 7, "é\n" * 8 + "b", "\x1c \x1c  \x1c\x0b\x1c\x1c \x1c \x1c \x1c", "ab " * 9 + "c d " * 5]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["u v w " * 40_000 + "x", " ".join(map(str, range(30_000)))]
    rows = [(i, t, "r", "n", 1) for i, t in enumerate(texts)] + [(5, texts[5], "r", "n", 1), (None, "z " * 6, "r", "n", 1), (-(2**63), None, None, None, None)]
    got = runs.find_runs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        found = [(0, 120_000, 3)] if len(words) > 100_000 else [] if len(words) == 30_000 else plain_runs(words)
        want.append((i is None, i or 0, len(words), tuple(found), collapse(words, found)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == sorted(want)


def test_empty_table(spark):
    found = runs.find_runs(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and runs.digests(found).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in __spark_entry__.queries()["op13_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        words, h = [w.decode() for w in (text or "").encode().split()], crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = plain_runs(words) if n < 3000 or h % 10 == 0 else None
        r = got[doc]
        if found is None:
            continue
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, found).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None)) and r.exponent_milli == (best and 1000 * best[1] // best[2])
