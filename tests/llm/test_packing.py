"""Pieces against the library on whole texts, packings against the contract's rules, and the search against best fit alone and all packings."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from sojourn.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, length string, sequence_id string, shard string"


def check(docs, rows, most=4096, closing=1):
    """docs: doc_id to text, each once. Every piece as the library's ids cut, sequences gapless and within `most`."""
    library = Tokenizer.from_file(PATH)
    own, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert r.piece not in own[r.doc_id]
        own[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(own) == set(docs)
    for doc, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, closing]
        cut = [ids[i : i + most] for i in range(0, len(ids), most)]
        assert sorted(own[doc]) == list(range(len(cut)))
        for k, part in enumerate(cut):
            r = own[doc][k]
            assert (r.start, r.length, r.ids_crc32) == (k * most, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


def odd_texts():
    rnd = random.Random(3)
    parts = ["\n", "  ", "a b", "\t", "\r\n", "\x0b\x85 ", "　z", "é€\U0001f600", "<|endoftext|>", "<|startoftext|> x", "\x1c", "\x1f!", "don't", "I'LL", "1234", "日本語", "!!", "\x00", "ß", "Σ ΑΣ ΟΔΟΣ", "İ", "́ ", "Å", "ﬁ", "‍", "the", " of", "Ça", "ÉTÉ", "naïve", "Straße", "ÿÿ×÷µ", "'S", "we'LL'd", "<|", "|>", "a1b2!"]
    return [None, "", " ", "word " * 20_000, "x" * 9_000, "Ab, c! " * 6000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(300)]


@pytest.mark.parametrize(("most", "shard"), [(4096, 100_000), (64, 40)])
def test_as_the_library_cuts(spark, most, shard):
    docs = dict(enumerate(odd_texts()))
    table = spark.createDataFrame([(i, t, "r", "l", "s", "h") for i, t in docs.items()], SCHEMA).repartition(3)
    rows = packing.pack(table, PATH, most=most, closing=7, shard=shard)
    got = rows.collect()
    sequences = check(docs, got, most, 7)
    assert -(-sum(r.length for r in got) // most) <= sequences
    whole = packing.sequences(rows).collect()
    assert len(whole) == sequences
    by = {(r.sequence_id, r.offset): r.ids for r in got}
    for r in whole:
        assert r.ids == [x for a in [0, *r.ends[:-1]] for x in by[r.sequence_id, a]] and r.ends[-1] == len(r.ids)


def test_odd_rows(spark):
    rows = [(None, "a b", None, None, None, None), (None, None, None, None, None, None), (3, "same", "", "", "", ""), (3, "same", "", "", "", ""), (-(2**63), "x", "", "", "", "")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, keep_ids=False).collect()
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 2), (False, 2), (False, 2), (True, 1), (True, 3)]
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got)[0] == 0
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def fewest(lengths, most):
    best = len(lengths)
    for places in product(range(len(lengths)), repeat=len(lengths)):
        fill = [0] * len(lengths)
        for p, n in zip(places, lengths):
            fill[p] += n
        if max(fill) <= most:
            best = min(best, sum(map(bool, fill)))
    return best


def test_bound_holds():
    rnd = random.Random(5)
    for _ in range(150):
        lengths = np.array([rnd.randint(1, 12) for _ in range(rnd.randint(1, 5))])
        least, out = fewest(lengths.tolist(), 12), packing.packed(lengths, 12, 100)
        used = sum(map(bool, out.bins))
        assert packing.lower_bound(lengths, 12) <= least <= used
    assert packing.lower_bound(np.array([], np.int64), 12) == 0


def test_every_exchange_raises_the_sum():
    g = np.random.default_rng(1)
    for low, high in ((800, 2200), (1000, 2100), (600, 1500), (1, 4096)):
        p = packing.Packing(g.integers(low, high, 600), 4096)
        p.best_fit()
        started = len(p.bins)
        p.search(0)
        squares = [(p.fill**2).sum()]
        for _ in range(60):
            p.search(1)
            squares.append((p.fill**2).sum())
            assert p.fill.max() <= 4096 and sorted(i for b in p.bins for i in b) == list(range(600))
            assert all(sum(p.lengths[i] for i in b) == f for b, f in zip(p.bins, p.fill))
        assert squares == sorted(squares) and np.count_nonzero(p.fill) <= started


def test_search_empties_sequences():
    """Where best fit by decreasing length leaves gaps that only exchanges can use."""
    g = np.random.default_rng(2)
    for low, high in ((800, 2200), (1000, 2100), (600, 1500)):
        lengths = g.integers(low, high, 2000)
        start = packing.Packing(lengths, 4096)
        start.best_fit()
        used = sum(map(bool, packing.packed(lengths, 4096, 2000).bins))
        assert packing.lower_bound(lengths, 4096) <= used < len(start.bins)


def test_shards_meet_again(spark):
    rows = spark.range(3000).selectExpr("id as row", "1 + id % 5 as length")
    got = packing.place(rows, most=100, shard=100).collect()
    assert sorted(r.row for r in got) == list(range(3000))
    assert len({r.sequence_id for r in got}) <= 9000 // 100 + 1


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["op12_pack"](spark, folder).collect()
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert check(docs, rows) <= -(-sum(r.length for r in rows) // 4096) + 1
