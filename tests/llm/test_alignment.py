"""Groups and links against offsets of whole texts in both libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__
from sojourn.llm import alignment
from sojourn.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair string, count string, n_a int"


@pytest.fixture(scope="module")
def plain():
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a.encode_special_tokens = True

    def groups(text):
        """(a ids, b ids, groups, links) by the byte offsets at which tokens of both sides end."""
        whole = (" " + (text or "")).encode()
        if not text:
            return [], [], [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(left) != whole or b"".join(right) != whole:
            return [], [], [], []
        ends = []
        for side in (left, right):
            at, own = 0, {}
            for k, t in enumerate(side):
                at += len(t)
                own[at] = k
            ends.append(own)
        cut = sorted(ends[0].keys() & ends[1].keys())
        out, p, q = [], 0, 0
        for e in cut:
            i, j = ends[0][e] + 1, ends[1][e] + 1
            out.append((x[p:i], y[q:j]))
            p, q = i, j
        return x, y, out, [(g[-1], h[-1]) for g, h in out]

    return groups


def expected(plain, texts):
    found = [plain(t) for t in texts]
    counts = Counter(link for f in found for link in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for x, y, groups, links in found:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append((len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else "", text))
    return rows, {(a, b, n, n == most[b]) for (a, b), n in counts.items()}


def odd_texts():
    rnd = random.Random(2)
    parts = ["\n", "  ", "a b", "\t", "\r\n", "\x0b\x85 ", "　z", "é€\U0001f600", "<|endoftext|>", "<s> </s>", "<unk>", "<0x41>", "▁", "\x1c", "\x1f!", "​", "don't", "I'LL", "1234", "日本語", "!!", "...", "{\r", "\x00", "ß", " ", "﻿", "the", "ing", " of", "᠎"]
    return [None, "", " ", "  ", "\n", "x" * 3000, "word " * 30_000, "a  b " * 50, "don't do " * 9] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(400)]


@pytest.mark.parametrize("most", [8 << 20, 200])
def test_as_offsets_say(spark, plain, monkeypatch, most):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", most)
    texts = odd_texts()
    want, pairs = expected(plain, texts)
    table = spark.createDataFrame([(i, t, "p", "c", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows, table = alignment.align(table, A, B, keep_groups=True)
    got = sorted(rows.collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:] for r in got] == want
    assert {tuple(r) for r in table.select("a", "b", "count", "best").collect()} == pairs
    assert sum(w[0] > 0 for w in want) > 100 and sum(w[0] == 0 for w in want) > 10


def test_odd_rows(spark):
    rows = [(None, "a b", None, None, None), (None, None, None, None, None), (3, "a b", "", "", 1), (3, "a b", "", "", 1), (-(2**63), "a▁b", "", "", 1)]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA), A, B)[0].collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum, r.groups) for r in got) == [(-(2**63), 0, 0, None), (0, 0, 0, None), (0, 2, 6, None), (3, 2, 6, None), (3, 2, 6, None)]
    assert [r.groups_sha256 for r in got if r.n_a == 0] == ["", ""]
    empty, pairs = alignment.align(spark.createDataFrame([], SCHEMA), A, B)
    assert empty.collect() == [] and pairs.collect() == []


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abcab", b"c"])
    assert t.cuts([0, 1], [0, 1]) == [(2, 2)] and t.cuts([2, 0, 1], [2, 3]) == [(2, 1), (3, 2)]
    assert t.cuts([2], [0, 1]) == [(1, 2)] and t.cuts([], []) == []
    assert t.cuts([0], [0]) is None and t.cuts([3], [0]) is None and t.cuts([2], []) is None and t.cuts([], [0]) is None
    known = t.size
    assert t.cuts([0, 1], [0, 1]) == [(2, 2)] and t.size == known
    small = alignment.Transducer([b"ab", b"c"], [b"a", b"bc"], most=1)
    assert all(small.cuts([0, 1], [0, 1]) == [(2, 2)] for _ in range(5))


def test_bound_on_pairs():
    _, _, left, right, _ = alignment._sides(A, B)
    assert 100_000 < alignment.pair_bound(A, B) <= sum(map(len, left)) + sum(map(len, right))


def test_query(spark, plain):
    folder = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want, _ = expected(plain, docs.values())
    got = {r.doc_id: r for r in __spark_entry__.queries()["op11_align"](spark, folder).collect()}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {d: tuple(got[d][n] for n in names) for d in got} == {d: w[:7] for d, w in zip(docs, want)}


def test_words_split_as_the_pattern():
    words = alignment.Words(A, B)
    signs = [chr(c) for c in range(0x3100) if not alignment.RARE.search(chr(c)) and not chr(c).isspace()]
    several = [f"{s}{head}{c}{tail}" for s in (" ", "", "\n") for head in ("a", "é1", "'") for c in signs for tail in ("", ",", ".\"'", "'s", "n't", "1!")]
    assert all([p for _, own in words.cut(w) for p in own] == ([w] if "▁" in w and len(alignment.SPLIT(w)) == 1 else alignment.SPLIT(w)) for w in several)


def test_words_are_aligned_once_over_blocks(monkeypatch):
    words, seen = alignment.Words(A, B), []
    cut = alignment.Words.cut
    monkeypatch.setattr(alignment.Words, "cut", lambda self, word: seen.append(word) or cut(self, word))
    for number in range(3):
        block = alignment.Block(number, words, True)
        block.add(1, "once, again; once, more", 23)
        block.row()
        words.forget()
    assert sorted(seen) == [" again;", " more", " once,"]
    monkeypatch.setattr(alignment, "KNOWN", 2)
    words.forget()
    assert not words.known and not words.parts
