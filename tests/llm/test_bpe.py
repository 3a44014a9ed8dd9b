import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from sojourn.llm import bpe, dictionary

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, block string"


def texts():
    rnd = random.Random(6)
    odd = ["", None, " ", "\n\n", "a  b", "it's  I'LL we'd ''s", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|endoftext", "tab\tnl\r\n\x0b\x85 　z", "é€\U0001f600՘Ᲊb2", "a​b c ", "1²3٣", "word " * 30_000, "x" * 3000, "\x00\x01"]
    return odd + ["".join(rnd.choice(["the", " ", "\n", "é", "'", "s", "9", "!", "一", "ß ", "ༀ"]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]


@pytest.mark.parametrize("most", [1 << 23, 300])
def test_as_the_library_does(spark, most, monkeypatch):
    monkeypatch.setattr(dictionary, "BLOCK_BYTES", most)
    monkeypatch.setattr(dictionary.split_blocks, "__defaults__", (most,))
    rows = [(i, t, "", "") for i, t in enumerate(texts())] + [(3, "\n\n", "", ""), (None, "null id", "", "")]
    got = bpe.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    assert len(got) == len(rows)
    t, by = bpe.tokenizer(PATH), {r.doc_id: r for r in got}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert by[i].ids == ids and by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_by_join(spark):
    t = bpe.tokenizer(PATH)
    rows = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts()) if x is None or len(x) < 5000] + [(900, None), (901, [])]
    got = {r.row_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "row_id long, ids array<int>"), PATH).collect()}
    assert got == {i: t.decode(ids or [], skip_special_tokens=False) for i, ids in rows}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_pack():
    for v in ([], [0], [1, 2**31, 7] * 1000):
        assert dictionary.unpack(dictionary.pack(np.array(v, np.int64))).tolist() == v
