import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sojourn.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def documents():
    rnd = random.Random(8)
    word = lambda: rnd.choice("stone river cloud amber field lantern winter quiet copper meadow".split()) + str(rnd.randint(0, 40))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rnd.randint(5, 120))]
        if i % 10 == 3:
            words[rnd.randrange(len(words))] = rnd.choice(["scum", "moron"])
        rows.append((i, " ".join(words) + ".", "en", f"s{i % 3}"))
    for i in range(400, 430):
        rows.append((i, rows[i - 400][1].replace(" ", "\n") + " ", "en", "s0"))
    for i in range(430, 460):
        words = rows[i - 420][1].split()
        words[-1] = "changed."
        rows.append((i, " ".join(words), "en", "s1"))
    odd = [(500, None, None, None), (501, "", "en", "s9"), (None, "alone and without an id", "en", "s9"), (None, rows[1][1], "en", "s9"), (7, rows[7][1], "en", "s1"), (7, rows[7][1], "en", "s1"), (8, "another text under an id that is there", "en", "s2")]
    return [(*r, 0, "x") for r in rows + odd]


def test_stages_against_plain_versions(spark, tmp_path):
    rows = documents()
    labels = [(r[0], 1, int(any(w in (r[1] or "") for w in ("scum", "moron")))) for r in rows if r[0] is not None and r[0] < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    outs, names = [], ["doc_id", "text", "lang", "source", "n_chars"]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == names
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        outs.append(docs.collect())
    key = lambda r: str((r[0], r[1], r[3]))
    clean, exact, near, mixed, encoded = outs
    model = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    words = toxicity.Words()
    bad = {r[1] for r in rows if toxicity.softplus(toxicity.chances(r[1] or "", model, words)).sum() >= 0.6931471805599453}
    assert Counter(map(key, clean)) == Counter(key(r) for r in rows if r[1] not in bad) and len(bad) >= 36
    best = {}
    for r in clean:
        norm = "".join((r[1] or "").split())
        rank = (-len(r[1] or ""), r[0] if r[0] is not None else 10**9)
        best[norm] = min(best.get(norm, (rank, r)), (rank, r), key=lambda x: x[0])
    assert sorted(map(key, exact)) == sorted(key(r) for _, r in best.values())
    gone = {key(r) for r in exact} - {key(r) for r in near}
    assert 15 <= len(gone) and not {key(r) for r in near} - {key(r) for r in exact}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    full = [(r, shingles(r[1])) for r in near if r[1]]
    for r in exact:
        if key(r) in gone:
            s = shingles(r[1])
            assert any(len(s & x) >= 0.8 * len(s | x) for _, x in full)
    for i, (_, a) in enumerate(full):
        assert not any(len(a & b) >= 0.8 * len(a | b) for _, b in full[:i])
    assert {key(r) for r in mixed} <= {key(r) for r in near} and max(Counter(map(key, mixed)).values()) <= 4
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(str((r.doc_id, r.ids)) for r in encoded) == sorted(str((r[0], t.encode(r[1] or "").ids)) for r in mixed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
