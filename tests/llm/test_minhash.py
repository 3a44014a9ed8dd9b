import random
import re

import pytest

from sojourn.llm import components, minhash

SCHEMA = "doc_id long, text string, n long, sig string, node string"


def brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(rnd, groups, size, edits):
    rows = []
    for _ in range(groups):
        base = [f"W{rnd.randint(0, 400)}" for _ in range(rnd.randint(2, 120))]
        for _ in range(rnd.randint(1, size)):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9999)}"
            rows.append(rnd.choice([" ", "\n", "\t "]).join(w))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_components_as_brute_force(spark, k):
    rnd = random.Random(k)
    texts = corpus(rnd, 25, 12, 4) + [None, "", " \n", "a", "A", "a b", "A  b", "b a", "é É", "é É", "long " * 40_000, "the " * 3 + "word " * 900]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    rows += [(3, texts[3]), (3, texts[3]), (4, "other text for an id that is there"), (None, texts[5]), (None, "no id and alone here"), (None, "no id and alone, twice")]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA), k).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, k)


def test_one_group_with_many_near_copies(spark):
    """Every copy has own edits, so many pairs of copies are no links, and the first class of a bucket doesn't reach all."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(100)] = f"x{rnd.random()}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA), 4).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 4)


def test_empty_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert minhash.near_duplicates(spark.createDataFrame([(1, "", 1, "", "")], SCHEMA)).drop("text_key").collect() == [(1, 0, 1, True)]


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(rnd.randint(2000, 2300), rnd.randint(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 3), (7, 6), (-4, 900)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("doc", [7, None])
def test_one_id_for_many_texts(spark, doc):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    bases = [[rnd.choice(words) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(40):
        w = list(bases[i % 4])
        w[rnd.randrange(60)] = f"x{i}"
        rows.append((doc, " ".join(w)))
    table = spark.createDataFrame([(d, t, 1, "", "") for d, t in rows], SCHEMA).repartition(4)
    got = minhash.near_duplicates(table, 4)
    want = brute(rows, 4)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == sorted((str(w[0]), w[1], str(w[2])) for w in want)
    classes = minhash.classes_of(minhash.sketch(table, 4))
    sets = minhash.full_sets(table, classes, classes.select("node"), 4)
    assert sets.count() == len({t for _, t in rows})
