import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sojourn.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, n_chars long"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, t), n in zip(rows, norm):
        groups[n].append((-len(t or ""), i))
    return sorted((i, min(groups[n])[1], len(groups[n]), i == min(groups[n])[1], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm))


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, lambda c: F.char_length(c).cast("long")])
def test_groups(spark, chunk_hash):
    long = "".join(f"wörd{i} anst " for i in range(4000))
    texts = ["a b", "ab", "a\tb ", None, "", " \n", "x", long, long.replace(" ", "\n"), long + "é", long[:-3], long.replace("wörd3 ", "wörd4 ", 1), long.replace("wörd4 ", "wörd3 ", 1), "\u00a0ab", "ba"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "copy of one") for i in range(300)]
    got = exact_dedup.dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), chunk_hash).drop("n_chunks").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_null_ids_and_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    got = exact_dedup.dedup(spark.createDataFrame([(None, "a", "", 1), (3, "a", "", 1), (3, "a", "", 1), (None, "b", "", 1)], SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.dedup(spark.createDataFrame([(1, "a", "", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
