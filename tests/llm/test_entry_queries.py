"""Every registered corpus query over its whole small table: the contract's columns and rows, SQL where there is some, and the pipeline."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sojourn.llm import entry

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_media": ("documents", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"),
    "op2_bpe": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op3_mix": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op4_urls": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op5_exact_dedup": ("documents", "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"),
    "op6_minhash": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean"),
    "op7_repeats": ("documents", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, passage_words bigint, n_passages bigint"),
    "op8_lm": ("documents", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"),
    "op9_chat": ("conversations", "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op11_align": ("documents", "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"),
    "op12_pack": ("documents", "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op13_runs": ("documents", "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"),
    "op10_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    table, schema = COLUMNS[name]
    rows = __spark_entry__.queries()[name](spark, FOLDER)
    kinds = dict(rows.dtypes)
    assert {c.split()[0]: kinds.get(c.split()[0]) for c in schema.split(", ")} == {c.split()[0]: c.split()[1] for c in schema.split(", ")}
    source = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    got = rows.collect()
    if name == "op9_chat":
        fixed = next(r for r in got if r.conv_id == -1)
        text = entry.FIXED
        assert len(got) == source.select("conv_id").distinct().count() + 1
        assert fixed.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and fixed.loss_chars == len(text) and fixed.n_turns == 2
        assert fixed.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    elif name == "op12_pack":
        assert {r[0] for r in got} == {r[0] for r in source.select("doc_id").collect()}
    else:
        assert sorted(r[0] for r in got) == sorted(r[0] for r in source.select(schema.split()[0]).collect())
    if name in entry.SQL:
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        columns = sorted(kinds)
        want = con.sql(f"select {', '.join(columns)} from ({entry.SQL[name]})").fetchall()
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)
    if name == "op7_repeats":
        texts = {r.doc_id: (r.text or "").encode() for r in source.select("doc_id", "text").collect()}
        assert all(r.n_bytes == len(texts[r.doc_id]) and (r.n_removed or r.kept_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()) for r in got)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0 and 0 < out.select("doc_id").distinct().count() < docs.count()
