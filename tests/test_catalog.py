"""Every catalogue query that has SQL gives its rows; the others run and give rows of a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sojourn.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.select(*sorted(df.columns)).collect()
    assert name not in SQL or df.columns
    if name in SQL:
        rel = duck.sql(f"select * from ({SQL[name]})")
        assert sorted(rel.columns) == sorted(df.columns)
        want = rel.project(", ".join(f'"{c}"' for c in sorted(df.columns))).fetchall()
        assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
