"""Durations against patterns in Python, and that each pattern looks once."""

import re

from pyspark.sql import functions as F

from sojourn.functions import text

SAID = [None, "", "-", "3 hours", "1 hour 5 mins", "12 minutes", "7 min", "2hours30mins", "2 hours and 30 minutes", "about 99999999999 hours 5 mins", "hours min", "1 hours 2 hours 3 mins", "4 HOURS", "5 mins 6 hours"]


def plain(s):
    found = [re.search(p, s or "") for p in (r"(\d+)\s*hours?", r"(\d+)\s*min(?:ute)?s?")]
    h, m = (int(f[1]) if f and int(f[1]) < 2**31 else None for f in found)
    both = re.search(r"(\d+)\s*hours?\s*(\d+)\s*mins?", s or "")
    strict = int(both[1]) * 60 + int(both[2]) if both and int(both[1]) < 2**31 else None
    return (None if h is None and m is None else (h or 0) * 60 + (m or 0), strict)


def test_durations(spark):
    df = spark.createDataFrame([(s,) for s in SAID], "s string").select("s", text.duration_minutes(F.col("s")).alias("a"), text.duration_minutes_strict(F.col("s")).alias("b"))
    assert {r.s: (r.a, r.b) for r in df.collect()} == {s: plain(s) for s in SAID}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 4
