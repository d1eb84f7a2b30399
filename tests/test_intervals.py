from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewell.operators.intervals import contained_in, merge_intervals, period_gaps

US = 1_000_000


def _merged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "who string, a bigint, b bigint").select("who", F.timestamp_micros("a").alias("a"), F.timestamp_micros("b").alias("b"))
    return sorted((r.who, r.start_us, r.end_us, r.members) for r in merge_intervals(df, "who", "a", "b", **kw).collect())


def _brute(rows):
    out = []
    for who in sorted({r[0] for r in rows if r[0] is not None}):
        spans = sorted((a, b) for w, a, b in rows if w == who and a is not None and b is not None and b > a)
        for a, b in spans:
            if out and out[-1][0] == who and a <= out[-1][2]:
                out[-1][2], out[-1][3] = max(out[-1][2], b), out[-1][3] + 1
            else:
                out.append([who, a, b, 1])
    return sorted(tuple(x) for x in out)


def test_overlap_nest_touch_and_gap(spark):
    s = US
    rows = [("x", 0, 10 * s), ("x", 5 * s, 8 * s), ("x", 10 * s, 12 * s), ("x", 13 * s, 14 * s), ("y", 0, 1)]
    assert _merged(spark, rows) == [("x", 0, 12 * s, 3), ("x", 13 * s, 14 * s, 1), ("y", 0, 1, 1)]


def test_touch_by_a_microsecond(spark):
    assert _merged(spark, [("x", 0, 10), ("x", 10, 20), ("x", 21, 22)]) == [("x", 0, 20, 2), ("x", 21, 22, 1)]


def test_bad_rows_are_left_out(spark):
    rows = [(None, 0, 5), ("x", None, 5), ("x", 5, None), ("x", 5, 5), ("x", 9, 3), ("x", 1, 2)]
    assert _merged(spark, rows) == [("x", 1, 2, 1)]


def test_empty(spark):
    assert _merged(spark, []) == []


def test_against_brute_force_across_buckets(spark):
    random.seed(4)
    day = 86400 * US
    rows = [(random.choice("abc"), s := random.randrange(0, 900) * day, s + random.randrange(0, 40) * day) for _ in range(300)]
    assert _merged(spark, rows, bucket_days=30) == _brute(rows)


def test_one_entity_with_most_rows(spark):
    rows = [("hot", k * 10, k * 10 + 11) for k in range(3000)] + [("cold", 0, 1)]
    assert _merged(spark, rows) == [("cold", 0, 1, 1), ("hot", 0, 30001, 3000)]


def test_gaps_and_containment(spark):
    periods = spark.createDataFrame([("x", 0, 10), ("x", 20, 30), ("x", 50, 60), ("y", 0, 5)], "who string, start_us bigint, end_us bigint")
    gaps = period_gaps(periods, "who")
    assert sorted(map(tuple, gaps.collect())) == [("x", 10, 20), ("x", 30, 50)]
    outer = spark.createDataFrame([("x", 10, 25), ("x", 26, 50), ("y", 0, 99)], "who string, start_us bigint, end_us bigint")
    assert sorted(map(tuple, contained_in(gaps, outer, "who").collect())) == [("x", 10, 20), ("x", 30, 50)]
    narrow = spark.createDataFrame([("x", 11, 25), ("x", 26, 49)], "who string, start_us bigint, end_us bigint")
    assert contained_in(gaps, narrow, "who").collect() == []
