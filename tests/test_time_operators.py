from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewell.operators.asof import dyadic_cover, enclosing_nodes, valid_at
from tidewell.operators.membership import bits_for, may_contain
from tidewell.operators.rolling import daily_totals, trailing_totals
from tidewell.operators.temporal import asof_backward, first_crossing, first_match, interval_join, last_values, lookback, near_join


def test_dyadic_cover_holds_exactly_the_granules(spark):
    spans = [(a, b) for a in range(0, 9) for b in range(a + 1, a + 8)]
    df = spark.createDataFrame(spans, "a bigint, b bigint").withColumn("n", dyadic_cover(F.col("a"), F.col("b"), 0, 3))
    for r in df.collect():
        covered = [i for node in r.n for i in range((node // 64) << (node % 64), (node // 64 + 1) << (node % 64))]
        assert sorted(covered) == list(range(r.a, r.b))
    nodes = spark.range(1).select(enclosing_nodes(F.lit(5), 0, 2).alias("n")).first().n
    assert nodes == [5 * 64, 2 * 64 + 1, 1 * 64 + 2]


def test_valid_at_against_brute_force(spark):
    random.seed(2)
    attributes = [(random.choice(["x", "y", None]), k, s := random.randrange(0, 500), s + random.randrange(-5, 60)) for k in range(200)]
    events = list({(random.choice(["x", "y", None]), random.randrange(-10, 560)) for _ in range(80)})
    a = spark.createDataFrame(attributes, "who string, id bigint, f bigint, t bigint").withColumn("at", F.lit("clash"))
    e = spark.createDataFrame(events, "who string, at bigint")
    got = valid_at(e, a, "who", "at", F.col("f"), F.col("t"), 64, grain=3, salts=3, salt_by="id", prefilter_bits=10)
    want = sorted((w, at, k) for w, at in events if w for v, k, f, t in attributes if v == w and f <= at < t)
    assert sorted((r.who, r.at, r.id) for r in got.collect()) == want
    assert valid_at(e.limit(0), a, "who", "at", F.col("f"), F.col("t"), 64).count() == 0


def test_bits_follow_the_keys_up_to_a_bound():
    assert [bits_for(n) for n in (0, 1, 1000, 1 << 20, (1 << 23) + 1)] == [10, 10, 15, 25, None]


def test_membership_never_drops_a_member(spark):
    df, keys = spark.range(3000), spark.range(0, 3000, 7)
    for bits in (8, 20):
        kept = {r.id for r in may_contain(df, [F.col("id")], keys, bits).collect()}
        assert {*range(0, 3000, 7)} <= kept
    assert len(kept) < 1000
    assert may_contain(df, [F.col("id")], keys.limit(0)).count() == 0


def test_trailing_totals_against_brute_force(spark):
    random.seed(3)
    base = dt.date(2101, 12, 20)
    rows = [(random.choice(["x", None]), base + dt.timedelta(days=random.randrange(0, 70)), random.choice([None, 1.0, 5.0, 20.0])) for _ in range(60)]
    totals = daily_totals(spark.createDataFrame(rows, "who string, d date, v double"), ["who"], "d", "v")
    got = {(r.who, r.day): (r.total_7, r.total_30) for r in trailing_totals(totals, ["who"], [7, 30]).collect()}
    for who in ("x", None):
        mine = [(d, v) for w, d, v in rows if w == who and v is not None]
        for k in range(-3, 120):
            day = base + dt.timedelta(days=k)
            want = tuple(sum(v for d, v in mine if day - dt.timedelta(days=n) < d <= day) for n in (7, 30))
            if any(day - dt.timedelta(days=30) < d <= day for d, _ in mine):
                assert got[who, day] == want
            else:
                assert got.get((who, day), (0, 0)) == (0, 0)


def test_lookback_is_strict_at_the_index(spark):
    index = spark.createDataFrame([("x", 100)], "k string, t0 bigint")
    events = spark.createDataFrame([("x", t) for t in (51, 52, 99, 100, 101)] + [(None, 60), ("x", None)], "k string, at bigint")
    assert sorted(r["at"] for r in lookback(index, events, ["k"], "t0", "at", 48).collect()) == [52, 99]
    assert sorted(r["at"] for r in near_join(index, events, ["k"], "t0", "at", 1, 1).collect()) == [99, 100, 101]


def test_interval_join_bounds_open_ends_and_left(spark):
    stays = spark.createDataFrame([("x", 1, 10, 20), ("x", 2, 15, None), ("x", 3, None, 9)], "k string, id int, s bigint, e bigint")
    events = spark.createDataFrame([("x", t) for t in (9, 10, 20, 21, 400)] + [("y", 12)], "k string, at bigint")
    got = interval_join(events, stays, ["k"], "at", "s", "e", bucket_us=7)
    assert sorted((r["at"], r.id) for r in got.collect()) == [(10, 1), (20, 1), (20, 2), (21, 2), (400, 2)]
    assert interval_join(events, stays, ["k"], "at", "s", "e", bucket_us=7, how="left").where("id is null").count() == 2
    blank = events.withColumn("note", F.lit(None).cast("string"))
    assert interval_join(blank, stays, ["k"], "at", "s", "e", bucket_us=7, how="left").count() == 7


def test_first_match_and_crossing(spark):
    points = spark.createDataFrame([(1, "x", 16), (2, "x", None), (3, "y", 16)], "p int, k string, at bigint")
    stays = spark.createDataFrame([("x", 8, 15, 20), ("x", 7, 10, 20), ("x", 6, 10, 20)], "k string, id int, s bigint, e bigint")
    got = {r.p: r.id for r in first_match(points, stays, ["k"], "p", "at", "s", "e", ["s", "id"]).collect()}
    assert got == {1: 6, 2: None, 3: None}
    rows = spark.createDataFrame([("x", 1, 600.0, 1), ("x", 2, None, 2), ("x", 3, 400.0, 3), ("x", 4, 1.0, 4), ("y", 1, 5.0, 5)], "k string, at bigint, v double, id int")
    assert [tuple(r) for r in first_crossing(rows, ["k"], "at", "v", 1000.0, "id").collect()] == [("x", 3)]


def test_asof_tolerance_ties_and_nulls(spark):
    left = spark.createDataFrame([("x", 10), ("x", 10), ("x", 4), ("x", 30), ("y", 10)], "k string, at bigint")
    right = spark.createDataFrame([("x", 5, 1.0), ("x", 10, 2.0), ("x", 10, 3.0), ("x", 11, 9.0), ("x", 29, None)], "k string, t bigint, v double")
    got = sorted(((r.k, r["at"], r.v, r.t) for r in asof_backward(left, right, ["k"], "at", "t", "v", 10).collect()), key=repr)
    assert got == sorted([("x", 10, 3.0, 10), ("x", 10, 3.0, 10), ("x", 4, None, None), ("x", 30, None, None), ("y", 10, None, None)], key=repr)


def test_last_values_skip_nulls(spark):
    rows = spark.createDataFrame([("x", "a", 1, 5.0, 1), ("x", "a", 2, None, 2), ("x", "b", 1, 7.0, 3), ("x", "b", 1, 8.0, 4)], "k string, n string, at int, v double, id int")
    assert [tuple(r) for r in last_values(rows, ["k"], "n", ["a", "b", "c"], "at", "v", "id").collect()] == [("x", 5.0, 8.0, None)]


def test_days_far_apart_make_no_calendar_between_them(spark):
    rows = spark.createDataFrame([("x", dt.date(1900, 1, 1), 5.0), ("x", dt.date(2026, 1, 1), 7.0), ("x", dt.date(2026, 1, 3), 1.0)], "k string, d date, v double")
    got = trailing_totals(daily_totals(rows, ["k"], "d", "v"), ["k"], [7, 30])
    days = {r.day: (r.total_7, r.total_30) for r in got.collect()}
    assert len(days) == 62 and days[dt.date(2026, 1, 3)] == (8.0, 8.0) and days[dt.date(1900, 1, 30)] == (0.0, 5.0) and days[dt.date(2026, 2, 1)] == (0.0, 1.0)
    assert "sequence(min(day" not in got._jdf.queryExecution().toString()
