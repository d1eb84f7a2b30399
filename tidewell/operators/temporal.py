"""Joins and windows over time: containment, look-back, proximity, as-of, first match, first crossing.

Instants are microseconds. Range predicates are turned into equi-joins on coarse time buckets,
so that a join spreads over (key, bucket) and compares neighbours only; the exact bounds
are tested afterwards. As-of joins are one sort and one running window, without pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.times import DAY
from tidewell.session import cut


def interval_join(events: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, bucket_us: int = 7 * DAY, how: str = "inner") -> DataFrame:
    """Events inside intervals of the same key, both bounds included.

    `start` and `end` are columns of `intervals`; both sides share only `key`. A null end leaves
    the interval open; null keys, times and starts match nothing. An interval is written out
    once for each bucket it meets; an open one ends with its key's last event. With
    how="left" events without an interval stay, with nulls.
    """
    if how == "left":
        # Written down, so that a row keeps its number however often it is read.
        events = cut(events.withColumn("_event", F.monotonically_increasing_id()))
    last = events.groupBy(*key).agg(F.max(at).alias("_last"))
    spans = intervals.where(F.col(start).isNotNull()).join(last, key).withColumn("_stop", F.coalesce(F.least(F.col(end), F.col("_last")), F.col("_last")))
    spans = spans.where(F.col("_stop") >= F.col(start))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket_us), F.floor(F.col("_stop") / bucket_us)))).drop("_last", "_stop")
    marked = events.withColumn("_bucket", F.floor(F.col(at) / bucket_us))
    inside = marked.join(spans, [*key, "_bucket"], how="inner").where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))).drop("_bucket")
    if how == "inner":
        return inside
    rest = events.join(inside.select("_event").distinct(), "_event", "left_anti")
    return inside.unionByName(rest, allowMissingColumns=True).drop("_event")


def near_join(left: DataFrame, right: DataFrame, key: list[str], at: str, other: str, before_us: int, after_us: int) -> DataFrame:
    """Pairs with `other` in [at - before, at + after]; both bounds included.

    Each row of `left` is written out to the few buckets its window meets (buckets are as long
    as the window), `right` stands in one. Null keys and times match nothing.
    """
    width = max(1, before_us + after_us)
    window = F.sequence(F.floor((F.col(at) - before_us) / width), F.floor((F.col(at) + after_us) / width))
    marked = left.where(F.col(at).isNotNull()).withColumn("_bucket", F.explode(window))
    placed = right.where(F.col(other).isNotNull()).withColumn("_bucket", F.floor(F.col(other) / width))
    return marked.join(placed, [*key, "_bucket"]).where(F.col(other).between(F.col(at) - before_us, F.col(at) + after_us)).drop("_bucket")


def lookback(index: DataFrame, events: DataFrame, key: list[str], t0: str, at: str, back_us: int) -> DataFrame:
    """Pairs with `at` in [t0 - back, t0): strictly before the index time."""
    return near_join(index, events, key, t0, at, back_us, 0).where(F.col(at) < F.col(t0))


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], at: str, other: str, value: str, tolerance_us: int | None = None, tie: str | None = None, bucket_us: int = 30 * DAY) -> DataFrame:
    """`left` with `value` (and its time, as `other`) of the last row of `right` at or before `at`.

    An exact match counts. Rows of `right` with a null value are left out. Of several at one
    time the one with the largest `tie` (else value) is taken. Beyond the tolerance, and
    without a match, value and time are null. `left` keeps all its rows, repeated ones and ones
    with null keys or times too.

    The sorted pass runs in each (key, time bucket), so that a key with most of the rows is
    shared by many tasks; what a bucket inherits is the last mark of the buckets before it, found
    among one row for each bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_us)
    pack = F.struct(F.col(other).alias("t"), F.col(tie or value).alias("tie"), F.col(value).alias("v"))
    marks = right.where(F.col(value).isNotNull() & F.col(other).isNotNull()).select(*key, F.col(other).alias("_at"), F.lit(0).alias("_side"), pack.alias("_m"))
    marks = marks.withColumn("_tie", F.col("_m.tie")).withColumn("_bucket", bucket("_at"))
    asks = left.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row")).withColumn("_bucket", bucket("_at"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = marks.select(*key, "_bucket", "_m").unionByName(asks.select(*key, "_bucket").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*key, "_bucket").agg(F.max("_m").alias("_end")).withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier))
    heads = ends.where("_carry is not null").select(*key, "_bucket", F.lit(-(2**62)).alias("_at"), F.lit(-1).alias("_side"), F.col("_carry").alias("_m"))
    both = marks.unionByName(asks, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    upto = Window.partitionBy(*key, "_bucket").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_m", F.last("_m", ignorenulls=True).over(upto)).where("_side = 1")
    # A row without key or time follows nothing.
    known = F.col("_at").isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    near = known if tolerance_us is None else known & (F.col("_at") - F.col("_m.t") <= tolerance_us)
    return got.select("_row.*", F.when(near, F.col("_m.v")).alias(value), F.when(near, F.col("_m.t")).alias(other))


def first_match(points: DataFrame, intervals: DataFrame, key: list[str], point_id: str, at: str, start: str, end: str, order: list[str]) -> DataFrame:
    """Each point with the first interval (in `order`) that holds it; points without one keep nulls.

    A null end is open. Points are told apart by `point_id`, which doesn't repeat.
    """
    held = interval_join(points.select(point_id, *key, at), intervals, key, at, start, end)
    first = Window.partitionBy(point_id).orderBy(*order)
    best = held.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", at, *key)
    return points.join(best, point_id, "left")


def first_crossing(events: DataFrame, key: list[str], at: str, amount: str, threshold: float, tie: str, bucket_us: int = 30 * DAY) -> DataFrame:
    """(key, crossed_at): when the running total of `amount` first reaches the threshold.

    Null amounts add nothing, rows with a null time are left out; keys that never reach it have no
    row. Totals run within (key, time bucket) on top of what the buckets before add up to, which
    is one row for each bucket, so that no key is summed by a single task.
    """
    rows = events.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / bucket_us))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "_bucket").agg(F.sum(amount).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0))).drop("_s")
    upto = Window.partitionBy(*key, "_bucket").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = rows.withColumn("_sum", F.coalesce(F.sum(amount).over(upto), F.lit(0.0))).join(sums, [*key, "_bucket"])
    return same.where(F.col("_sum") + F.col("_before") >= threshold).groupBy(*key).agg(F.min(at).alias("crossed_at"))


def first_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_values(df: DataFrame, key: list[str], name: str, names: list[str], at: str, value: str, tie: str) -> DataFrame:
    """One row for each key, a column for each of `names`: the last non-null value of that name.

    One grouped pass, however many names there are.
    """
    order = F.struct(F.col(at), F.col(tie))
    pick = lambda n: F.max_by(F.col(value), F.when((F.col(name) == n) & F.col(value).isNotNull(), order)).alias(n)
    return df.groupBy(*key).agg(*[pick(n) for n in names])
