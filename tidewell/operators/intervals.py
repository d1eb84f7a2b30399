"""Continuous periods from overlapping intervals, and the gaps between them.

Spark's session window with a length of its own on each row is an interval merger: a
session starts at the row's start, lasts until its end, and sessions that overlap become
one. `merge_intervals` applies it twice. The first pass groups by entity *and* coarse
time bucket, so an entity that holds a third of all rows is merged by many tasks; the
second pass merges the few periods left of each entity. Merging is associative, so two
passes give what one would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.times import DAY, micros


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """One session_window pass over (keys, s, e in microseconds, members)."""
    session = F.session_window(F.timestamp_micros("s"), F.expr("concat(e - s, ' microseconds')"))
    return df.groupBy(*keys, session.alias("w")).agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.sum("members").alias("members")
    ).drop("w")


def merge_intervals(df: DataFrame, entity: str, start: Column | str, end: Column | str, bucket_days: int = 64) -> DataFrame:
    """Continuous periods: (entity, start_us, end_us, members).

    Intervals that overlap, nest or touch (end = start) are one period; a difference of
    one microsecond separates. Rows whose entity, start or end is null, or whose end isn't
    after the start, are left out. Every row counts as one member: repeated deliveries
    must be removed before. An empty input gives an empty result.
    """
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    rows = df.select(F.col(entity).alias("entity"), micros(start).alias("s"), micros(end).alias("e"), F.lit(1).cast("long").alias("members"))
    rows = rows.where("entity is not null and s is not null and e is not null and e > s")
    rows = rows.withColumn("bucket", F.expr(f"s div {bucket_days * DAY}"))
    once = _merge(rows, ["entity", "bucket"]).drop("bucket")
    sessions = _merge(once, ["entity"])
    # Sessions that only touch are joined here: a period begins where no earlier end reaches its start.
    by_time = Window.partitionBy("entity").orderBy("s", "e")
    reach = F.max("e").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    island = F.sum("fresh").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sessions.withColumn("fresh", fresh).withColumn("island", island).groupBy("entity", "island")
        .agg(F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.sum("members").alias("members"))
        .select(F.col("entity").alias(entity), "start_us", "end_us", "members")
    )


def period_gaps(periods: DataFrame, entity: str) -> DataFrame:
    """The time between consecutive periods of an entity: (entity, start_us, end_us).

    `periods` are disjoint, as merge_intervals returns them. An entity with one period
    has no gap.
    """
    following = F.lead("start_us").over(Window.partitionBy(entity).orderBy("start_us"))
    return periods.withColumn("next_us", following).where("next_us is not null").select(
        entity, F.col("end_us").alias("start_us"), F.col("next_us").alias("end_us")
    )


def contained_in(inner: DataFrame, outer: DataFrame, entity: str) -> DataFrame:
    """The rows of `inner` that lie wholly within one row of `outer`; the rows of `outer`
    are disjoint within an entity.

    Only the outer period that began last before the inner one can hold it, so one sorted
    pass finds it; no pairs are made.
    """
    marks = outer.select(entity, F.col("start_us").alias("at"), F.col("end_us").alias("outer_end"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("end_us"))
    asks = inner.select(entity, F.col("start_us").alias("at"), F.lit(None).cast("long").alias("outer_end"), F.lit(1).alias("side"), "end_us")
    before = Window.partitionBy(entity).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = marks.unionByName(asks).withColumn("held", F.last("outer_end", ignorenulls=True).over(before))
    return held.where("side = 1 and end_us <= held").select(entity, F.col("at").alias("start_us"), "end_us")
