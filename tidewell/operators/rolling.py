"""Totals over trailing days, for every calendar day of an entity.

Rows are first summed to one total a day, which bounds what follows: an entity has at most
one row for each day and measure, however many rows it had. The calendar of an entity holds
the days that an active day still reaches, so two active days far apart leave no days between
them. Each calendar day is range-joined to the daily totals within its longest window; the join is an
equi-join on coarse date buckets as long as that window, each total standing in its own
bucket and the next, so that only neighbours are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_totals(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """(keys, day as days since 1970, total, n): nulls in `value` add nothing; rows with a null day are left out."""
    return df.where(F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(
        *keys, F.unix_date(F.col(day).cast("date")).alias("day")
    ).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def trailing_totals(totals: DataFrame, keys: list[str], windows: list[int]) -> DataFrame:
    """(keys, day, total_W and mean_W for each W): sums over the last W days, that day
    included; days without rows count as zero. `totals` as daily_totals returns them.

    The calendar has every day on which the longest window holds an active day, so each
    day outside it has zero for all windows. Null keys are kept as a group of their own.
    """
    longest = max(windows)
    keyed = totals.withColumn("_k", F.xxhash64(*keys))
    # Each active day is followed by the days up to the next one, at most `longest` of them. An entity has one row a day here.
    reach = lambda day, i: F.sequence(day, F.least(day + (longest - 1), F.coalesce(F.get("_days", i + 1) - 1, day + (longest - 1))))
    calendar = keyed.groupBy(*keys, "_k").agg(F.array_sort(F.collect_set("day")).alias("_days")).select(
        *keys, "_k", F.explode(F.flatten(F.transform("_days", reach))).alias("day"))
    left = calendar.withColumn("_bucket", F.expr(f"day div {longest}"))
    right = keyed.select(F.col("_k"), *[F.col(k).alias(f"_r_{k}") for k in keys], F.col("day").alias("_day"), "total",
                         F.explode(F.array(F.expr(f"day div {longest}"), F.expr(f"day div {longest} + 1"))).alias("_bucket"))
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    near = left.join(right, ["_k", "_bucket"]).where((F.col("_day") <= F.col("day")) & (F.col("_day") > F.col("day") - longest))
    for s in same:
        near = near.where(s)
    sums = [F.coalesce(F.sum(F.when(F.col("_day") > F.col("day") - w, F.col("total"))), F.lit(0.0)).alias(f"total_{w}") for w in windows]
    return near.groupBy(*keys, "day").agg(*sums).select(
        *keys, F.date_from_unix_date("day").alias("day"), *[f"total_{w}" for w in windows],
        *[(F.col(f"total_{w}") / F.lit(float(w))).alias(f"mean_{w}") for w in windows])
