"""Feature blocks at time zero: ages from anchor years, pooled values with fallbacks and a column of what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import HOUR, from_micros, micros, second_text
from tidewell.operators.temporal import asof_backward, lookback
from tidewell.session import cut
from tidewell.sources import first_deliveries, table

#: The types of the block and the window before time zero.
TYPES = ["220045", "220277", "50912"]
WINDOW = 24 * HOUR


def age_at_admission(spark: SparkSession, sf: str) -> DataFrame:
    """The age at each admission: the anchor age, moved by the years between the anchor year and the admission."""
    stays = table(spark, sf, "admissions").select("subject_id", "hadm_id", "admittime").distinct()
    people = table(spark, sf, "patients").select("subject_id", "anchor_age", "anchor_year")
    age = F.col("anchor_age") + F.year("admittime") - F.col("anchor_year")
    return stays.join(people, "subject_id").select("subject_id", "hadm_id", age.cast("int").alias("age"), F.when(age < 65, "below 65").when(age >= 65, "65 and above").alias("band")).distinct()


def pooled_block(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each type in the day before each time zero; else the last value before it; else the mean over all time
    zeros that have one. `origin` says which, `missing` whether the value is no one's own.

    Pairs exist only within a window; the last values come from a sorted pass over time buckets.
    """
    rows = first_deliveries(table(spark, sf, "features").where(F.col("type").isin(TYPES)), ["subject_id", "type", "time", "value_num"])
    values = cut(rows.where("value_num is not null and subject_id is not null").select("event_id", "subject_id", "type", micros("time").alias("at_us"), F.col("value_num").alias("v")))
    zeros = table(spark, sf, "features").select("subject_id", micros("t0").alias("t0_us")).where("subject_id is not null and t0_us is not null").distinct()
    wanted = cut(zeros.withColumn("type", F.explode(F.array(*[F.lit(t) for t in TYPES]))))
    pairs = lookback(wanted, values, ["subject_id", "type"], "t0_us", "at_us", WINDOW)
    window = pairs.groupBy("subject_id", "type", "t0_us").agg(F.avg("v").alias("in_window"))
    # Strictly before time zero.
    last = asof_backward(wanted.withColumn("_before", F.col("t0_us") - 1), values, ["subject_id", "type"], "_before", "at_us", "v", tie="event_id").select("subject_id", "type", "t0_us", F.col("v").alias("last"))
    own = cut(last.join(window, ["subject_id", "type", "t0_us"], "left").withColumn("own", F.coalesce("in_window", "last")))
    # One row for each type of the block.
    whole = own.groupBy("type").agg(F.avg("own").alias("whole"))
    origin = F.when(F.col("in_window").isNotNull(), "window").when(F.col("last").isNotNull(), "last").otherwise("cohort")
    return own.join(F.broadcast(whole), "type").select(
        "subject_id", second_text(from_micros("t0_us")).alias("t0_at"), "type", F.round(F.coalesce("own", "whole"), 6).alias("value"), origin.alias("origin"), F.col("own").isNull().alias("missing"))


def block_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Share of time zeros without a value of their own, by type: the column a block gets unless it is complete."""
    return pooled_block(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("missing"), (F.count_if("missing") > 0).alias("needs_column"))


_BLOCK = """WITH f AS (SELECT event_id, subject_id, type, time, value_num FROM features WHERE event_id IS NOT NULL AND type IN ('220045', '220277', '50912') QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY storetime) = 1),
v AS (SELECT * FROM f WHERE value_num IS NOT NULL AND subject_id IS NOT NULL),
z AS (SELECT DISTINCT subject_id, t0, y.type FROM (SELECT DISTINCT subject_id, t0 FROM features WHERE subject_id IS NOT NULL AND t0 IS NOT NULL) x, (VALUES ('220045'), ('220277'), ('50912')) y(type)),
w AS (SELECT z.subject_id, z.t0, z.type, avg(value_num) FILTER (time >= t0 - INTERVAL 24 HOUR) AS in_window, arg_max(value_num, (time, event_id)) AS last FROM z LEFT JOIN v ON v.subject_id = z.subject_id AND v.type = z.type AND v.time < z.t0 GROUP BY 1, 2, 3),
o AS (SELECT *, coalesce(in_window, last) AS own FROM w), m AS (SELECT type, avg(own) AS whole FROM o GROUP BY 1),
k AS (SELECT subject_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS t0_at, type, round(coalesce(own, whole), 6) AS value, CASE WHEN in_window IS NOT NULL THEN 'window' WHEN last IS NOT NULL THEN 'last' ELSE 'cohort' END AS origin, own IS NULL AS missing FROM o JOIN m USING (type))
"""
ORACLES = {
    "age_at_admission": """SELECT DISTINCT subject_id, hadm_id, age, band FROM (SELECT a.subject_id, hadm_id, admittime, CAST(anchor_age + year(admittime) - anchor_year AS INTEGER) AS age, CASE WHEN anchor_age + year(admittime) - anchor_year < 65 THEN 'below 65' WHEN anchor_age + year(admittime) - anchor_year >= 65 THEN '65 and above' END AS band
  FROM (SELECT DISTINCT subject_id, hadm_id, admittime FROM admissions) a JOIN patients USING (subject_id))""",
    "pooled_block": _BLOCK + "SELECT * FROM k",
    "block_missing": _BLOCK + "SELECT type, count(*) AS n, count(*) FILTER (missing) AS missing, count(*) FILTER (missing) > 0 AS needs_column FROM k GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (age_at_admission, pooled_block, block_missing)}
