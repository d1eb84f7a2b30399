"""Problem 4: the value of each type that was known at each time zero of a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import HOUR, from_micros, micros, second_text
from tidewell.operators.asof import valid_at
from tidewell.sources import table

LOOKBACK = 48 * HOUR


def known_values(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, t0_us, type, time_us, stored_us, event_id, value_num): the row known at each time zero.

    A row can be used from the moment after it was measured and once it was stored, until
    48 hours after it was measured. Later copies of a row start later than its first
    delivery, so they never match where the first doesn't; matched copies are folded into
    the first before the choice, which is by time, storing time and event_id.
    """
    features = table(spark, sf, "features")
    zeros = features.select("subject_id", micros("t0").alias("t0_us")).where("t0_us is not null").distinct()
    # A copy counts by its first delivery, so validity starts with the measurement here, and the
    # storing time is held against t0 after the copies are folded.
    rows = features.where("value_num is not null and type is not null and event_id is not null").select(
        "subject_id", "type", "event_id", micros("time").alias("time_us"), micros("storetime").alias("stored_us"), "value_num",
    )
    start, end = F.greatest(F.col("time_us") + 1, F.col("stored_us")), F.col("time_us") + LOOKBACK + 1
    rows = rows.where("stored_us is not null")
    pairs = valid_at(zeros, rows, "subject_id", "t0_us", start, end, LOOKBACK, salt_by="event_id")
    first = pairs.groupBy("subject_id", "t0_us", "type", "event_id").agg(F.min(F.struct("stored_us", "time_us", "value_num")).alias("f"))
    best = first.groupBy("subject_id", "t0_us", "type").agg(
        F.max(F.struct("f.time_us", "f.stored_us", "event_id", "f.value_num")).alias("b"))
    return best.select("subject_id", "t0_us", "type", "b.*")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, t0_at, type, event_id)."""
    known = known_values(spark, sf)
    return known.select("subject_id", second_text(from_micros("t0_us")).alias("t0_at"), "type", "event_id").distinct()


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """The known value and its age in minutes at time zero."""
    known = known_values(spark, sf)
    age = F.round((F.col("t0_us") - F.col("time_us")) / F.lit(6e7), 3)
    return known.select("subject_id", second_text(from_micros("t0_us")).alias("t0_at"), "type", "value_num", age.alias("age_min"))


_BEST = """WITH z AS (SELECT DISTINCT subject_id, t0 FROM features WHERE t0 IS NOT NULL AND subject_id IS NOT NULL),
f AS (SELECT event_id, any_value(subject_id) AS subject_id, any_value(type) AS type, any_value(time) AS time, min(storetime) AS stored, any_value(value_num) AS value_num
      FROM features WHERE value_num IS NOT NULL AND type IS NOT NULL GROUP BY event_id),
m AS (SELECT z.subject_id, z.t0, f.type, f.event_id, f.time, f.value_num,
      row_number() OVER (PARTITION BY z.subject_id, z.t0, f.type ORDER BY f.time DESC, f.stored DESC, f.event_id DESC) AS rn
      FROM z JOIN f ON f.subject_id = z.subject_id AND f.time < z.t0 AND f.time >= z.t0 - INTERVAL 48 HOUR AND f.stored <= z.t0)
"""

ORACLES = {
    "p4_found": _BEST + "SELECT DISTINCT subject_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS t0_at, type, event_id FROM m WHERE rn = 1",
    "p4_values": _BEST + """SELECT subject_id, strftime(t0, '%Y-%m-%d %H:%M:%S') AS t0_at, type, value_num,
  round(CAST(epoch_us(t0) - epoch_us(time) AS DOUBLE) / 6e7, 3) AS age_min FROM m WHERE rn = 1""",
}

QUERIES = {"p4_found": p4_found, "p4_values": p4_values}
