"""Problem 6: totals and averages over the last 7 and 30 days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import day_text
from tidewell.operators.rolling import daily_totals, trailing_totals
from tidewell.sources import first_deliveries, table


def _trailing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "features").where("(modality = 'input' and value_num is not null) or urine_output_6h is not null")
    rows = first_deliveries(rows, ["subject_id", "time", "modality", "value_num", "urine_output_6h"]).where("subject_id is not null")
    measures = F.array(
        F.struct(F.lit("urine_output_6h").alias("measure"), F.col("urine_output_6h").alias("amount")),
        F.struct(F.lit("value_num").alias("measure"), F.when(F.col("modality") == "input", F.col("value_num")).alias("amount")))
    long = rows.select("subject_id", "time", F.inline(measures))
    return trailing_totals(daily_totals(long, ["subject_id", "measure"], "time", "amount"), ["subject_id", "measure"], [7, 30])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, day, measure): the 7-day average is positive and below half of the 30-day average."""
    low = _trailing(spark, sf).where("total_7 > 0 and 60 * total_7 < 7 * total_30")
    return low.select("subject_id", day_text("day").alias("day"), "measure").distinct()


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and averages of every calendar day with activity in its last 30 days."""
    t = _trailing(spark, sf)
    return t.select("subject_id", "measure", day_text("day").alias("day"), "total_7", "total_30",
                    F.round("mean_7", 6).alias("mean_7"), F.round("mean_30", 6).alias("mean_30"))


_DAYS = """WITH f AS (SELECT event_id, any_value(subject_id) AS subject_id, any_value(time) AS time, any_value(modality) AS modality,
        any_value(value_num) AS value_num, any_value(urine_output_6h) AS urine FROM features GROUP BY event_id),
m AS (SELECT subject_id, CAST(time AS DATE) AS d, 'urine_output_6h' AS measure, urine AS x FROM f WHERE urine IS NOT NULL
      UNION ALL SELECT subject_id, CAST(time AS DATE), 'value_num', value_num FROM f WHERE modality = 'input' AND value_num IS NOT NULL),
day AS (SELECT subject_id, measure, d, sum(x) AS x FROM m WHERE subject_id IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
cal AS (SELECT DISTINCT subject_id, measure, CAST(d + CAST(k AS INTEGER) AS DATE) AS day FROM day, range(30) r(k)),
t AS (SELECT c.subject_id, c.measure, c.day, sum(CASE WHEN day.d > c.day - 7 THEN x ELSE 0 END) AS total_7, sum(x) AS total_30
      FROM cal c JOIN day ON day.subject_id = c.subject_id AND day.measure = c.measure AND day.d <= c.day AND day.d > c.day - 30 GROUP BY ALL)
"""

ORACLES = {
    "p6_found": _DAYS + "SELECT subject_id, strftime(day, '%Y-%m-%d') AS day, measure FROM t WHERE total_7 > 0 AND total_7 * 60 < total_30 * 7",
    "p6_totals": _DAYS + """SELECT subject_id, measure, strftime(day, '%Y-%m-%d') AS day, CAST(total_7 AS DOUBLE) AS total_7, total_30,
  round(total_7 / 7.0::DOUBLE, 6) AS mean_7, round(total_30 / 30.0::DOUBLE, 6) AS mean_30 FROM t""",
}

QUERIES = {"p6_found": p6_found, "p6_totals": p6_totals}
