"""Problem 1: hospital and ICU periods, and the ICU gaps inside a hospital period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import from_micros, second_text
from tidewell.operators.intervals import contained_in, merge_intervals, period_gaps
from tidewell.sources import table


def _periods(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    admissions, stays = table(spark, sf, "admissions").distinct(), table(spark, sf, "icu_stays").distinct()
    discharge = admissions.where("hadm_id is not null").groupBy("hadm_id").agg(F.max("dischtime").alias("discharge"))
    closed = stays.select("subject_id", "hadm_id", "intime", "outtime").join(discharge, "hadm_id", "left")
    hospital = merge_intervals(admissions, "subject_id", "admittime", "dischtime")
    icu = merge_intervals(closed, "subject_id", "intime", F.coalesce("outtime", "discharge"))
    return hospital, icu


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, kind, start_at, end_at): merged periods of two or more members, and ICU
    gaps that lie wholly within one hospital period."""
    hospital, icu = _periods(spark, sf)
    parts = [
        hospital.where("members > 1").select("subject_id", F.lit("hospital_period").alias("kind"), "start_us", "end_us"),
        icu.where("members > 1").select("subject_id", F.lit("icu_period").alias("kind"), "start_us", "end_us"),
        contained_in(period_gaps(icu, "subject_id"), hospital, "subject_id").select("subject_id", F.lit("gap").alias("kind"), "start_us", "end_us"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("subject_id", "kind", second_text(from_micros("start_us")).alias("start_at"), second_text(from_micros("end_us")).alias("end_at")).distinct()


def p1_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Every continuous period with its number of members and its length in hours."""
    hospital, icu = _periods(spark, sf)
    rows = hospital.withColumn("kind", F.lit("hospital")).unionByName(icu.withColumn("kind", F.lit("icu")))
    return rows.select(
        "subject_id", "kind", second_text(from_micros("start_us")).alias("start_at"), second_text(from_micros("end_us")).alias("end_at"),
        "members", F.round((F.col("end_us") - F.col("start_us")) / F.lit(3.6e9), 3).alias("hours"),
    )


_ISLANDS = """
adm AS (SELECT DISTINCT * FROM admissions), stay AS (SELECT DISTINCT * FROM icu_stays),
dis AS (SELECT hadm_id, max(dischtime) AS discharge FROM adm WHERE hadm_id IS NOT NULL GROUP BY 1),
iv AS (
  SELECT subject_id, 'hospital' AS kind, admittime AS s, dischtime AS e FROM adm
  UNION ALL SELECT subject_id, 'icu', intime, coalesce(outtime, discharge) FROM stay LEFT JOIN dis USING (hadm_id)),
ok AS (SELECT * FROM iv WHERE subject_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND e > s),
flag AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY subject_id, kind ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM ok),
isl AS (SELECT *, sum(f) OVER (PARTITION BY subject_id, kind ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM flag),
per AS (SELECT subject_id, kind, min(s) AS s, max(e) AS e, count(*) AS members FROM isl GROUP BY subject_id, kind, g)
"""

ORACLES = {
    "p1_found": f"""WITH {_ISLANDS},
gap AS (SELECT subject_id, e AS s, lead(s) OVER (PARTITION BY subject_id ORDER BY s) AS e FROM per WHERE kind = 'icu'),
r AS (
  SELECT subject_id, kind || '_period' AS kind, s, e FROM per WHERE members > 1
  UNION ALL SELECT g.subject_id, 'gap', g.s, g.e FROM gap g JOIN per h ON h.kind = 'hospital' AND h.subject_id = g.subject_id AND h.s <= g.s AND g.e <= h.e)
SELECT DISTINCT subject_id, kind, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_at FROM r""",
    "p1_periods": f"""WITH {_ISLANDS}
SELECT subject_id, kind, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_at,
  CAST(members AS BIGINT) AS members, round(CAST(epoch_us(e) - epoch_us(s) AS DOUBLE) / 3.6e9, 3) AS hours FROM per""",
}

QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods}
