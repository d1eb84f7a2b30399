"""Problem 5: values in the common unit of their type, and the rows recorded in another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators.units import to_common
from tidewell.sources import table

#: The item type whose unit apacheapsvar.fio2 shares.
FIO2 = "223835"


def converted(spark: SparkSession, sf: str) -> DataFrame:
    """(source_table, row_id, type, value, recorded_unit, common_unit, common_value) of every row with a value."""
    items = table(spark, sf, "item_dim")
    features = table(spark, sf, "features").select(
        F.lit("features").alias("source_table"), F.col("event_id").alias("row_id"), "type", "value_num", "value_txt", "uom")
    apache = table(spark, sf, "apacheapsvar").select(
        F.lit("apacheapsvar").alias("source_table"), F.col("patientunitstayid").alias("row_id"), F.lit(FIO2).alias("type"),
        F.when(F.col("fio2") != -1, F.col("fio2")).alias("value_num"), F.lit(None).cast("string").alias("value_txt"), F.lit(None).cast("string").alias("uom"))
    rows = to_common(features.unionByName(apache), items)
    return rows.where("row_id is not null and value is not null and common_unit is not null").select(
        "source_table", "row_id", "type", "value", "recorded_unit", "common_unit", "common_value")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """(source_table, row_id): rows recorded in another unit than the common one."""
    return converted(spark, sf).where("recorded_unit <> common_unit").select("source_table", "row_id").distinct()


def p5_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, least and largest value and mean in the common unit by type and recorded unit (copies counted once)."""
    rows = converted(spark, sf).distinct()
    return rows.groupBy("source_table", "type", "recorded_unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("common_value"), 6).alias("low"), F.round(F.max("common_value"), 6).alias("high"),
        F.round(F.avg("common_value"), 6).alias("mean"))


_UNITS = r"""WITH d AS (SELECT * FROM (VALUES
  ('223762','F',5.0::DOUBLE/9,-160.0::DOUBLE/9,25.0,45.0,false), ('223835','%',0.01::DOUBLE,0.0,0.2,1.0,true), ('224639','lb',0.45359237::DOUBLE,0.0,20.0,320.0,false),
  ('50931','mmol/L',18.016::DOUBLE,0.0,10.0,1800.0,true), ('50912','umol/L',1/88.42::DOUBLE,0.0,0.05,45.0,true), ('50813','mg/dL',1/9.008::DOUBLE,0.0,0.1,38.0,false),
  ('51222','g/L',0.1::DOUBLE,0.0,1.5,27.0,true)) t(type, unit, a, b, lo, hi, far)),
r AS (SELECT DISTINCT 'features' AS source_table, event_id AS row_id, type, value_num, value_txt, uom FROM features
  UNION ALL SELECT DISTINCT 'apacheapsvar', patientunitstayid, '223835', nullif(fio2, -1), NULL, NULL FROM apacheapsvar),
v AS (SELECT *, coalesce(value_num, try_cast(replace(regexp_extract(value_txt, '-?\d+([.,]\d+)?'), ',', '.') AS DOUBLE)) AS v,
  CASE WHEN regexp_matches(value_txt, '\d') THEN regexp_replace(regexp_replace(lower(value_txt), '\([^)]*\)|approx|=|-?\d+([.,]\d+)?', '', 'g'), '\s', '', 'g') END AS ut,
  lower(regexp_replace(uom, '\s', '', 'g')) AS uu FROM r),
s AS (SELECT v.*, d.*, translate(ut, 'µμ', 'uu') AS t1, translate(uu, 'µμ', 'uu') AS t2 FROM v JOIN d USING (type) WHERE v IS NOT NULL),
w AS (SELECT *, CASE type WHEN '223762' THEN ['f','degf','deg.f','°f','fahrenheit'] WHEN '223835' THEN ['%','pct','percent','vol%'] WHEN '224639' THEN ['lb','lbs','pounds']
   WHEN '50931' THEN ['mmol/l','mm'] WHEN '50912' THEN ['umol/l','mcmol/l','micromol/l'] WHEN '50813' THEN ['mg/dl'] ELSE ['g/l','gm/l'] END AS f,
  CASE WHEN t1 = '' THEN NULL ELSE t1 END AS told FROM s),
x AS (SELECT *, CASE WHEN told IS NOT NULL THEN list_contains(f, told) WHEN t2 IS NOT NULL AND list_contains(f, t2) THEN true
  WHEN far THEN v > 0 AND abs(ln(abs(nullif(v,0)) * a / sqrt(lo * hi))) < abs(ln(abs(nullif(v,0)) / sqrt(lo * hi))) AND v * a BETWEEN lo AND hi
  ELSE v NOT BETWEEN lo AND hi AND v * a + b BETWEEN lo AND hi END AS away FROM w)
"""

ORACLES = {"p5_found": _UNITS + "SELECT DISTINCT source_table, row_id FROM x WHERE away"}

QUERIES = {"p5_found": p5_found, "p5_summary": p5_summary}
