"""The event stream: one form for all sources, range cleaning, profile, shards, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import micros
from tidewell.operators.canonical import SOURCES, canonical, clean, plausibility, profile, shard
from tidewell.operators.temporal import first_match
from tidewell.sources import first_deliveries, table

STREAM = ["subject_id", "hadm_id", "stay_id", "time", "modality", "type", "value_num", "value_txt", "uom", "is_intervention", "shard"]


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream: first deliveries of features."""
    return first_deliveries(table(spark, sf, "features"), STREAM)


def canonical_union(spark: SparkSession, sf: str) -> DataFrame:
    """Events of three differently built tables in one form, counted by modality and type."""
    tables = {name: table(spark, sf, name) for name in SOURCES}
    tables["lineitem"] = tables["lineitem"].join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = [canonical(tables[name], spec) for name, spec in SOURCES.items()]
    one = rows[0]
    for other in rows[1:]:
        one = one.unionByName(other)
    return one.groupBy("modality", "type", "is_intervention").agg(
        F.count(F.lit(1)).alias("n"), F.count("value_num").alias("with_value"), F.countDistinct("subject_id").alias("subjects"))


def clean_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that survive range cleaning."""
    return clean(stream(spark, sf)).where("keep").select("event_id", "modality", "type", "value_num")


def clean_report(spark: SparkSession, sf: str) -> DataFrame:
    """Kept and dropped rows by modality and type."""
    return clean(stream(spark, sf)).groupBy("modality", "type").agg(
        F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def qc_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, filled shares, value range, shards and flags of each modality."""
    return profile(stream(spark, sf), ["modality"])


def qc_plausibility(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict for each expected type: ok, out of range or not found."""
    expected = table(spark, sf, "item_dim").select("type", "label", "lo", "hi").unionByName(
        spark.createDataFrame([("999999", "never recorded", 0.0, 1.0)], "type string, label string, lo double, hi double"))
    return plausibility(stream(spark, sf), expected)


def shard_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by modality and shard, with the shard computed from the subject."""
    rows = stream(spark, sf).withColumn("computed", shard(F.col("subject_id")))
    return rows.groupBy("modality", "computed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("computed") == F.col("shard")).alias("same"))


def subject_index(spark: SparkSession, sf: str) -> DataFrame:
    """Admissions, stays and studies of each subject, and whether it has any: a full join of three counts."""
    count = lambda name, key, out: table(spark, sf, name).groupBy("subject_id").agg(F.countDistinct(key).alias(out))
    joined = count("admissions", "hadm_id", "n_admissions").join(count("icu_stays", "stay_id", "n_icu_stays"), "subject_id", "full").join(
        count("cxr_studies", "study_id", "n_cxr_studies"), "subject_id", "full")
    filled = joined.na.fill(0)
    return filled.withColumns({"has_ehr": F.col("n_admissions") > 0, "has_icu": F.col("n_icu_stays") > 0, "has_cxr": F.col("n_cxr_studies") > 0}).withColumn(
        "in_all", F.col("has_ehr") & F.col("has_icu") & F.col("has_cxr"))


def episode_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """Each study with the first admission and ICU stay that hold its time, and its encounter type."""
    studies = table(spark, sf, "cxr_studies").select("study_id", "subject_id", micros("study_datetime").alias("at")).distinct()
    studies = studies.where("study_id is not null").groupBy("study_id", "subject_id").agg(F.min("at").alias("at"))
    studies = studies.groupBy("study_id").agg(F.min("subject_id").alias("subject_id"), F.min("at").alias("at"))
    admissions = table(spark, sf, "admissions").select("subject_id", "hadm_id", micros("admittime").alias("s"), micros("dischtime").alias("e")).distinct()
    stays = table(spark, sf, "icu_stays").select("subject_id", "stay_id", micros("intime").alias("s"), micros("outtime").alias("e")).distinct()
    one = first_match(studies, admissions, ["subject_id"], "study_id", "at", "s", "e", ["s", "hadm_id"]).select("study_id", "subject_id", "at", F.col("s").alias("admitted"), "hadm_id")
    two = first_match(one, stays, ["subject_id"], "study_id", "at", "s", "e", ["s", "stay_id"])
    kind = F.when(F.col("at").isNull(), "UNKNOWN").when(F.col("stay_id").isNotNull(), "ICU").when(F.col("hadm_id").isNotNull(), "INPATIENT").otherwise("OUTPATIENT")
    return two.select("study_id", "hadm_id", F.col("stay_id").alias("icu_stay_id"), kind.alias("encounter_type"),
                      F.round((F.col("at") - F.col("admitted")) / F.lit(3.6e9), 4).alias("hours_from_admit"))


def views_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Views, number of studies and images of each subject."""
    rows = table(spark, sf, "cxr_studies").distinct().where("subject_id is not null")
    each = rows.select("subject_id", "n_images", "study_id", F.explode_outer(F.split("views", r"\|")).alias("view"))
    return each.groupBy("subject_id").agg(F.concat_ws("|", F.array_sort(F.collect_set("view"))).alias("views"), F.countDistinct("study_id").alias("studies"))


_F = """f AS (SELECT event_id, any_value(subject_id) AS subject_id, any_value(hadm_id) AS hadm_id, any_value(stay_id) AS stay_id, any_value(t0) AS t0, any_value(time) AS time,
  any_value(modality) AS modality, any_value(type) AS type, any_value(value_num) AS value_num, any_value(value_txt) AS value_txt, any_value(uom) AS uom,
  any_value(urine_output_6h) AS urine_output_6h, any_value(is_intervention) AS is_intervention, any_value(shard) AS shard FROM features GROUP BY event_id)"""

_KEEP = """CASE WHEN modality NOT IN ('chart','lab') THEN true
  WHEN r.type IS NOT NULL THEN value_num IS NOT NULL AND value_num BETWEEN lo AND hi ELSE value_num IS NULL OR abs(value_num) <= 1e6 END"""
_RANGES = """r(type, lo, hi) AS (VALUES ('220045',0,300),('220210',0,80),('220277',0,100),('220050',0,300),('220052',0,250),('223762',20,45),('50912',0,50),('50931',0,2000),('50813',0,40),('51222',0,30))"""

ORACLES = {
    "canonical_union": """WITH u AS (
  SELECT subject_id, modality, type, value_num, is_intervention FROM (SELECT DISTINCT event_id, subject_id, modality, type, value_num, is_intervention FROM features)
  UNION ALL SELECT user_id, 'web', event_type, value, event_type = 'purchase' FROM events
  UNION ALL SELECT o_custkey, 'trade', l_returnflag, l_quantity, false FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT modality, type, is_intervention, count(*) AS n, count(value_num) AS with_value, count(DISTINCT subject_id) AS subjects FROM u GROUP BY 1, 2, 3""",
    "clean_events": f"WITH {_F}, {_RANGES} SELECT event_id, modality, f.type, value_num FROM f LEFT JOIN r USING (type) WHERE {_KEEP}",
    "clean_report": f"WITH {_F}, {_RANGES}, k AS (SELECT modality, f.type, {_KEEP} AS keep FROM f LEFT JOIN r USING (type)) SELECT modality, type, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM k GROUP BY 1, 2",
    "qc_profile": f"""WITH {_F} SELECT modality, count(*) AS n, round(count(value_num) / count(*)::DOUBLE, 9) AS filled_num, round(count(value_txt) / count(*)::DOUBLE, 9) AS filled_txt, round(count(uom) / count(*)::DOUBLE, 9) AS filled_uom,
  min(value_num) AS low, max(value_num) AS high, round(avg(value_num), 6) AS mean, count(DISTINCT shard) AS shards, count(DISTINCT is_intervention) AS flags, count(DISTINCT type) AS types,
  strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_at FROM f GROUP BY modality""",
    "qc_plausibility": f"""WITH {_F}, s AS (SELECT type, count(value_num) AS n, min(value_num) AS low, max(value_num) AS high FROM f GROUP BY type),
x AS (SELECT type, label, lo, hi FROM item_dim UNION ALL SELECT '999999', 'never recorded', 0.0, 1.0)
SELECT x.type, label, coalesce(n, 0) AS n, low, high, CASE WHEN coalesce(n, 0) = 0 THEN 'NOT FOUND' WHEN low < lo OR high > hi THEN 'OUT OF RANGE' ELSE 'OK' END AS verdict FROM x LEFT JOIN s USING (type)""",
    "shard_counts": f"WITH {_F} SELECT modality, 'p' || substr(subject_id::VARCHAR, 1, 2) AS computed, count(*) AS n, count(*) FILTER ('p' || substr(subject_id::VARCHAR, 1, 2) = shard) AS same FROM f GROUP BY 1, 2",
    "subject_index": """WITH a AS (SELECT subject_id, count(DISTINCT hadm_id) AS n FROM admissions GROUP BY 1), i AS (SELECT subject_id, count(DISTINCT stay_id) AS n FROM icu_stays GROUP BY 1),
c AS (SELECT subject_id, count(DISTINCT study_id) AS n FROM cxr_studies GROUP BY 1),
j AS (SELECT subject_id, coalesce(a.n, 0) AS n_admissions, coalesce(i.n, 0) AS n_icu_stays, coalesce(c.n, 0) AS n_cxr_studies FROM a FULL JOIN i USING (subject_id) FULL JOIN c USING (subject_id))
SELECT *, n_admissions > 0 AS has_ehr, n_icu_stays > 0 AS has_icu, n_cxr_studies > 0 AS has_cxr, n_admissions > 0 AND n_icu_stays > 0 AND n_cxr_studies > 0 AS in_all FROM j""",
    "episode_linkage": """WITH s AS (SELECT study_id, min(subject_id) AS subject_id, min(study_datetime) AS w FROM cxr_studies WHERE study_id IS NOT NULL GROUP BY 1),
a AS (SELECT s.study_id, hadm_id, admittime, row_number() OVER (PARTITION BY s.study_id ORDER BY admittime, hadm_id) AS n FROM s JOIN (SELECT DISTINCT subject_id, hadm_id, admittime, dischtime FROM admissions) a
  ON a.subject_id = s.subject_id AND w >= admittime AND (dischtime IS NULL OR w <= dischtime)),
i AS (SELECT s.study_id, stay_id, row_number() OVER (PARTITION BY s.study_id ORDER BY intime, stay_id) AS n FROM s JOIN (SELECT DISTINCT subject_id, stay_id, intime, outtime FROM icu_stays) i
  ON i.subject_id = s.subject_id AND w >= intime AND (outtime IS NULL OR w <= outtime))
SELECT s.study_id, hadm_id, stay_id AS icu_stay_id, CASE WHEN w IS NULL THEN 'UNKNOWN' WHEN stay_id IS NOT NULL THEN 'ICU' WHEN hadm_id IS NOT NULL THEN 'INPATIENT' ELSE 'OUTPATIENT' END AS encounter_type,
  round((epoch_us(w) - epoch_us(admittime))::DOUBLE / 3.6e9, 4) AS hours_from_admit
FROM s LEFT JOIN a ON a.study_id = s.study_id AND a.n = 1 LEFT JOIN i ON i.study_id = s.study_id AND i.n = 1""",
    "views_agg": """WITH r AS (SELECT DISTINCT subject_id, study_id, views FROM cxr_studies WHERE subject_id IS NOT NULL), v AS (SELECT subject_id, study_id, unnest(string_split(views, '|')) AS view FROM r)
SELECT subject_id, coalesce((SELECT string_agg(DISTINCT view, '|' ORDER BY view) FROM v WHERE v.subject_id = r.subject_id), '') AS views, count(DISTINCT study_id) AS studies FROM r GROUP BY subject_id""",
}

QUERIES = {f.__name__: f for f in (canonical_union, clean_events, clean_report, qc_profile, qc_plausibility, shard_counts, subject_index, episode_linkage, views_agg)}
