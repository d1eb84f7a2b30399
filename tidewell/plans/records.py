"""Queries on records: outcomes, censoring, scores, bands, prefixes, keywords, nested text, vectors, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.functions.times import DAY, from_micros, micros, second_text
from tidewell.operators.canonical import shard
from tidewell.operators.estimate import fold
from tidewell.operators.vectors import impute, pool
from tidewell.plans.timelines import zeros
from tidewell.sources import table

HORIZON = 365


def _first_zero(spark: SparkSession, sf: str) -> DataFrame:
    return zeros(spark, sf).groupBy("subject_id").agg(F.min("t0").alias("t0"))


def outcome_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each subject died within the horizon from its first time zero, in whole days."""
    died = table(spark, sf, "patients").select("subject_id", "dod").distinct()
    days = F.datediff("dod", from_micros("t0").cast("date"))
    return _first_zero(spark, sf).join(died, "subject_id", "left").select(
        "subject_id", days.alias("days"), F.coalesce(days.between(0, HORIZON), F.lit(False)).cast("int").alias("outcome"))


def censoring_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each subject was observed at the horizon: dead, or discharged so late that it reaches beyond it."""
    last = table(spark, sf, "admissions").groupBy("subject_id").agg(micros(F.max("dischtime")).alias("last"))
    died = table(spark, sf, "patients").groupBy("subject_id").agg(F.max("dod").alias("dod"))
    rows = _first_zero(spark, sf).join(last, "subject_id", "left").join(died, "subject_id", "left")
    seen = F.col("dod").isNotNull() | F.coalesce(F.col("last") + 365 * DAY >= F.col("t0") + HORIZON * DAY, F.lit(False))
    return rows.select("subject_id", seen.cast("int").alias("observed"))


def _bands(x: Column, limits: list[float], below: bool) -> Column:
    """4, 3, 2, 1 points by the first limit that is met, else 0; missing gives 0."""
    out = F.lit(0)
    for points, limit in zip((1, 2, 3, 4), reversed(limits)):
        out = F.when(x < limit if below else x >= limit, points).otherwise(out)
    return out


def organ_score(spark: SparkSession, sf: str) -> DataFrame:
    """Organ score of each unit stay from its physiology; -1 is missing, fio2 is taken as a fraction."""
    raw = table(spark, sf, "apacheapsvar").distinct()
    have = {c: F.when(F.col(c) != -1, F.nanvl(c, F.lit(None).cast("double"))) for c in raw.columns if c != "patientunitstayid"}
    rows = raw.select("patientunitstayid", *[e.alias(c) for c, e in have.items()])
    fraction = F.when(F.col("fio2") > 1.5, F.col("fio2") / 100).otherwise(F.col("fio2"))
    ratio = F.try_divide(F.col("pao2"), fraction)
    score = (_bands(ratio, [100, 200, 300, 400], True) + _bands(F.col("bilirubin"), [12, 6, 2, 1.2], False)
             + F.when(F.col("meanbp") < 70, 1).otherwise(0) + _bands(F.col("creatinine"), [5, 3.5, 2, 1.2], False))
    return rows.select("patientunitstayid", F.round(ratio, 6).alias("pf_ratio"), score.cast("long").alias("score"))


def age_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Unit stays and early deaths by age band (left-open, right-closed); ">89" counts as 90, offsets are minutes."""
    rows = table(spark, sf, "patient").distinct()
    age = F.when(F.trim("age").startswith(">"), 90.0).otherwise(F.trim("age").try_cast("double"))
    band = F.when(age <= 40, "(0,40]").when(age <= 65, "(40,65]").when(age <= 80, "(65,80]").when(age.isNotNull(), "(80,120]").otherwise("unknown")
    early = (F.lower(F.trim("hospitaldischargestatus")) == "expired") & (F.col("hospitaldischargeoffset") <= 28 * 1440)
    return rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(early, F.lit(False))).alias("early_deaths"))


def prefix_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Events by code family, from a table of prefixes for each code system (here the modality); a code may have several families."""
    prefixes = spark.createDataFrame([("chart", "2200", "pressure"), ("chart", "2202", "breathing"), ("lab", "509", "chemistry"), ("lab", "5", "lab"), ("input", "22", "fluid"), ("output", "226", "output")], "system string, prefix string, family string")
    codes = table(spark, sf, "features").groupBy("modality", "type").agg(F.countDistinct("event_id").alias("n"))
    # One row for each code, so the prefix join works on codes, not on events.
    same = (F.col("modality") == F.col("system")) & F.col("type").startswith(F.col("prefix"))
    return codes.join(F.broadcast(prefixes), same).groupBy("family").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("codes"))


def keyword_regex(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language with a word of a family in their text, whatever its case."""
    docs = table(spark, sf, "documents")
    hit = lambda pattern: F.count_if(F.coalesce(F.lower("text").rlike(pattern), F.lit(False)))
    lang = F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("none"))
    return docs.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n"), hit("court|judge|verdict").alias("law"), hit("surgeon|fever|dosage").alias("medicine"),
                                                F.count_if(F.coalesce(F.col("text").contains("©"), F.lit(False))).alias("footers"))


def nested_props(spark: SparkSession, sf: str) -> DataFrame:
    """A number inside a JSON text, summed by event type and day."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(k).alias("k"), F.count(F.lit(1)).alias("n"))


def compact_times(spark: SparkSession, sf: str) -> DataFrame:
    """Study times put together from a date number and a time number, as image archives give them."""
    rows = table(spark, sf, "cxr_studies").select("study_id", F.date_format("study_datetime", "yyyyMMdd").cast("int").alias("d"), F.date_format("study_datetime", "HHmmss").cast("double").alias("t")).distinct()
    text = F.concat(F.lpad(F.col("d").cast("string"), 8, "0"), F.lpad(F.floor("t").cast("string"), 6, "0"))
    return rows.select("study_id", second_text(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))).alias("at")).where("study_id is not null").distinct()


def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user (half an hour without an event ends one): count, events and longest."""
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def vector_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and largest value of each position over the vectors of a label."""
    p = pool(table(spark, sf, "embeddings"), ["label"], "embedding")
    return p.select("label", "pos", F.round("mean", 5).alias("mean"), F.round("max", 5).alias("max"))


def vector_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled vectors of the labels 0 to 11, with the overall mean for those without vectors."""
    e = table(spark, sf, "embeddings")
    wanted = spark.range(12).select(F.col("id").cast("int").alias("label"))
    got = impute(wanted, pool(e, ["label"], "embedding"), pool(e, [], "embedding"), "label")
    return got.select("label", "pos", F.round("value", 5).alias("value"), "real")


def fold_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and sum of keys of each hash fold of the orders."""
    return table(spark, sf, "orders").groupBy(fold("o_orderkey").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of exactly 500 orders without replacement, the same in every run: the least 500 by a seeded hash."""
    return table(spark, sf, "orders").select("o_orderkey", F.md5(F.concat(F.lit("7-"), F.col("o_orderkey").cast("string"))).alias("h")).orderBy("h", "o_orderkey").limit(500).select("o_orderkey")


def integrity(spark: SparkSession, sf: str) -> DataFrame:
    """(check, failures, passed) of invariants of the tables, each counted over all rows; a table is read once for all of its checks."""
    f, e = table(spark, sf, "features"), table(spark, sf, "embeddings")
    # Copies are compared by what identifies an event, in the same pass that counts the checks on rows.
    same = F.xxhash64("subject_id", "time", "type")
    of_event = f.groupBy("event_id").agg(
        F.count_if(F.col("storetime") < F.col("time")).alias("early"), F.count_if(F.col("shard") != shard(F.col("subject_id"))).alias("shard"),
        F.count_if((F.col("modality") == "lab") & F.col("stay_id").isNotNull()).alias("lab"), F.count_if(F.col("t0").isNotNull() & F.col("stay_id").isNull()).alias("t0"),
        (F.min(same) != F.max(same)).cast("int").alias("differ"))
    counted = of_event.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("early", "shard", "lab", "t0", "differ")])
    rows = counted.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("failures")) for c, name in (
        ("early", "stored before measured"), ("shard", "shard of another subject"), ("lab", "lab row with a stay"), ("t0", "time zero without a stay"), ("differ", "copies that disagree"))])))
    of_vector = e.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("length"))
    vectors = of_vector.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.count_if(F.col("n") > 1).alias("twice"))
    rows = rows.unionByName(vectors.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("failures")) for c, name in (
        ("length", "vector of another length"), ("twice", "index with several vectors"))]))))
    stays = table(spark, sf, "icu_stays").where("subject_id is not null").select("subject_id").distinct()
    orphans = stays.join(table(spark, sf, "patients").select("subject_id").distinct(), "subject_id", "left_anti").agg(F.count(F.lit(1)).alias("failures"))
    rows = rows.unionByName(orphans.select(F.lit("stay of an unknown subject").alias("check"), "failures"))
    return rows.select("check", "failures", (F.col("failures") == 0).alias("passed"))


_Z = "z AS (SELECT subject_id, min(t0) AS t0 FROM features WHERE t0 IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1)"
ORACLES = {
    "outcome_horizon": f"WITH {_Z}, p AS (SELECT DISTINCT subject_id, dod FROM patients) SELECT z.subject_id, CAST(date_diff('day', CAST(t0 AS DATE), dod) AS INTEGER) AS days, CASE WHEN date_diff('day', CAST(t0 AS DATE), dod) BETWEEN 0 AND 365 THEN 1 ELSE 0 END AS outcome FROM z LEFT JOIN p USING (subject_id)",
    "censoring_flag": f"WITH {_Z}, a AS (SELECT subject_id, max(dischtime) AS l FROM admissions GROUP BY 1), p AS (SELECT subject_id, max(dod) AS dod FROM patients GROUP BY 1) SELECT z.subject_id, (dod IS NOT NULL OR coalesce(l + INTERVAL 365 DAY >= t0 + INTERVAL 365 DAY, false))::INT AS observed FROM z LEFT JOIN a USING (subject_id) LEFT JOIN p USING (subject_id)",
    "organ_score": """WITH r AS (SELECT DISTINCT * FROM apacheapsvar), x AS (SELECT patientunitstayid, nullif(pao2, -1) / (CASE WHEN nullif(fio2, -1) > 1.5 THEN fio2 / 100 ELSE nullif(fio2, -1) END) AS pf, nullif(bilirubin, -1) AS b, nullif(meanbp, -1) AS m, nullif(creatinine, -1) AS c FROM r)
SELECT patientunitstayid, round(pf, 6) AS pf_ratio, CAST(CASE WHEN pf < 100 THEN 4 WHEN pf < 200 THEN 3 WHEN pf < 300 THEN 2 WHEN pf < 400 THEN 1 ELSE 0 END + CASE WHEN b >= 12 THEN 4 WHEN b >= 6 THEN 3 WHEN b >= 2 THEN 2 WHEN b >= 1.2 THEN 1 ELSE 0 END
  + CASE WHEN m < 70 THEN 1 ELSE 0 END + CASE WHEN c >= 5 THEN 4 WHEN c >= 3.5 THEN 3 WHEN c >= 2 THEN 2 WHEN c >= 1.2 THEN 1 ELSE 0 END AS BIGINT) AS score FROM x""",
    "age_bands": """WITH r AS (SELECT DISTINCT * FROM patient), a AS (SELECT *, CASE WHEN trim(age) LIKE '>%' THEN 90 ELSE try_cast(trim(age) AS DOUBLE) END AS y FROM r)
SELECT CASE WHEN y <= 40 THEN '(0,40]' WHEN y <= 65 THEN '(40,65]' WHEN y <= 80 THEN '(65,80]' WHEN y IS NOT NULL THEN '(80,120]' ELSE 'unknown' END AS band, count(*) AS n, count(*) FILTER (lower(trim(hospitaldischargestatus)) = 'expired' AND hospitaldischargeoffset <= 40320) AS early_deaths FROM a GROUP BY 1""",
    "prefix_flags": "WITH p(system, prefix, family) AS (VALUES ('chart', '2200', 'pressure'), ('chart', '2202', 'breathing'), ('lab', '509', 'chemistry'), ('lab', '5', 'lab'), ('input', '22', 'fluid'), ('output', '226', 'output')), c AS (SELECT modality, type, count(DISTINCT event_id) AS n FROM features GROUP BY 1, 2) SELECT family, CAST(sum(n) AS BIGINT) AS n, count(*) AS codes FROM c JOIN p ON modality = system AND starts_with(type, prefix) GROUP BY 1",
    "keyword_regex": "SELECT coalesce(lower(substr(lang, 1, 2)), 'none') AS lang, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'court|judge|verdict')) AS law, count(*) FILTER (regexp_matches(lower(text), 'surgeon|fever|dosage')) AS medicine, count(*) FILTER (contains(text, '©')) AS footers FROM documents GROUP BY 1",
    "nested_props": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(try_cast(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "compact_times": "SELECT DISTINCT study_id, strftime(date_trunc('second', study_datetime), '%Y-%m-%d %H:%M:%S') AS at FROM cxr_studies WHERE study_id IS NOT NULL",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM c GROUP BY 1""",
    "vector_pool": "WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 5) AS mean, round(max(x), 5) AS max FROM x GROUP BY 1, 2",
    "vector_impute": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), l AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY 1, 2), w AS (SELECT pos, avg(x) AS m FROM x GROUP BY 1)
SELECT CAST(k AS INTEGER) AS label, CAST(w.pos AS INTEGER) AS pos, round(coalesce(l.m, w.m), 5) AS value, l.m IS NOT NULL AS real FROM range(12) t(k) CROSS JOIN w LEFT JOIN l ON l.label = k AND l.pos = w.pos""",
    "fold_counts": "SELECT CAST(floor(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * 5) AS INTEGER) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
    "seeded_sample": "SELECT o_orderkey FROM orders ORDER BY md5('7-' || o_orderkey::VARCHAR), o_orderkey LIMIT 500",
    "integrity": """WITH c AS (SELECT event_id, count(DISTINCT (subject_id, time, type)) AS k FROM features GROUP BY 1), v AS (SELECT vec_id, count(*) AS k FROM embeddings GROUP BY 1), r AS (
  SELECT 'stored before measured' AS "check", count(*) FILTER (storetime < time) AS failures FROM features UNION ALL SELECT 'shard of another subject', count(*) FILTER (shard <> 'p' || substr(subject_id::VARCHAR, 1, 2)) FROM features
  UNION ALL SELECT 'copies that disagree', count(*) FILTER (k > 1) FROM c UNION ALL SELECT 'vector of another length', count(*) FILTER (len(embedding) <> 64) FROM embeddings UNION ALL SELECT 'lab row with a stay', count(*) FILTER (modality = 'lab' AND stay_id IS NOT NULL) FROM features
  UNION ALL SELECT 'time zero without a stay', count(*) FILTER (t0 IS NOT NULL AND stay_id IS NULL) FROM features UNION ALL SELECT 'index with several vectors', count(*) FILTER (k > 1) FROM v
  UNION ALL SELECT 'stay of an unknown subject', count(DISTINCT subject_id) FROM icu_stays WHERE subject_id NOT IN (SELECT subject_id FROM patients WHERE subject_id IS NOT NULL))
SELECT "check", failures, failures = 0 AS passed FROM r""",
}

QUERIES = {f.__name__: f for f in (outcome_horizon, censoring_flag, organ_score, age_bands, prefix_flags, keyword_regex, nested_props, compact_times, session_counts, vector_pool, vector_impute,
                                   fold_counts, seeded_sample, integrity)}
