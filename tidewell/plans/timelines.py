"""Temporal queries over the event stream: containment, look-back, as-of, proximity, crossings, index times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.functions.times import DAY, HOUR, from_micros, micros, second_text
from tidewell.operators.canonical import clean
from tidewell.operators.ranking import percentiles
from tidewell.operators.temporal import asof_backward, first_crossing, first_row, interval_join, last_values, lookback, near_join
from tidewell.plans.event_stream import _F
from tidewell.sources import first_deliveries, table

# Concept name -> types whose values it takes.
CONCEPTS = {"map": ["220052"], "sbp": ["220050"], "hr": ["220045"], "rr": ["220210"], "spo2": ["220277"], "temp_c": ["223762"], "fio2": ["223835"],
            "lactate": ["50813"], "creatinine": ["50912"], "hemoglobin": ["51222"], "glucose": ["50931"]}


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event stream with times in microseconds."""
    rows = first_deliveries(table(spark, sf, "features"), ["subject_id", "stay_id", "time", "modality", "type", "value_num", "urine_output_6h", "is_intervention"])
    return rows.withColumn("at", micros("time")).drop("time")


def zeros(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, t0): distinct time zeros."""
    return table(spark, sf, "features").select("subject_id", micros("t0").alias("t0")).dropna().distinct()


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, stay_id, start, end): distinct stays with a start."""
    return table(spark, sf, "icu_stays").select("subject_id", "stay_id", micros("intime").alias("start"), micros("outtime").alias("end")).where("start is not null").distinct()


def _at(c) -> Column:
    return second_text(from_micros(c))


def interval_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each modality inside each stay of their subject, whether or not they carry the stay's id."""
    inside = interval_join(events(spark, sf).select("event_id", "subject_id", "modality", "at"), stays(spark, sf).withColumnRenamed("stay_id", "in_stay"), ["subject_id"], "at", "start", "end")
    return inside.groupBy("in_stay", "modality").agg(F.count(F.lit(1)).alias("n"), _at(F.min("at")).alias("first_at"))


def near_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Time zeros without a lactate of 4 or more within six hours on either side."""
    high = events(spark, sf).where("type = '50813' and value_num >= 4").select("subject_id", F.col("at").alias("other"))
    near = near_join(zeros(spark, sf), high, ["subject_id"], "t0", "other", 6 * HOUR, 6 * HOUR).select("subject_id", "t0").distinct()
    return zeros(spark, sf).join(near, ["subject_id", "t0"], "left_anti").select("subject_id", _at("t0").alias("t0_at"))


def asof_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Each lactate with the last glucose of its subject in the four hours before (or at the same time)."""
    e = events(spark, sf).where("value_num is not null")
    left = e.where("type = '50813'").select("event_id", "subject_id", "at", F.col("value_num").alias("lactate"))
    right = e.where("type = '50931'").groupBy("subject_id", F.col("at").alias("glucose_at")).agg(F.max("value_num").alias("glucose"))
    got = asof_backward(left, right, ["subject_id"], "at", "glucose_at", "glucose", 4 * HOUR)
    return got.select("event_id", "lactate", "glucose", F.round((F.col("at") - F.col("glucose_at")) / F.lit(6e7), 3).alias("age_min"))


def asof_value(spark: SparkSession, sf: str) -> DataFrame:
    """Each trade event with the last order total of its customer, however old."""
    orders = table(spark, sf, "orders")
    line = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    left = orders.join(line, orders["o_orderkey"] == line["l_orderkey"]).select("o_orderkey", F.col("o_custkey").alias("cust"), micros("first_ship").alias("at"))
    right = orders.select(F.col("o_custkey").alias("cust"), micros("o_orderdate").alias("ordered"), "o_totalprice").groupBy("cust", "ordered").agg(F.max("o_totalprice").alias("total"))
    return asof_backward(left, right, ["cust"], "at", "ordered", "total").select("o_orderkey", "total", F.floor((F.col("at") - F.col("ordered")) / DAY).cast("long").alias("days"))


def lookback_last(spark: SparkSession, sf: str) -> DataFrame:
    """The last cleaned value of each concept in the 48 hours before each time zero, a column for each concept."""
    names = F.create_map(*[F.lit(x) for name, types in CONCEPTS.items() for t in types for x in (t, name)])
    rows = clean(events(spark, sf)).where("keep and value_num is not null").withColumn("concept", F.element_at(names, F.col("type"))).where("concept is not null")
    pairs = lookback(zeros(spark, sf), rows.select("subject_id", "concept", "at", "value_num", "event_id"), ["subject_id"], "t0", "at", 48 * HOUR)
    wide = last_values(pairs, ["subject_id", "t0"], "concept", list(CONCEPTS), "at", "value_num", "event_id")
    return wide.select("subject_id", _at("t0").alias("t0_at"), *CONCEPTS)


def lookback_urine(spark: SparkSession, sf: str) -> DataFrame:
    """Urine in the six hours before each time zero; null where there is no output at all."""
    rows = events(spark, sf).where("modality = 'output' and urine_output_6h is not null").select("subject_id", "at", "urine_output_6h")
    pairs = lookback(zeros(spark, sf), rows, ["subject_id"], "t0", "at", 6 * HOUR)
    sums = pairs.groupBy("subject_id", "t0").agg(F.sum("urine_output_6h").alias("urine"))
    return zeros(spark, sf).join(sums, ["subject_id", "t0"], "left").select("subject_id", _at("t0").alias("t0_at"), "urine")


def lookback_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each time zero has an intervention, an input and a high lactate in the 48 hours before it."""
    rows = events(spark, sf).select("subject_id", "at", "is_intervention", "modality", "type", "value_num")
    pairs = lookback(zeros(spark, sf), rows, ["subject_id"], "t0", "at", 48 * HOUR).groupBy("subject_id", "t0").agg(
        F.bool_or(F.coalesce("is_intervention", F.lit(False))).alias("intervened"), F.bool_or(F.col("modality") == "input").alias("infused"),
        F.coalesce(F.bool_or((F.col("type") == "50813") & (F.col("value_num") >= 4)), F.lit(False)).alias("high_lactate"))
    no = F.lit(False)
    return zeros(spark, sf).join(pairs, ["subject_id", "t0"], "left").select(
        "subject_id", _at("t0").alias("t0_at"), *[F.coalesce(c, no).alias(c) for c in ("intervened", "infused", "high_lactate")])


def running_crossing(spark: SparkSession, sf: str) -> DataFrame:
    """When the fluid given in a stay first reaches one litre."""
    rows = events(spark, sf).where("modality = 'input' and stay_id is not null")
    return first_crossing(rows, ["stay_id"], "at", "value_num", 1000.0, "event_id").select("stay_id", _at("crossed_at").alias("crossed_at"))


def first_stay(spark: SparkSession, sf: str) -> DataFrame:
    """The first stay of each subject."""
    return first_row(stays(spark, sf), ["subject_id"], [F.asc("start"), F.asc("stay_id")]).select("subject_id", "stay_id", _at("start").alias("start_at"))


def dual_route_t0(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier of two routes to an index time: creatinine of 2 or more, or a day after the first output below 100 mL."""
    e = events(spark, sf)
    one = e.where("type = '50912' and value_num between 2 and 20").groupBy("subject_id").agg(F.min("at").alias("t"))
    two = e.where("modality = 'output' and value_num < 100").groupBy("subject_id").agg((F.min("at") + DAY).alias("t"))
    return one.unionByName(two).groupBy("subject_id").agg(_at(F.min("t")).alias("t0_at"), F.count(F.lit(1)).alias("routes"))


def suspected_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Time zeros with an input in the 24 hours and an output in the 48 hours before: an intersection of two look-backs."""
    e, z = events(spark, sf), zeros(spark, sf)
    some = lambda kind, hours: lookback(z, e.where(F.col("modality") == kind).select("subject_id", "at"), ["subject_id"], "t0", "at", hours * HOUR).select("subject_id", "t0")
    return some("input", 24).intersect(some("output", 48)).select("subject_id", _at("t0").alias("t0_at"))


def adaptive_arm(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects by fluid per stay: above 2000 mL, or above the median where that share is outside 30 to 70 percent."""
    total = events(spark, sf).where("modality = 'input' and stay_id is not null").groupBy("stay_id").agg(F.sum("value_num").alias("ml")).where("ml is not null")
    cut = total.agg(F.avg((F.col("ml") < 2000).cast("double")).alias("below")).join(F.broadcast(percentiles(total, [], "ml", {"median": 0.5})))
    limit = F.when(F.col("below").between(0.3, 0.7), 2000.0).otherwise(F.col("median"))
    # One row, whatever the input.
    return total.join(F.broadcast(cut.select(limit.alias("limit")))).select("stay_id", "ml", F.when(F.col("ml") >= F.col("limit"), "active").otherwise("comparator").alias("arm"))


def prior_trigger_arm(spark: SparkSession, sf: str) -> DataFrame:
    """Arm by the last hemoglobin at or before the first input of a subject: 9 or less is active, none is comparator."""
    e = events(spark, sf)
    first = e.where("modality = 'input'").groupBy("subject_id").agg(F.min("at").alias("at"))
    hb = e.where("type = '51222' and value_num between 1.5 and 27").groupBy("subject_id", F.col("at").alias("hb_at")).agg(F.max("value_num").alias("hb"))
    got = asof_backward(first, hb, ["subject_id"], "at", "hb_at", "hb")
    return got.select("subject_id", "hb", F.when(F.col("hb") <= 9, "active").otherwise("comparator").alias("arm"))


def baseline_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Largest creatinine of a stay against the least from seven days before it to its end."""
    lab = events(spark, sf).where("type = '50912' and value_num between 0.05 and 20").select("subject_id", "at", "value_num")
    wide = stays(spark, sf).where("end is not null and end >= start").withColumn("from", F.col("start") - 7 * DAY)
    pairs = interval_join(lab, wide, ["subject_id"], "at", "from", "end")
    return pairs.groupBy("stay_id").agg(F.min("value_num").alias("baseline"), F.max(F.when(F.col("at") >= F.col("start"), F.col("value_num"))).alias("peak")).withColumn(
        "ratio", F.round(F.try_divide("peak", "baseline"), 6))


_Z = f"WITH {_F}, z AS (SELECT DISTINCT subject_id, t0 FROM features WHERE t0 IS NOT NULL AND subject_id IS NOT NULL), st AS (SELECT DISTINCT subject_id, stay_id, intime, outtime FROM icu_stays WHERE intime IS NOT NULL)"
_T = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
_HAVE = "EXISTS (SELECT 1 FROM f WHERE f.subject_id = z.subject_id AND f.time < z.t0 AND f.time >= z.t0 - INTERVAL {} HOUR AND {})".format
_RANGE = "CASE type WHEN '220045' THEN value_num BETWEEN 0 AND 300 WHEN '220210' THEN value_num BETWEEN 0 AND 80 WHEN '220277' THEN value_num BETWEEN 0 AND 100 WHEN '220050' THEN value_num BETWEEN 0 AND 300 WHEN '220052' THEN value_num BETWEEN 0 AND 250 WHEN '223762' THEN value_num BETWEEN 20 AND 45 WHEN '50912' THEN value_num BETWEEN 0 AND 50 WHEN '50931' THEN value_num BETWEEN 0 AND 2000 WHEN '50813' THEN value_num BETWEEN 0 AND 40 WHEN '51222' THEN value_num BETWEEN 0 AND 30 ELSE abs(value_num) <= 1e6 END"

ORACLES = {
    "interval_events": f"{_Z} SELECT st.stay_id AS in_stay, modality, count(*) AS n, {_T('min(time)')} AS first_at FROM f JOIN st ON st.subject_id = f.subject_id AND time >= intime AND (outtime IS NULL OR time <= outtime) GROUP BY 1, 2",
    "near_exclusion": f"{_Z} SELECT subject_id, {_T("z.t0")} AS t0_at FROM z WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.subject_id = z.subject_id AND type = '50813' AND value_num >= 4 AND time BETWEEN z.t0 - INTERVAL 6 HOUR AND z.t0 + INTERVAL 6 HOUR)",
    "asof_tolerance": f"""{_Z}, l AS (SELECT event_id, subject_id, time, value_num AS lactate FROM f WHERE type = '50813' AND value_num IS NOT NULL),
r AS (SELECT subject_id, time, max(value_num) AS glucose FROM f WHERE type = '50931' AND value_num IS NOT NULL GROUP BY 1, 2),
j AS (SELECT l.event_id, l.lactate, r.glucose, epoch_us(l.time) - epoch_us(r.time) AS d FROM l ASOF LEFT JOIN r ON l.subject_id = r.subject_id AND l.time >= r.time)
SELECT event_id, lactate, CASE WHEN d <= 14400000000 THEN glucose END AS glucose, CASE WHEN d <= 14400000000 THEN round(d::DOUBLE / 6e7, 3) END AS age_min FROM j""",
    "asof_value": """WITH l AS (SELECT o_orderkey, o_custkey, min(l_shipdate) AS at FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), r AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_orderkey, total, CAST(floor((epoch_us(l.at) - epoch_us(r.o_orderdate)) / 86400000000.0::DOUBLE) AS BIGINT) AS days FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.at >= r.o_orderdate""",
    "lookback_last": f"""{_Z}, k AS (SELECT *, CASE type WHEN '220052' THEN 'map' WHEN '220050' THEN 'sbp' WHEN '220045' THEN 'hr' WHEN '220210' THEN 'rr' WHEN '220277' THEN 'spo2' WHEN '223762' THEN 'temp_c' WHEN '223835' THEN 'fio2' WHEN '50813' THEN 'lactate' WHEN '50912' THEN 'creatinine' WHEN '51222' THEN 'hemoglobin' WHEN '50931' THEN 'glucose' END AS concept FROM f WHERE value_num IS NOT NULL AND {_RANGE}),
p AS (SELECT z.subject_id, z.t0, concept, value_num, row_number() OVER (PARTITION BY z.subject_id, z.t0, concept ORDER BY k.time DESC, k.event_id DESC) AS n FROM z JOIN k ON k.subject_id = z.subject_id AND k.time < z.t0 AND k.time >= z.t0 - INTERVAL 48 HOUR AND concept IS NOT NULL)
SELECT subject_id, {_T('t0')} AS t0_at, """ + ", ".join(f"max(value_num) FILTER (concept = '{c}') AS {c}" for c in CONCEPTS) + " FROM p WHERE n = 1 GROUP BY subject_id, t0",
    "lookback_urine": f"{_Z} SELECT z.subject_id, {_T('z.t0')} AS t0_at, sum(f.urine_output_6h) AS urine FROM z LEFT JOIN f ON f.subject_id = z.subject_id AND f.modality = 'output' AND f.urine_output_6h IS NOT NULL AND f.time < z.t0 AND f.time >= z.t0 - INTERVAL 6 HOUR GROUP BY z.subject_id, z.t0",
    "lookback_flags": f"{_Z} SELECT subject_id, {_T('t0')} AS t0_at, {_HAVE(48, 'is_intervention')} AS intervened, {_HAVE(48, chr(39).join(['modality = ', 'input', '']))} AS infused, {_HAVE(48, chr(39).join(['type = ', '50813', ' AND value_num >= 4']))} AS high_lactate FROM z",
    "running_crossing": f"{_Z}, c AS (SELECT stay_id, time, sum(value_num) OVER (PARTITION BY stay_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f WHERE modality = 'input' AND stay_id IS NOT NULL) SELECT stay_id, {_T('min(time)')} AS crossed_at FROM c WHERE s >= 1000 GROUP BY 1",
    "first_stay": f"{_Z} SELECT subject_id, stay_id, {_T('intime')} AS start_at FROM st WHERE subject_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) = 1",
    "dual_route_t0": f"""{_Z}, r AS (SELECT subject_id, min(time) AS t FROM f WHERE type = '50912' AND value_num BETWEEN 2 AND 20 GROUP BY 1
  UNION ALL SELECT subject_id, min(time) + INTERVAL 1 DAY FROM f WHERE modality = 'output' AND value_num < 100 GROUP BY 1) SELECT subject_id, {_T('min(t)')} AS t0_at, count(*) AS routes FROM r GROUP BY 1""",
    "suspected_pair": f"{_Z} SELECT subject_id, {_T('t0')} AS t0_at FROM z WHERE {_HAVE(24, chr(39).join(['modality = ', 'input', '']))} AND {_HAVE(48, chr(39).join(['modality = ', 'output', '']))}",
    "adaptive_arm": f"""{_Z}, t AS (SELECT stay_id, sum(value_num) AS ml FROM f WHERE modality = 'input' AND stay_id IS NOT NULL GROUP BY 1 HAVING sum(value_num) IS NOT NULL),
c AS (SELECT CASE WHEN avg((ml < 2000)::INT) BETWEEN 0.3 AND 0.7 THEN 2000 ELSE quantile_cont(ml, 0.5) END AS lim FROM t) SELECT stay_id, ml, CASE WHEN ml >= lim THEN 'active' ELSE 'comparator' END AS arm FROM t, c""",
    "prior_trigger_arm": f"""{_Z}, i AS (SELECT subject_id, min(time) AS time FROM f WHERE modality = 'input' GROUP BY 1), h AS (SELECT subject_id, time, max(value_num) AS hb FROM f WHERE type = '51222' AND value_num BETWEEN 1.5 AND 27 GROUP BY 1, 2)
SELECT i.subject_id, hb, CASE WHEN hb <= 9 THEN 'active' ELSE 'comparator' END AS arm FROM i ASOF LEFT JOIN h ON i.subject_id = h.subject_id AND i.time >= h.time""",
    "baseline_ratio": f"""{_Z}, p AS (SELECT stay_id AS s, intime, f.time, value_num FROM (SELECT subject_id, time, value_num FROM f WHERE type = '50912' AND value_num BETWEEN 0.05 AND 20) f JOIN st ON st.subject_id = f.subject_id AND outtime >= intime AND f.time BETWEEN intime - INTERVAL 7 DAY AND outtime)
SELECT s AS stay_id, min(value_num) AS baseline, max(value_num) FILTER (time >= intime) AS peak, round(max(value_num) FILTER (time >= intime) / min(value_num), 6) AS ratio FROM p GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (interval_events, near_exclusion, asof_tolerance, asof_value, lookback_last, lookback_urine, lookback_flags, running_crossing, first_stay,
                                   dual_route_t0, suspected_pair, adaptive_arm, prior_trigger_arm, baseline_ratio)}
