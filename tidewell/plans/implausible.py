"""Problem 3: vital signs that can't be true."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import micros
from tidewell.operators.spikes import score_readings
from tidewell.operators.units import to_common
from tidewell.sources import table

# The vital signs, and the least step of each that counts as typical, in the common unit.
VITALS = {"220045": 1.5, "220052": 1.5, "220050": 1.5, "220210": 0.8, "220277": 0.4, "223762": 0.12}


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, score, reason) of every reading of the vital signs, in common units."""
    features = table(spark, sf, "features").where(F.col("type").isin(*VITALS) & F.col("value_num").isNotNull())
    items = table(spark, sf, "item_dim")
    # One row for each of the few types.
    floors = spark.createDataFrame(sorted(VITALS.items()), "type string, floor double")
    limits = items.dropDuplicates(["type"]).select("type", "lo", "hi").join(floors, "type")
    rows = to_common(features.select("event_id", "stay_id", "type", "time", "storetime", "value_num", "value_txt", "uom"), items)
    # Tested on the unit, not on the value: a filter on a computed value would compute it twice.
    rows = rows.where("common_unit is not null").join(F.broadcast(limits), "type")
    readings = rows.select(
        F.col("event_id").alias("row_id"), F.when(F.col("stay_id").isNotNull(), F.struct("stay_id", "type")).alias("source"),
        micros("time").alias("at_us"), micros("storetime").alias("stored_us"), F.round("common_value", 6).alias("value"),
        F.col("common_value").between(F.col("lo"), F.col("hi")).alias("possible"), "floor")
    return score_readings(readings).withColumnRenamed("row_id", "event_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id): readings that are impossible, spikes or part of a stuck run."""
    return judged(spark, sf).where("reason is not null").select("event_id").distinct()


def p3_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Readings and mean score by reason."""
    return judged(spark, sf).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


ORACLES: dict[str, str] = {}
QUERIES = {"p3_found": p3_found, "p3_reasons": p3_reasons}
