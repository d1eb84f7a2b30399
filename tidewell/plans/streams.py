"""The streaming operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.times import from_micros, second_text
from tidewell.operators.canonical import SOURCES
from tidewell.streaming import crossings, daily_counts, ingest


def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Kept and dropped events by modality after a streamed ingest; a repeated delivery counts once."""
    return ingest(spark, f"{sf}/features.parquet", SOURCES["features"]).groupBy("modality").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events and values by finished day and type from a windowed stream."""
    return daily_counts(spark, f"{sf}/events.parquet", "ts", "event_type", "value").select("day", "kind", "n", F.round("total", 4).alias("total"))


def stream_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """When the values of a user first add up to 2000, from keyed state."""
    return crossings(spark, f"{sf}/events.parquet", "user_id", "ts", "value", 2000.0).select("user_id", second_text(from_micros("crossed_us")).alias("crossed_at"))


ORACLES = {
    "stream_clean": """WITH r(type, lo, hi) AS (VALUES ('220045',0,300),('220210',0,80),('220277',0,100),('220050',0,300),('220052',0,250),('223762',20,45),('50912',0,50),('50931',0,2000),('50813',0,40),('51222',0,30)),
k AS (SELECT modality, CASE WHEN modality NOT IN ('chart','lab') THEN true WHEN r.type IS NOT NULL THEN value_num IS NOT NULL AND value_num BETWEEN lo AND hi ELSE value_num IS NULL OR abs(value_num) <= 1e6 END AS keep FROM (SELECT * FROM features WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY storetime) = 1) f LEFT JOIN r USING (type))
SELECT modality, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM k GROUP BY 1""",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2",
    "stream_crossings": "WITH c AS (SELECT user_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS crossed_at FROM c WHERE s >= 2000 GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (stream_clean, stream_windows, stream_crossings)}
