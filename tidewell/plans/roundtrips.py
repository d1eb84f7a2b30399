"""Tables written and read again: delimited text, partitioned events, result tables, file listings."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewell.operators.canonical import SOURCES, canonical
from tidewell.session import cut, shared_folder
from tidewell.sources import table
from tidewell.sources.readers import delimited, images, modality, partitions, templated
from tidewell.sources.sinks import Results, write_delimited, write_events


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Line items through gzip CSV with a header, read with a schema and three of its columns: rows and sums by flag."""
    path, items = _folder(spark, "csv"), table(spark, sf, "lineitem")
    write_delimited(items, path)
    back = delimited(spark, path, items.schema, ["l_returnflag", "l_quantity", "l_shipdate"])
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_day"))


def _events(spark: SparkSession, sf: str) -> str:
    path = _folder(spark, "events")
    write_events(canonical(table(spark, sf, "features"), SOURCES["features"]), path)
    return path


def event_table(spark: SparkSession, sf: str) -> DataFrame:
    """Events by modality and shard: the laboratory's of two types, read with partition pruning and a filter in the scan, by shard."""
    lab = modality(spark, _events(spark, sf), "lab", ["50912", "50931"], ["shard", "type", "value_num"])
    return lab.groupBy("shard", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value_num"), 6).alias("mean"))


def event_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of the written event table that hold files, and events of subjects below them."""
    path = _events(spark, sf)
    back = spark.read.parquet(path)
    files = partitions(back, "shard").select("shard", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))
    return files.join(back.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard")


def results_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A result table over several runs: templates, two appends, and the replacement of one key, twice, leave what one replacement leaves."""
    schema = StructType.fromDDL("mode string, priority string, n bigint, note string")
    store = Results(spark, _folder(spark, "results"), {"counts": schema})
    store.templates()
    orders = table(spark, sf, "orders")
    counts = orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    store.append("counts", counts.withColumn("mode", F.lit("all")))
    store.append("counts", counts.withColumn("mode", F.lit("draft")).withColumn("note", F.lit("old")))
    done = orders.where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit("draft"))
    for _ in range(2):
        store.replace("counts", done, mode="draft", priority=["1-URGENT", "2-HIGH", None])
    return cut(store.read("counts"))


def binary_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of the given tables as bytes: name, and whether their length is that of their content and they begin as Parquet does."""
    files = images(spark, sf, "*.parquet")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (F.length("content") == F.col("length")).alias("whole"), (F.substring("content", 1, 4) == F.lit(b"PAR1")).alias("parquet"))


def study_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where the files of each study lie, from a template: none where a part is missing."""
    studies = table(spark, sf, "cxr_studies").distinct()
    return templated(studies, "files/{shard}/p{subject_id}/s{study_id}.txt").select("subject_id", "study_id", "path").distinct()


_FIRST = "f AS (SELECT * FROM features WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY storetime) = 1)"
ORACLES = {
    "csv_round_trip": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day FROM lineitem GROUP BY 1",
    "event_table": f"WITH {_FIRST} SELECT 'p' || substr(subject_id::VARCHAR, 1, 2) AS shard, type, count(*) AS n, round(avg(value_num), 6) AS mean FROM f WHERE modality = 'lab' AND type IN ('50912', '50931') GROUP BY 1, 2",
    "event_shards": f"WITH {_FIRST} SELECT 'p' || substr(subject_id::VARCHAR, 1, 2) AS shard, true AS has_files, true AS has_bytes, count(*) AS n FROM f WHERE subject_id IS NOT NULL GROUP BY 1",
    "results_round_trip": """WITH c AS (SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT 'all' AS mode, priority, n, NULL::VARCHAR AS note FROM c UNION ALL SELECT 'draft', priority, n, 'old' FROM c WHERE priority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'draft', priority, f, NULL FROM c WHERE f > 0 AND priority IN ('1-URGENT', '2-HIGH')""",
    "study_paths": "SELECT DISTINCT subject_id, study_id, 'files/' || shard || '/p' || subject_id || '/s' || study_id || '.txt' AS path FROM cxr_studies",
}
QUERIES = {f.__name__: f for f in (csv_round_trip, event_table, event_shards, results_round_trip, binary_files, study_paths)}
