"""Queries of the text operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm import subjects
from tidewell.llm.packing import pack
from tidewell.llm.tokenizer import encode_texts
from tidewell.session import cut
from tidewell.sources import table


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, ids): one row for each document."""
    return encode_texts(table(spark, sf, "documents"), "text", ["doc_id"])


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """(pack_name, doc_id, piece, start, length, container): every document in containers of each capacity."""
    sizes = cut(encode_texts(table(spark, sf, "documents"), "text", ["doc_id"], count_only=True))
    return pack(sizes, table(spark, sf, "pack_capacity"), "doc_id", "n_tokens")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens, and the share of the capacity that is used, for each pack."""
    bins = p8_containers(spark, sf).groupBy("pack_name", "container").agg(F.sum("length").alias("used"))
    caps = table(spark, sf, "pack_capacity").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    return bins.join(F.broadcast(caps), "pack_name").groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("filled"))


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """For each pack: documents that are placed, containers over the capacity, documents cut without need, and tokens that are lost or placed twice."""
    sizes = cut(encode_texts(table(spark, sf, "documents"), "text", ["doc_id"], count_only=True))
    packs = table(spark, sf, "pack_capacity").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    placed = cut(pack(sizes, table(spark, sf, "pack_capacity"), "doc_id", "n_tokens"))
    bins = placed.groupBy("pack_name", "container").agg(F.sum("length").alias("used")).join(F.broadcast(packs), "pack_name").groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over"))
    each = placed.groupBy("pack_name", "doc_id").agg(F.sum("length").alias("got"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("length")).alias("end"))
    each = each.join(sizes, "doc_id", "full").join(F.broadcast(packs), "pack_name")
    wrong = (F.col("got") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))
    return each.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("torn"), F.count_if(wrong).alias("wrong")).join(bins, "pack_name")


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    # A handful of names by nature.
    areas = sorted(r.area for r in table(spark, sf, "subject_areas").where("area is not null").select("area").distinct().collect())
    return subjects.subject_areas(documents, table(spark, sf, "area_labels"), areas)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, area): one or two areas of each document that has its own content."""
    return _assigned(spark, sf).select("doc_id", "area").distinct()


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and characters by area; a document with two areas counts for both."""
    size = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    return _assigned(spark, sf).join(size, "doc_id").groupBy("area").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"), F.round(F.avg("topic_share"), 6).alias("mean_topic_share"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check}
ORACLES = {
    "p8_check": """SELECT DISTINCT pack_name, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) AS documents, 0::BIGINT AS torn, 0::BIGINT AS wrong, 0::BIGINT AS "over"
FROM pack_capacity WHERE (SELECT count(*) FROM documents WHERE length(text) > 0) > 0""",
}
