"""Readers: delimited text with a schema, partitioned event tables, files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def delimited(spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """A CSV table (plain or gzip) with a header, read with the given schema and only the wanted columns.

    A gzip file can't be split, so that one task reads it; `parts` spreads its rows afterwards.
    Fields that can't be read as their type are null, and so are rows that are too short.
    """
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.select(*columns) if columns else rows
    return rows.repartition(parts) if parts else rows


def modality(spark: SparkSession, base: str, name: str, types: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Events of one modality from a table partitioned by modality and shard: the partition is pruned, `types` reaches the scan."""
    rows = spark.read.parquet(base).where(F.col("modality") == name)
    rows = rows.where(F.col("type").isin([str(t) for t in types])) if types else rows
    return rows.select(*columns) if columns else rows


def partitions(df: DataFrame, column: str) -> DataFrame:
    """(column, files, bytes) of each partition value of a file table."""
    files = df.select(column, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct()
    return files.groupBy(column).agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))


def images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def templated(df: DataFrame, template: str, column: str = "path") -> DataFrame:
    """`df` with a text made from a template whose `{name}` parts are columns; a null part gives null."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)]
    return df.withColumn(column, F.concat(*pieces))

