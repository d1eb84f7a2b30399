"""Table readers and the rule for repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def first_deliveries(df: DataFrame, columns: list[str], key: str = "event_id", stored: str = "storetime") -> DataFrame:
    """One row per `key`: the delivery with the least `stored`, with `columns` of that row.

    A null `stored` counts as latest. Equal deliveries are broken by the values of
    `columns` themselves, so the result doesn't depend on row order. Rows with a null
    key are dropped: without an id a row can't be told from its copies.
    """
    last = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    order = F.struct(F.coalesce(F.col(stored).cast("timestamp_ntz"), last), *[F.col(c) for c in columns])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return best.select(key, *[F.col("_first")[c].alias(c) for c in columns])
