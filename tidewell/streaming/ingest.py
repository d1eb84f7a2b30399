"""The event stream as a stream: the operators of the batch plans on files as they arrive.

All queries run on what is there and then stop (trigger availableNow); with another trigger
they go on. Progress and state are kept in a checkpoint folder, so a stopped query goes on
where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from tidewell.operators.canonical import canonical, clean
from tidewell.session import shared_folder


def _source(spark: SparkSession, path: str) -> DataFrame:
    # As a pattern the path may be a single file as well as a folder of files.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(pattern)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def ingest(spark: SparkSession, path: str, spec: dict[str, str], out: str | None = None, late: str = "60 days") -> DataFrame:
    """Events of a file table, in canonical form and cleaned, appended to a table by modality; returns the table.

    `spec` as for canonical(). With `_once` a repeated delivery counts once, as long as it is stored
    less than `late` after the first one; that bounds the state. Rows without an id are left out then.
    """
    out = out or _folder(spark, "events")
    rows = _source(spark, path)
    if "_once" in spec:
        stored = F.coalesce(*[F.col(c).cast("timestamp") for c in (spec["_stored"], spec["time"])], F.lit("1970-01-01").cast("timestamp"))
        rows = rows.where(F.col(spec["_once"]).isNotNull()).withColumn("_at", stored).withWatermark("_at", late).dropDuplicatesWithinWatermark([spec["_once"]])
    rows = clean(canonical(rows, {k: v for k, v in spec.items() if not k.startswith("_")}))
    query = rows.writeStream.format("parquet").partitionBy("modality").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)


def daily_counts(spark: SparkSession, path: str, at: str, kind: str, value: str, late: str = "2 days") -> DataFrame:
    """(day, kind, n, total) of the finished days: those that end at least `late` before the latest event.

    A day is appended once, when the watermark has passed its end, and its state is dropped; rows that come
    later than that don't count. Rows without a time belong to no day.
    """
    out = _folder(spark, "windows")
    windows = _source(spark, path).withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).groupBy(F.window("_at", "1 day"), F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    rows = windows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kind", "n", "total")
    query = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def crossings(spark: SparkSession, path: str, key: str, at: str, value: str, threshold: float) -> DataFrame:
    """(key, crossed_us): when the running total of a key first reaches the threshold, from keyed state.

    The state of a key is its total and whether it has crossed. Rows of a batch are taken in the
    order of time, rows at one time together; rows older than those of earlier batches count when they
    arrive. A key that has crossed costs nothing more.
    """
    out = _folder(spark, "crossings")
    kind = dict(spark.read.parquet(path).dtypes)[key]

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, crossed = state.get if state.exists else (0.0, False)
        if crossed:
            for _ in frames:
                pass
        else:
            # Each batch of rows is reduced to one sum for each time as it comes.
            sums = pd.Series(dtype=float)
            for pdf in frames:
                part = pdf.fillna({"value": 0.0}).groupby("at")["value"].sum()
                sums = part if sums.empty else sums.add(part, fill_value=0.0)
            run = total + sums.sort_index().cumsum()
            over = run.index[run >= threshold]
            if len(over):
                crossed = True
                yield pd.DataFrame({"key": [name[0]], "crossed_us": [int(over[0])]})
            total = float(run.iloc[-1]) if len(run) else total
        state.update((total, crossed))

    rows = _source(spark, path).select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value")).where("key is not null and at is not null")
    found = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, crossed_us bigint", "total double, crossed boolean", "append", "NoTimeout")
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(f"key {kind}, crossed_us bigint").parquet(out).withColumnRenamed("key", key)
