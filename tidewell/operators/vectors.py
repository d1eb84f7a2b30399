"""Element-wise pooling of vectors kept as arrays."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F


def pool(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key, pos, mean, max) of each position over the vectors of a key; null vectors and elements are left out.

    Vectors are summed as they are, with map-side combine; only one row for each key is written out by
    position. Shorter vectors count for the positions they have; a position with null elements only has nulls.
    """
    rows = df.where(F.col(vector).isNotNull()).select(*key, F.col(vector).cast("array<double>").alias("_v"), F.size(vector).alias("_size"))
    width = rows.agg(F.max("_size")).first()[0] or 0
    if not width:
        return rows.select(*key, F.lit(0).alias("pos"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("max")).where(F.lit(False))
    every = F.sequence(F.lit(0), F.lit(width - 1))
    filled = lambda there, other: array_to_vector(F.transform(every, lambda i: F.coalesce(there(F.get("_v", i)), F.lit(other))))
    value, have, top = filled(lambda x: x, 0.0), filled(lambda x: x.isNotNull().cast("double"), 0.0), filled(lambda x: x, float("-inf"))
    sums = rows.groupBy(*key).agg(Summarizer.sum(value).alias("_s"), Summarizer.sum(have).alias("_n"), Summarizer.max(top).alias("_m"), F.max("_size").alias("_size"))
    one = sums.select(*key, "_size", F.posexplode(F.arrays_zip(*[vector_to_array(c).alias(c) for c in ("_s", "_n", "_m")])).alias("pos", "_x"))
    n = F.round("_x._n")
    return one.where(F.col("pos") < F.col("_size")).select(*key, "pos", F.try_divide("_x._s", n).alias("mean"), F.when(n > 0, F.col("_x._m")).alias("max"))


def pooled_array(df: DataFrame, key: list[str], vector: str, how: str = "mean") -> DataFrame:
    """(key, vector): the pooled vector as an array<double>."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", how)))
    return pool(df, key, vector).groupBy(*key).agg(F.transform(ordered, lambda s: s[how]).alias(vector))


def impute(wanted: DataFrame, pooled: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """(key, pos, value, real): the pooled value of each wanted key, or the mean over all vectors where it has none.

    `whole` has one row for each position.
    """
    have = pooled.select(key).distinct().withColumn("real", F.lit(True))
    marked = wanted.select(key).distinct().join(have, key, "left").withColumn("real", F.coalesce("real", F.lit(False)))
    got = marked.where("real").join(pooled.select(key, "pos", F.col("mean").alias("value")), key)
    # As many rows as a vector has positions.
    filled = marked.where("not real").join(F.broadcast(whole.select("pos", F.col("mean").alias("value"))))
    return got.select(key, "pos", "value", "real").unionByName(filled.select(key, "pos", "value", "real"))
