"""Running sums, ranks and rank statistics over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewell.operators.estimate import hash_unit, poisson_weight
from tidewell.session import cut


def running_sums(df: DataFrame, order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """`df` with run_<v> for each value: its sum over all rows up to and including this one.

    Rows are range-partitioned by `order` (which must be unique, e.g. after a groupBy) and summed
    within their part; what the parts before add up to, one row for each part, is added. The
    range partitioning is written down first, since it samples.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part: at most `n`.
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.join(F.broadcast(offsets), "_part")
    run = run.withColumns({f"run_{v}": F.sum(v).over(upto) + F.col(f"_o_{v}") for v in values})
    return run.drop("_part", *[f"_o_{v}" for v in values])


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): exact percentiles of a column in each group, interpolated; nulls are left out.

    They are read off running sums over all (group, value), so that no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    run = cut(running_sums(counts, [*by, value], ["n"]))
    whole = run.groupBy(*[F.col(k).alias(f"_k_{k}") for k in by]).agg(F.sum("n").alias("_n"), F.min(F.col("run_n") - F.col("n")).alias("_o"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = run.join(whole, same) if by else run.join(F.broadcast(whole))
    upto, out = F.col("run_n") - F.col("_o"), []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_n") - 1)
        at = lambda i: F.max(F.when((upto > i) & (upto - F.col("n") <= i), F.col(value)))
        rest = F.max(place - F.floor(place))
        out.append(((1 - rest) * at(F.floor(place)) + rest * at(F.ceil(place))).alias(name))
    return own.groupBy(*by).agg(*out)


def mean_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """(value, n, rank): the mean rank of each distinct value, ties sharing theirs; nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, [value], ["n"]).select(value, "n", (F.col("run_n") - (F.col("n") - 1) / 2.0).alias(rank))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n_pos, n_neg, auroc): area under the ROC curve, ties counted half; null with one class only."""
    return _curve(df, score, label)[0]


def _curve(df: DataFrame, score: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The ROC summary, and positives and negatives up to each distinct score."""
    clean = df.select(F.col(score).alias("_score"), F.col(label).cast("long").alias("_label")).dropna()
    at = clean.groupBy("_score").agg(F.sum("_label").alias("pos"), F.sum(1 - F.col("_label")).alias("neg"))
    run = running_sums(at, ["_score"], ["pos", "neg"])
    total = run.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                    F.sum(F.col("pos").cast("double") * (F.col("run_neg") - F.col("neg") / 2.0)).alias("_won"))
    roc = total.select("n_pos", "n_neg", F.try_divide("_won", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))
    return roc, run


def auc_by(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, n_pos, n_neg, auroc) of each group, from one pass of running sums over all (group, score); null with one class only.

    Rows with a null score, label or group are left out.
    """
    clean = df.select(*by, F.col(score).alias("_score"), F.col(label).cast("long").alias("_label")).dropna()
    at = clean.groupBy(*by, "_score").agg(F.sum("_label").alias("pos"), F.sum(1 - F.col("_label")).alias("neg"))
    run = cut(running_sums(at, [*by, "_score"], ["pos", "neg"]))
    whole = run.groupBy(*by).agg(F.min(F.col("run_neg") - F.col("neg")).alias("_before"))
    below = F.col("run_neg") - F.col("_before") - F.col("neg") / 2.0
    total = run.join(whole, by).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos").cast("double") * below).alias("_won"))
    return total.select(*by, "n_pos", "n_neg", F.try_divide("_won", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n_pos, average_precision): precision at each distinct score, weighted by the recall it adds."""
    _, run = _curve(df, score, label)
    # Thresholds go from the largest score down.
    whole = run.agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    down = run.join(F.broadcast(whole)).withColumn("tp", F.col("_pos") - F.col("run_pos") + F.col("pos")).withColumn("fp", F.col("_neg") - F.col("run_neg") + F.col("neg"))
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    return down.agg(F.first("_pos").alias("n_pos"), F.sum(precision * F.try_divide("pos", "_pos")).alias("average_precision"))


def resampled_curves(df: DataFrame, score: str, label: str, cluster: str, replicates: int, seed: int = 1) -> DataFrame:
    """(b, auroc, average_precision): both areas in each resample of clusters; null with one class only.

    Replicates stand one after the other in one order of (b, score), so that the running sums are
    shared by all tasks; what lies before a replicate is taken off again.
    """
    clean = df.select(F.col(cluster).alias("_c"), F.col(score).alias("_score"), F.col(label).cast("long").alias("_label")).dropna()
    each = clean.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", poisson_weight(hash_unit(F.lit(seed), F.col("b"), F.col("_c"))).cast("long"))
    at = each.where("_w > 0").groupBy("b", "_score").agg(F.sum(F.col("_w") * F.col("_label")).alias("pos"), F.sum(F.col("_w") * (1 - F.col("_label"))).alias("neg"))
    run = cut(running_sums(at, ["b", "_score"], ["pos", "neg"]))
    # One row for each replicate.
    whole = run.groupBy("b").agg(*[f.alias(f"_{k}_{c}") for c in ("pos", "neg") for k, f in (("n", F.sum(c)), ("o", F.min(F.col(f"run_{c}") - F.col(c))))])
    own = run.join(F.broadcast(whole), "b").withColumns({f"run_{c}": F.col(f"run_{c}") - F.col(f"_o_{c}") for c in ("pos", "neg")})
    tp, fp = (F.col(f"_n_{c}") - F.col(f"run_{c}") + F.col(c) for c in ("pos", "neg"))
    won = F.sum(F.col("pos").cast("double") * (F.col("run_neg") - F.col("neg") / 2.0))
    return own.groupBy("b").agg(F.try_divide(won, F.first("_n_pos").cast("double") * F.first("_n_neg")).alias("auroc"),
                                F.sum(F.try_divide(tp.cast("double"), tp + fp) * F.try_divide("pos", "_n_pos")).alias("average_precision"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): rank correlation with mean ranks for ties; rows with a null are left out."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    pairs = both.join(mean_ranks(both, x, "_rx").drop("n"), x).join(mean_ranks(both, y, "_ry").drop("n"), y)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def adjusted_p(df: DataFrame, p: str, key: str) -> DataFrame:
    """`df` with q: Benjamini-Hochberg adjusted p-values over all rows with a p; ties in p by `key`, which is unique.

    The adjusted value of a rank is the least p * n / rank at it or above; it is found with a running
    minimum from the largest p down, part by part.
    """
    have = df.where(F.col(p).isNotNull()).withColumn("_one", F.lit(1))
    ranked = running_sums(have, [p, key], ["_one"])
    total = ranked.agg(F.count(F.lit(1)).alias("_n"))
    raw = cut(ranked.join(F.broadcast(total)).withColumn("_raw", F.col(p) * F.col("_n") / F.col("run__one")).repartitionByRange(p, key).withColumn("_part", F.spark_partition_id()))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part.
    least = raw.groupBy("_part").agg(F.min("_raw").alias("_low")).select("_part", F.min("_low").over(above).alias("_above"))
    down = Window.partitionBy("_part").orderBy(F.desc("run__one")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.min("_raw").over(down), F.col("_above"), F.lit(1.0))
    return raw.join(F.broadcast(least), "_part").withColumn("q", q).drop("_one", "run__one", "_n", "_raw", "_part", "_above")
