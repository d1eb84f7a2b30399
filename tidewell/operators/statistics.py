"""Statistics of estimated effects as column expressions and aggregates; effects are in percentage points."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

Z95 = NormalDist().inv_cdf(0.975)
#: (z of 97.5 percent + z of 80 percent): standard errors that an effect must reach to be detected with 80 percent power.
DETECTABLE = Z95 + NormalDist().inv_cdf(0.80)


def influence_summary(psi: str, keep: str) -> list[Column]:
    """point, se, low, high, mde and n of an influence column over the rows to keep."""
    x = F.when(F.col(keep), F.col(psi))
    point, se = F.avg(x) * 100, F.stddev_samp(x) / F.sqrt(F.count(x)) * 100
    return [point.alias("point"), se.alias("se"), (point - Z95 * se).alias("low"), (point + Z95 * se).alias("high"), (DETECTABLE * se).alias("mde"), F.count(x).alias("n")]


def divergence_z(point: Column, se: Column, trial: Column, low: Column, high: Column) -> Column:
    """Distance of an estimate from a trial's in joint standard errors; null without spread."""
    joint = F.sqrt(se * se + F.pow((high - low) / (2 * Z95), 2))
    return F.try_divide(point - trial, F.when(joint > 0, joint))


def overlaps(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two intervals share a point; null if a bound is missing."""
    return (low <= other_high) & (other_low <= high)


def e_value(effect: Column, baseline: Column) -> Column:
    """Strength of unmeasured confounding that could explain an effect away, on the risk-ratio scale.

    Null if the baseline risk or the risk with the effect isn't strictly between 0 and 100 percent.
    """
    p0 = baseline / 100
    p1 = p0 + effect / 100
    fine = (p0 > 0) & (p0 < 1) & (p1 > 0) & (p1 < 1)
    ratio = F.when(fine, p1 / F.when(p0 > 0, p0))
    up = F.when(ratio < 1, F.try_divide(F.lit(1.0), ratio)).otherwise(ratio)
    return up + F.sqrt(up * (up - 1))


def e_value_limit(low: Column, high: Column, baseline: Column) -> Column:
    """E-value of the bound nearer to zero; 1 if the interval holds zero."""
    return F.when((low <= 0) & (high >= 0), F.lit(1.0)).when(low.isNotNull() & high.isNotNull(), e_value(F.when(F.abs(low) < F.abs(high), low).otherwise(high), baseline))


def two_sided_p(value: str) -> Column:
    """Bootstrap p-value of zero over replicates: within [1/n, 1]; 1 without replicates."""
    above, below = F.avg((F.col(value) >= 0).cast("double")), F.avg((F.col(value) <= 0).cast("double"))
    n = F.count(value)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(2 * F.least(above, below), F.try_divide(F.lit(1.0), n))))


def replicate_summary(value: str) -> list[Column]:
    """mean, std (0 for one replicate), low and high (2.5 and 97.5 percent, interpolated) of replicates."""
    return [F.avg(value).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("std"),
            F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high")]


def balance(df: DataFrame, covariates: list[str], arm: str, weight: str) -> DataFrame:
    """(covariate, smd_before, smd_after, filled): standardised mean differences between the arms.

    The scale is the pooled unweighted standard deviation in both. Missing values are left out,
    covariate by covariate; a covariate without spread has null.
    """
    long = df.select(F.col(arm).alias("_a"), F.col(weight).alias("_w"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])))
    mean = lambda a: F.avg(F.when(F.col("_a") == a, F.col("x")))
    var = lambda a: F.var_samp(F.when(F.col("_a") == a, F.col("x")))
    have = F.col("x").isNotNull()
    weighted = lambda a: F.try_divide(F.sum(F.when(have & (F.col("_a") == a), F.col("x") * F.col("_w"))), F.sum(F.when(have & (F.col("_a") == a), F.col("_w"))))
    spread = F.sqrt((var(1) + var(0)) / 2)
    spread = F.when(spread > 0, spread)
    return long.groupBy("covariate").agg(
        F.try_divide(mean(1) - mean(0), spread).alias("smd_before"), F.try_divide(weighted(1) - weighted(0), spread).alias("smd_after"),
        F.avg(have.cast("double")).alias("filled"))


def positivity_cost(structured: Column, with_block: Column) -> Column:
    """Share of the effective sample that a block of features costs; null without effective sample."""
    return F.round(1 - F.try_divide(with_block, F.when(structured > 0, structured)), 3)


def verdict(gain_treatment: Column, gain_outcome: Column, cost: Column, least: float = 2.0, most: float = 0.15) -> tuple[Column, Column]:
    """(accept, reason) of adding a block of features, from what it adds on both channels and what it costs."""
    no = F.lit(False)
    treats, predicts, pays = (F.coalesce(c, no) for c in (gain_treatment >= least, gain_outcome >= least, cost <= most))
    reason = (
        F.when(treats & predicts & pays, "informative on both channels at an acceptable cost").when(~treats & ~predicts, "redundant on both channels")
        .when(~treats, "outcome only: precision, not confounding").when(~predicts, "treatment only: like an instrument").otherwise("informative but too costly")
    )
    return treats & predicts & pays, reason
