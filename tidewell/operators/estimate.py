"""Cross-fitted doubly robust effect estimates over rows (id, cluster, a, y, d, covariates).

a is the arm, y the outcome and d whether the outcome was observed. Folds come from a hash of
the id, so that they are the same in every engine and run. Nuisance models are either the
other folds' rates (optionally within strata), which is plain aggregation, or logistic
regressions fitted by Newton steps, all at once, whose sums Spark adds up; only matrices of the size of the
covariates reach the driver. What follows is arithmetic on columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.session import cut, ship


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the md5 of the parts, joined with `-`."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fold(key: str, folds: int = 5) -> Column:
    """Fold 0..folds-1 of a row."""
    return F.floor(hash_unit(F.col(key)) * folds).cast("int")


def rate_nuisances(df: DataFrame, folds: int = 5, strata: list[str] | None = None) -> DataFrame:
    """`df` with e, m1, m0, kc: rates over the rows of all other folds (within strata, if given).

    A stratum without rows to learn from gets the rates of all strata.
    """
    df = df.withColumn("fold", fold("id", folds))
    sums = {"n": F.count(F.lit(1)), "sa": F.sum("a"), "sd": F.sum("d")}
    for arm in (1, 0):
        seen = (F.col("a") == arm) & (F.col("d") == 1)
        sums |= {f"n{arm}": F.count_if(seen), f"y{arm}": F.sum(F.when(seen, F.col("y")).otherwise(0))}

    def rates(keys: list[str], tag: str) -> DataFrame:
        own = df.groupBy(*keys, "fold").agg(*[c.alias(k) for k, c in sums.items()])
        total = own.groupBy(*keys).agg(*[F.sum(k).alias(f"t_{k}") for k in sums]) if keys else own.agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
        # As many rows as strata and folds; a stratum that lacks a fold learns from all of its rows.
        grid = total.join(df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")))
        full = grid.join(own, [*keys, "fold"], "left")
        rest = {k: F.col(f"t_{k}") - F.coalesce(F.col(k), F.lit(0)) for k in sums}
        share = lambda x, y: F.try_divide(rest[x].cast("double"), rest[y])
        return full.select(*keys, "fold", share("sa", "n").alias(f"{tag}e"), share("y1", "n1").alias(f"{tag}m1"), share("y0", "n0").alias(f"{tag}m0"), share("sd", "n").alias(f"{tag}kc"))

    out = df.join(F.broadcast(rates([], "g_")), "fold", "left")
    if strata:
        out = out.join(rates(strata, "s_"), [*strata, "fold"], "left")
    pick = lambda k: F.coalesce(F.col(f"s_{k}"), F.col(f"g_{k}"), F.lit(0.0)) if strata else F.coalesce(F.col(f"g_{k}"), F.lit(0.0))
    return out.withColumns({k: pick(k) for k in ("e", "m1", "m0", "kc")}).drop(*[f"{t}{k}" for t in ("g_", "s_") for k in ("e", "m1", "m0", "kc")])


def influence(df: DataFrame, trim: float = 0.02) -> DataFrame:
    """`df` (a, y, d, e, m1, m0, kc) with psi, psi_ato, h, w and keep.

    psi is the augmented inverse-probability influence value, with inverse weights for observed
    outcomes; psi_ato and h are its overlap-weighted form; keep leaves out rows beyond the trim.
    """
    e = F.least(F.greatest(F.col("e"), F.lit(1e-6)), F.lit(1 - 1e-6))
    kc = F.least(F.greatest(F.col("kc"), F.lit(trim)), F.lit(1.0))
    rows = df.withColumn("e", e).withColumn("kc", kc).withColumn("_cw", F.col("d") / F.col("kc"))
    a, y, e, m1, m0, cw = (F.col(c) for c in ("a", "y", "e", "m1", "m0", "_cw"))
    return rows.withColumns({
        "psi": (m1 - m0) + cw * (a * (y - m1) / e - (1 - a) * (y - m0) / (1 - e)),
        "h": e * (1 - e),
        "psi_ato": e * (1 - e) * (m1 - m0) + cw * (a * (1 - e) * (y - m1) - (1 - a) * e * (y - m0)),
        "w": F.when(a == 1, 1 / e).otherwise(1 / (1 - e)),
        "keep": (e > trim) & (e < 1 - trim),
    }).drop("_cw")


def effective_size(weight: str, keep: str) -> Column:
    """(sum of weights)^2 / sum of squared weights over the rows to keep; 0 without any."""
    w = F.when(F.col(keep), F.col(weight))
    return F.coalesce(F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w)), F.lit(0.0))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count with a uniform number: how often a resample draws a cluster."""
    weight, below, term = F.lit(6), 0.0, float(np.exp(-1))
    steps = []
    for k in range(6):
        below += term
        steps.append((k, below))
        term /= k + 1
    for k, limit in reversed(steps):
        weight = F.when(u < limit, k).otherwise(weight)
    return weight


def bootstrap(df: DataFrame, value: str, keep: str, cluster: str, replicates: int, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """(by, b, value): mean of `value` over the kept rows in each resample of clusters.

    Rows are first summed to one row for each cluster; only those are written out for each
    replicate. The weight of a cluster in a replicate depends on (seed, b, cluster) alone, so
    that conditions and engines share their resamples.
    """
    kept = df.where(F.col(keep))
    return bootstrap_ratios(kept, {"value": (F.col(value), F.col(value).isNotNull().cast("int"))}, cluster, replicates, seed, by)


def bootstrap_ratios(df: DataFrame, ratios: dict[str, tuple[Column, Column]], cluster: str, replicates: int, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """(by, b, one column for each ratio): sum of the first over sum of the second column in each resample of clusters.

    A cluster's rows of all groups are drawn together, with one hash for each replicate. Clusters are
    spread over tasks before they are written out for each replicate, however small their sums are.
    """
    by = by or []
    sums = df.groupBy(*by, cluster).agg(*[F.sum(c).alias(f"_{i}_{k}") for k, pair in ratios.items() for i, c in enumerate(pair)])
    parts = [*by, *[f"_{i}_{k}" for k in ratios for i in (0, 1)]]
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By a hash of the cluster: a repartition by the cluster itself equals the aggregate's and is dropped, and the adaptive plan leaves one task.
    drawn = sums.groupBy(cluster).agg(F.collect_list(F.struct(*parts)).alias("_rows")).repartition(tasks, F.xxhash64(cluster))
    # The hash is computed behind the generator, in generated code.
    each = drawn.select(cluster, "_rows", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).withColumn("_q", hash_unit(F.lit(seed), F.col("b"), F.col(cluster)))
    weighed = each.select("b", poisson_weight(F.col("_q")).alias("_w"), F.inline("_rows"))
    total = lambda c: F.sum(F.col("_w") * F.col(c))
    return weighed.groupBy(*by, "b").agg(*[F.try_divide(total(f"_0_{k}"), total(f"_1_{k}")).alias(k) for k in ratios])


def logistics(df: DataFrame, models: dict, group: str, groups: int, ridge: float = 1e-3, steps: int = 8, without: list[tuple[int, ...]] | None = None) -> dict:
    """For each model (features, label, rows it sees) and each group g in 0..groups-1 the coefficients (intercept first) of a
    logistic regression on the rows of all other groups. With `without`, model k of it is fitted on the rows of all groups but without[k].

    A Newton step is one job for all models and groups: each task sums gradients and Hessians over its rows,
    and Spark adds up the tasks' sums. `df` is read once a step: give it as a written table.
    Rows with a null feature or label aren't seen. A label that is constant in the training rows gives its rate.
    """
    ship(df.sparkSession)
    names, packed = list(models), []
    for k, (features, label, seen) in enumerate(models.values()):
        row = F.array(*[F.col(c).cast("double") for c in [label, *features]])
        fits = ~F.exists(row, lambda v: v.isNull()) & (seen if seen is not None else F.lit(True))
        packed.append(F.when(F.coalesce(fits, F.lit(False)), row).alias(f"m{k}"))
    rows = df.select(F.col(group).cast("int").alias("g"), *packed)
    wide, left_out = [len(f) + 1 for f, _, _ in models.values()], without or [(g,) for g in range(groups)]
    groups = len(left_out)
    beta = {m: {g: np.zeros(p) for g in range(groups)} for m, p in zip(names, wide)}

    def sums(now: dict[str, dict[int, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [[np.zeros(p + p * p) for _ in range(groups)] for p in wide]
            for pdf in batches:
                of = pdf["g"].to_numpy()
                for k, m in enumerate(names):
                    have = pdf[f"m{k}"].notna().to_numpy()
                    if not have.any():
                        continue
                    values, own = np.stack(pdf[f"m{k}"].to_numpy()[have]), of[have]
                    x, y = np.c_[np.ones(len(values)), values[:, 1:]], values[:, 0]
                    for g in range(groups):
                        train = ~np.isin(own, left_out[g])
                        xt = x[train]
                        q = 1 / (1 + np.exp(-np.clip(xt @ now[m][g], -30, 30)))
                        total[k][g] += np.r_[xt.T @ (y[train] - q), ((xt * (q * (1 - q))[:, None]).T @ xt).ravel()]
            yield pd.DataFrame({"k": [k for k in range(len(names)) for _ in range(groups)], "g": list(range(groups)) * len(names), "v": [v for part in total for v in part]})

        cells = rows.mapInPandas(run, "k int, g int, v array<double>").select("k", "g", F.posexplode("v").alias("i", "x"))
        return cells.groupBy("k", "g", "i").agg(F.sum("x").alias("x"))

    for _ in range(steps):
        largest, got = 0.0, {(r.k, r.g, r.i): r.x for r in sums(beta).collect()}
        for k, m in enumerate(names):
            p = wide[k]
            for g in range(groups):
                v = np.array([got.get((k, g, i), 0.0) for i in range(p + p * p)])
                gradient, hessian = v[:p] - ridge * np.r_[0.0, beta[m][g][1:]], v[p:].reshape(p, p)
                step = np.clip(np.linalg.lstsq(hessian + np.diag([1e-9] + [ridge] * (p - 1)), gradient, rcond=None)[0], -5, 5)
                beta[m][g] = beta[m][g] + step
                largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-6:
            break
    return beta


def logistic(df: DataFrame, features: list[str], label: str, group: str, groups: int) -> dict[int, np.ndarray]:
    """One model of `logistics` over all rows."""
    return logistics(df, {"one": (features, label, None)}, group, groups)["one"]


def predict(beta: dict[int, np.ndarray], features: list[str], group: str) -> Column:
    """Probability by the coefficients of the row's own group."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    out = F.lit(None).cast("double")
    for g, b in beta.items():
        z = sum((float(v) * c for v, c in zip(b, x)), F.lit(0.0))
        out = F.when(F.col(group) == g, 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).otherwise(out)
    return out


def model_nuisances(df: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """`df` with e, m1, m0, kc and j1, j0 from logistic regressions fitted on the other folds.

    Features are standardised over all rows, missing ones take the mean; the outcome models m1 and m0 see
    the observed rows of their arm. j1 and j0 are one outcome model's predictions, which has the arm as
    its last feature and sees the observed rows of both arms.
    """
    stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = df.withColumn("fold", fold("id", folds))
    for c in features:
        m, s = float(stats[f"m_{c}"] or 0.0), float(stats[f"s_{c}"] or 0.0)
        scaled = scaled.withColumn(f"_z_{c}", (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / (s if s > 0 else 1.0))
    z = [f"_z_{c}" for c in features]
    scaled = cut(scaled)
    observed = F.col("d") == 1
    models = {"e": (z, "a", None), "kc": (z, "d", None)} | {f"m{arm}": (z, "y", observed & (F.col("a") == arm)) for arm in (1, 0)} | {"joint": ([*z, "a"], "y", observed)}
    fits = logistics(scaled, models, "fold", folds)
    joint = fits.pop("joint")
    out = scaled.withColumns({k: predict(b, z, "fold") for k, b in fits.items()} | {"_one": F.lit(1), "_none": F.lit(0)})
    return out.withColumns({"j1": predict(joint, [*z, "_one"], "fold"), "j0": predict(joint, [*z, "_none"], "fold")}).drop(*z, "_one", "_none")


def reduced_scores(df: DataFrame, block: list[str], label: str, name: str, folds: int = 5, seen: Column | None = None) -> DataFrame:
    """`df` (fold) with name_0 .. name_{folds-1}: a block of features reduced to one score, for use in the model of each outer fold.

    The score for outer fold g of a row of another fold is by a model that saw neither fold, that of a row of g by a model
    that saw all folds but g, so nothing of a row reaches its own score. All models are fitted together. Features
    must be scaled; a row with a null feature has null scores.
    """
    pairs = [(g,) for g in range(folds)] + [(f, g) for f in range(folds) for g in range(f + 1, folds)]
    beta = logistics(df, {"s": (block, label, seen)}, "fold", folds, without=pairs)["s"]
    at = {frozenset(p): k for k, p in enumerate(pairs)}
    for g in range(folds):
        own = {f: beta[at[frozenset((f, g))]] for f in range(folds)}
        df = df.withColumn(f"{name}_{g}", predict(own, block, "fold"))
    return df


def reduced_nuisances(df: DataFrame, base: list[str], block: list[str], folds: int = 5) -> DataFrame:
    """`df` with e, m1, m0, kc from `base` and a block that is reduced to its scores for arm and outcome, nested in the folds.

    Features must be scaled and without nulls.
    """
    rows = df.withColumn("fold", fold("id", folds))
    rows = reduced_scores(rows, block, "a", "_sa", folds)
    rows = cut(reduced_scores(cut(rows), block, "y", "_sy", folds, F.col("d") == 1))
    observed, models = F.col("d") == 1, {}
    for g in range(folds):
        x = [*base, f"_sa_{g}", f"_sy_{g}"]
        models |= {("e", g): (x, "a", None), ("kc", g): (x, "d", None)} | {(f"m{arm}", g): (x, "y", observed & (F.col("a") == arm)) for arm in (1, 0)}
    # Of each fold's models only the fit without that fold is used.
    fits = logistics(rows, models, "fold", folds)
    out = {}
    for k in ("e", "kc", "m1", "m0"):
        value = F.lit(None).cast("double")
        for g in range(folds):
            value = F.when(F.col("fold") == g, predict({g: fits[k, g][g]}, models[k, g][0], "fold")).otherwise(value)
        out[k] = value
    return rows.withColumns(out).drop(*[f"{n}_{g}" for n in ("_sa", "_sy") for g in range(folds)])


def targeted(df: DataFrame, trim: float = 0.02, steps: int = 100) -> DataFrame:
    """`df` (a, y, d, e, j1, j0, kc) with targeted outcome predictions q1 and q0 and psi.

    The predictions of the one outcome model are shifted on the logit scale along the clever covariate until the score
    is zero; each Newton step is one aggregation.
    """
    e = F.least(F.greatest(F.col("e"), F.lit(trim)), F.lit(1 - trim))
    cw = F.col("d") / F.least(F.greatest(F.col("kc"), F.lit(trim)), F.lit(1.0))
    logit = lambda q: F.ln(F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))))
    rows = df.withColumns({"_e": e, "_cw": cw, "_l1": logit(F.col("j1")), "_l0": logit(F.col("j0"))})
    rows = rows.withColumn("_h", F.col("_cw") * (F.col("a") / F.col("_e") - (1 - F.col("a")) / (1 - F.col("_e"))))
    rows = rows.withColumn("_la", F.when(F.col("a") == 1, F.col("_l1")).otherwise(F.col("_l0")))
    shift = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("_la") + shift * F.col("_h"))))
        got = rows.agg(F.sum(F.col("_h") * (F.col("y") - q)).alias("score"), F.sum(F.col("_h") * F.col("_h") * q * (1 - q)).alias("info")).first()
        if not got.info or got.info < 1e-12:
            break
        shift += got.score / got.info
        if abs(got.score / got.info) < 1e-8:
            break
    q1 = 1 / (1 + F.exp(-(F.col("_l1") + shift / F.col("_e"))))
    q0 = 1 / (1 + F.exp(-(F.col("_l0") - shift / (1 - F.col("_e")))))
    done = rows.withColumns({"q1": q1, "q0": q0})
    psi = F.col("q1") - F.col("q0") + F.col("_cw") * (F.col("a") * (F.col("y") - F.col("q1")) / F.col("_e") - (1 - F.col("a")) * (F.col("y") - F.col("q0")) / (1 - F.col("_e")))
    return done.withColumn("psi", psi).withColumn("keep", (F.col("e") > trim) & (F.col("e") < 1 - trim)).drop("_e", "_cw", "_l1", "_l0", "_h", "_la")
