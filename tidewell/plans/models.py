"""Fits on vectors and covariates: probes, components learned on training rows only, residuals, information within arms."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import estimate as E, ranking as R, statistics as S
from tidewell.plans.effects import FEATURES, units
from tidewell.session import cut
from tidewell.sources import table


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where("embedding is not null").withColumn("fold", E.fold("vec_id", 10))
    return rows.select("vec_id", "fold", (F.col("label") < 3).cast("double").alias("y"), array_to_vector("embedding").alias("x"))


def vector_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out AUROC and average precision of a logistic probe for a group of labels: scaler and model see seven of ten folds."""
    scored = _probe(spark, sf)
    return R.auc(scored, "p", "y").join(F.broadcast(R.average_precision(scored, "p", "y").drop("n_pos")))


def probe_intervals(spark: SparkSession, sf: str, replicates: int = 500) -> DataFrame:
    """Mean, spread and percentile interval of the probe's held-out areas over the reference's 500 resamples. A vector is a cluster: the table names no patient."""
    drawn = R.resampled_curves(_probe(spark, sf), "p", "y", "vec_id", replicates).unpivot("b", ["auroc", "average_precision"], "area", "value")
    return drawn.groupBy("area").agg(*S.replicate_summary("value"), F.count("value").alias("replicates"))


def _probe(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, y, p) of the held-out vectors."""
    rows = _vectors(spark, sf)
    train, held = rows.where("fold < 7"), rows.where("fold >= 7")
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="z", labelCol="y", regParam=0.1, maxIter=50).fit(scaler.transform(train))
    return cut(model.transform(scaler.transform(held)).select("vec_id", "y", F.round(vector_to_array("probability")[1], 8).alias("p")))


def fold_components(spark: SparkSession, sf: str, components: int = 4) -> DataFrame:
    """(fold, component, explained, spread): principal components fitted without each of three folds, and the spread of the held-out rows along them.

    Nothing of a held-out row reaches the components it is projected on.
    """
    rows, parts = _vectors(spark, sf).withColumn("part", F.col("fold") % 3), []
    for part in range(3):
        train, held = rows.where(F.col("part") != part), rows.where(F.col("part") == part)
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(train)
        pca = PCA(k=components, inputCol="z", outputCol="c").fit(scaler.transform(train))
        shares = [float(v) for v in pca.explainedVariance.toArray()]
        cells = pca.transform(scaler.transform(held)).select(F.posexplode(vector_to_array("c")).alias("component", "v"))
        share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component") + 1)
        parts.append(cells.groupBy("component").agg(F.stddev_samp("v").alias("spread")).select(F.lit(part).alias("fold"), "component", share.alias("explained"), "spread"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def residual_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares of price on quantity by return flag, and what is left: slope, intercept, R2, residual spread and its correlation with the discount."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("w"))
    fit = rows.groupBy("l_returnflag").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    # One row for each flag.
    left = rows.join(F.broadcast(fit), "l_returnflag").withColumn("rest", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    return left.groupBy("l_returnflag").agg(
        F.round(F.first("slope"), 4).alias("slope"), F.round(F.first("intercept"), 2).alias("intercept"), F.round(F.first("r2"), 8).alias("r2"),
        F.round(F.stddev_pop("rest"), 3).alias("spread"), F.round(F.corr("rest", "w"), 6).alias("with_discount"))


def within_arm_gain(spark: SparkSession, sf: str) -> DataFrame:
    """What line counts add to price and balance for the outcome within each arm, and over both arms weighted by their size.

    Within arms the gain can't come from the arm itself.
    """
    rows = units(spark, sf).where("d = 1").withColumn("fold", E.fold("id")).na.fill({"lines": 0})
    rows = cut(rows.withColumn("balance", F.col("balance") / 5000).withColumn("log_price", F.col("log_price") - 11).withColumn("lines", F.col("lines") / 4))
    models = {"base": (FEATURES[:2], "y", None), "full": (FEATURES, "y", None)}
    fits = E.logistics(rows, models, "fold", 5)
    cells = [F.struct(F.lit(k).alias("features"), F.round(E.predict(fits[k], f, "fold"), 6).alias("p")) for k, (f, _, _) in models.items()]
    one = R.auc_by(rows.select(F.col("a").alias("arm"), "y", F.inline(F.array(*cells))), ["features", "arm"], "p", "y").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    each = one.groupBy("arm").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("features") == k, F.col("auroc"))).alias(k) for k in ("base", "full")]).withColumn("gain", F.col("full") - F.col("base"))
    whole = each.agg((F.sum(F.col("n") * F.col("gain")) / F.sum("n")).alias("pooled_gain"))
    return each.join(F.broadcast(whole))


def reduced_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Estimate with a block of features (balance and line count) as it is, and reduced to out-of-fold scores nested in the folds."""
    rows = units(spark, sf).na.fill({"lines": 0})
    rows = cut(rows.withColumn("balance", F.col("balance") / 5000).withColumn("log_price", F.col("log_price") - 11).withColumn("lines", F.col("lines") / 4).na.drop(subset=FEATURES))
    point, se, low, high, mde, n = S.influence_summary("psi", "keep")
    parts = []
    for name, df in (("whole", E.model_nuisances(rows, FEATURES)), ("score", E.reduced_nuisances(rows, FEATURES[:1], FEATURES[1:]))):
        parts.append(E.influence(df).agg(point, se, low, high, mde, n).withColumn("reduction", F.lit(name)))
    return parts[0].unionByName(parts[1])


def study_probe(spark: SparkSession, sf: str, replicates: int = 500) -> DataFrame:
    """How well a study's circumstances tell edema: held-out areas with their spread over resamples of subjects.

    A subject is either in the training rows or among the 30 percent held out, by a hash; scaling and model see the
    training rows only, and resamples draw whole subjects.
    """
    studies = table(spark, sf, "cxr_studies").distinct().where("subject_id is not null and study_id is not null and edema in (0, 1)")
    rows = studies.select("subject_id", "study_id", F.col("edema").alias("y"), (E.hash_unit(F.lit("probe"), F.col("subject_id")) < 0.3).cast("int").alias("held"),
                          F.coalesce("hours_from_admit", F.lit(0.0)).alias("hours"), F.coalesce("n_images", F.lit(0)).cast("double").alias("images"), F.col("icu_stay_id").isNotNull().cast("double").alias("icu"),
                          *[(F.col(c) == 1).cast("double").alias(c) for c in ("pneumonia", "atelectasis") if c in studies.columns]).na.fill(0.0)
    rows, features = cut(rows), [c for c in rows.columns if c not in ("subject_id", "study_id", "y", "held")]
    stats = rows.where("held = 0").agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = cut(rows.withColumns({c: (F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in features}))
    # The fit without group 1 saw the training rows only.
    beta = E.logistics(scaled, {"p": (features, "y", None)}, "held", 2, without=[(1,)])["p"][0]
    scored = cut(scaled.where("held = 1").select("subject_id", "y", F.round(E.predict({1: beta}, features, "held"), 8).alias("p")))
    drawn = R.resampled_curves(scored, "p", "y", "subject_id", replicates).unpivot("b", ["auroc", "average_precision"], "area", "value")
    point = R.auc(scored, "p", "y").select("auroc").join(F.broadcast(R.average_precision(scored, "p", "y").select("average_precision"))).unpivot([], ["auroc", "average_precision"], "area", "point")
    return drawn.groupBy("area").agg(*S.replicate_summary("value"), F.count("value").alias("replicates")).join(point, "area")


def gain_calibration(spark: SparkSession, sf: str, least: int = 8) -> DataFrame:
    """Monotone fit of the bias that adjusting for the segment removes on how unevenly segments stand in the arms, over nations: (nation, gain, less_bias, fitted).

    Equal gains share their mean; fewer than `least` nations have no fit.
    """
    u = units(spark, sf)
    cells = u.groupBy("nation", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("share"))
    gain = cells.groupBy("nation").agg(F.round(F.sqrt(F.var_pop("share")) * 100, 6).alias("gain"))
    effect = lambda strata, name: E.influence(E.rate_nuisances(u, strata=strata)).groupBy("nation").agg(F.abs(F.avg("psi") * 100).alias(name))
    rows = cut(gain.join(effect(None, "before"), "nation").join(effect(["segment"], "after"), "nation").select("nation", "gain", (F.col("before") - F.col("after")).alias("less_bias")))
    levels = rows.groupBy("gain").agg(F.avg("less_bias").alias("less_bias"), F.count(F.lit(1)).cast("double").alias("n"))
    if rows.count() < least:
        return rows.withColumn("fitted", F.lit(None).cast("double"))
    data = VectorAssembler(inputCols=["gain"], outputCol="features").transform(levels)
    fitted = IsotonicRegression(featuresCol="features", labelCol="less_bias", weightCol="n", predictionCol="fitted").fit(data)
    return rows.join(fitted.transform(data).select("gain", "fitted"), "gain").select("nation", "gain", "less_bias", "fitted")


def frontal_views(spark: SparkSession, sf: str) -> DataFrame:
    """Studies by shard with a frontal view, and with a frontal view and none from the side."""
    rows = table(spark, sf, "cxr_studies").distinct()
    frontal, side = F.coalesce(F.upper("views").rlike(r"(^|\|)(PA|AP)(\||$)"), F.lit(False)), F.coalesce(F.upper("views").contains("LATERAL"), F.lit(False))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(frontal).alias("frontal"), F.count_if(frontal & ~side).alias("frontal_only"))


def first_values(spark: SparkSession, sf: str) -> DataFrame:
    """The first and last known label of each subject by study time, column by column, and its number of studies."""
    rows = table(spark, sf, "cxr_studies").distinct().where("subject_id is not null")
    order = F.struct("study_datetime", "study_id")
    pick = lambda f, c: f(F.col(c), F.when(F.col(c).isNotNull() & F.col("study_datetime").isNotNull(), order))
    return rows.groupBy("subject_id").agg(*[pick(f, c).alias(f"{k}_{c}") for c in ("edema", "pneumonia", "split") for k, f in (("first", F.min_by), ("last", F.max_by))], F.count(F.lit(1)).alias("n"))


def label_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    """Studies by encounter type and edema label, as a table with a column for each label code."""
    return table(spark, sf, "cxr_studies").distinct().groupBy("encounter_type").pivot("edema", [0, 1, 2, 3]).count().na.fill(0).select(
        "encounter_type", *[F.col(str(k)).alias(f"edema_{k}") for k in range(4)])


_S = "s AS (SELECT DISTINCT * FROM cxr_studies)"
_PICK = ", ".join(f"{f}({c}, (study_datetime, study_id)) FILTER ({c} IS NOT NULL AND study_datetime IS NOT NULL) AS {k}_{c}" for c in ("edema", "pneumonia", "split") for k, f in (("first", "arg_min"), ("last", "arg_max")))
ORACLES = {
    "residual_fit": """WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r FROM lineitem GROUP BY 1),
k AS (SELECT l.l_returnflag, a, b, r, l_extendedprice - a - b * l_quantity AS rest, l_discount AS w FROM lineitem l JOIN f USING (l_returnflag))
SELECT l_returnflag, round(any_value(b), 4) AS slope, round(any_value(a), 2) AS intercept, round(any_value(r), 8) AS r2, round(stddev_pop(rest), 3) AS spread, round(corr(rest, w), 6) AS with_discount FROM k GROUP BY 1""",
    "frontal_views": f"WITH {_S} SELECT shard, count(*) AS n, count(*) FILTER (regexp_matches(upper(views), '(^|\\|)(PA|AP)(\\||$)')) AS frontal, count(*) FILTER (regexp_matches(upper(views), '(^|\\|)(PA|AP)(\\||$)') AND NOT contains(upper(views), 'LATERAL')) AS frontal_only FROM s GROUP BY 1",
    "first_values": f"WITH {_S} SELECT subject_id, {_PICK}, count(*) AS n FROM s WHERE subject_id IS NOT NULL GROUP BY 1",
    "label_crosstab": f"WITH {_S} SELECT encounter_type, " + ", ".join(f"count(*) FILTER (edema = {k}) AS edema_{k}" for k in range(4)) + " FROM s GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (vector_probe, probe_intervals, fold_components, residual_fit, within_arm_gain, reduced_effects, study_probe, gain_calibration, frontal_views, first_values, label_crosstab)}
