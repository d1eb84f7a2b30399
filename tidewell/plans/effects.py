"""Effect estimates, their uncertainty, balance, ranks and verdicts over orders as units of analysis.

The arm is an urgent priority, the outcome that the order is fulfilled, and it is unobserved while
the order is pending; customers are the clusters.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import estimate as E, ranking as R, statistics as S
from tidewell.session import cut
from tidewell.sources import table

FEATURES = ["log_price", "balance", "lines"]
#: Resamples of the reference's bootstrap.
REPLICATES = 2000


def units(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cluster, a, y, d, segment, nation, log_price, balance, lines): one row for each order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("a"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_orderstatus") != "P").cast("int").alias("d"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.ln("o_totalprice").alias("log_price"), F.col("c_acctbal").alias("balance"), "lines")


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    naive = E.influence(E.rate_nuisances(u)).withColumn("condition", F.lit("naive"))
    strata = E.influence(E.rate_nuisances(u, strata=["segment"])).withColumn("condition", F.lit("segment"))
    return naive.unionByName(strata)


def effects(spark: SparkSession, sf: str) -> DataFrame:
    """Estimate, interval, overlap-weighted estimate and effective size of each adjustment."""
    r = lambda c, n=5: F.round(c, n)
    point, se, low, high, mde, n = S.influence_summary("psi", "keep")
    return _conditions(spark, sf).groupBy("condition").agg(
        r(point).alias("point"), r(se).alias("se"), r(low).alias("low"), r(high).alias("high"), r(mde).alias("mde"), n,
        r(F.sum("psi_ato") / F.sum("h") * 100).alias("ato"), r(E.effective_size("w", "keep"), 2).alias("ess"), r(F.avg((F.col("d") == 0).cast("double"))).alias("censored"))


def against_trial(spark: SparkSession, sf: str, trial: float = -1.9, trial_low: float = -8.1, trial_high: float = 4.2) -> DataFrame:
    """Each adjustment's estimate against a trial: distance, overlap, E-values."""
    point, se, low, high, _, _ = S.influence_summary("psi", "keep")
    base = F.avg(F.when((F.col("a") == 0) & (F.col("d") == 1), F.col("y"))) * 100
    rows = _conditions(spark, sf).groupBy("condition").agg(point, se, low, high, base.alias("baseline"))
    p = [F.col(c) for c in ("point", "se", "low", "high", "baseline")]
    return rows.select("condition", F.round("baseline", 5).alias("baseline"), F.round(S.divergence_z(p[0], p[1], F.lit(trial), F.lit(trial_low), F.lit(trial_high)), 5).alias("z"),
                       S.overlaps(p[2], p[3], F.lit(trial_low), F.lit(trial_high)).alias("overlap"), F.round(S.e_value(p[0], p[4]), 4).alias("e_value"),
                       F.round(S.e_value_limit(p[2], p[3], p[4]), 4).alias("e_limit"))


def _replicates(spark: SparkSession, sf: str, replicates: int = REPLICATES) -> DataFrame:
    return E.bootstrap(_conditions(spark, sf), "psi", "keep", "cluster", replicates, by=["condition"])


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, spread and percentile interval of the cluster bootstrap of each adjustment; `bootstrap_intervals` adds the overlap-weighted form."""
    mean, std, low, high = (F.round(c * 100, 5).alias(n) for c, n in zip(S.replicate_summary("value"), ("mean", "std", "low", "high")))
    return _replicates(spark, sf).groupBy("condition").agg(mean, std, low, high, F.count("value").alias("replicates"))


def paired_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Bias reduction of the adjusted against the unadjusted estimate, paired by replicate."""
    return _paired(_replicates(spark, sf))


def _paired(replicates: DataFrame) -> DataFrame:
    wide = replicates.groupBy("b").pivot("condition", ["naive", "segment"]).agg(F.first("value"))
    gain = wide.withColumn("gain", (F.abs("naive") - F.abs("segment")) * 100)
    return gain.agg(F.round(F.avg("gain"), 5).alias("mean"), F.round(F.stddev_samp("gain") * S.DETECTABLE, 5).alias("detectable"), F.round(S.two_sided_p("gain"), 6).alias("p"))


def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap p-value of the unadjusted effect in each nation, and its value adjusted over all nations."""
    return _nation_fdr(units(spark, sf), REPLICATES)


def _nation_fdr(rows: DataFrame, replicates: int) -> DataFrame:
    psi = E.influence(E.rate_nuisances(rows))
    p = E.bootstrap(psi, "psi", "keep", "cluster", replicates, by=["nation"]).groupBy("nation").agg(S.two_sided_p("value").alias("p"))
    return R.adjusted_p(p, "p", "nation").select("nation", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, spread and percentile interval of each adjustment and of its overlap-weighted form over all replicates of the cluster bootstrap."""
    kept = F.when(F.col("keep"), F.col("psi"))
    ratios = {"value": (kept, kept.isNotNull().cast("int")), "ato": (F.col("psi_ato"), F.col("h"))}
    drawn = E.bootstrap_ratios(_conditions(spark, sf), ratios, "cluster", REPLICATES, by=["condition"])
    summary = [F.round(c * 100, 5).alias(tag + n) for k, tag in (("value", ""), ("ato", "ato_")) for c, n in zip(S.replicate_summary(k), ("mean", "std", "low", "high"))]
    return drawn.groupBy("condition").agg(*summary, F.count("value").alias("replicates"))


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Bias reduction of the adjusted against the unadjusted estimate, paired by replicate, over all replicates."""
    return _paired(_replicates(spark, sf, REPLICATES))


def nation_fdr(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap p-value of the unadjusted effect in each nation over all replicates, and its value adjusted over all nations."""
    return _nation_fdr(units(spark, sf), REPLICATES)


def balance(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised mean differences before and after weighting."""
    rows = E.influence(E.rate_nuisances(units(spark, sf), strata=["segment"]))
    b = S.balance(rows, FEATURES, "a", "w")
    return b.select("covariate", *[F.round(c, 6).alias(c) for c in ("smd_before", "smd_after", "filled")])


def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    """How well the price tells fulfilled orders."""
    got = R.auc(table(spark, sf, "orders").select(F.round("o_totalprice", -2).alias("s"), (F.col("o_orderstatus") == "F").alias("label")), "s", "label")
    return got.select("n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision of the price for fulfilled orders."""
    got = R.average_precision(table(spark, sf, "orders").select(F.round("o_totalprice", -2).alias("s"), (F.col("o_orderstatus") == "F").alias("label")), "s", "label")
    return got.select("n_pos", F.round("average_precision", 8).alias("average_precision"))


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of quantity and price over all line items."""
    return R.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("rho", 8).alias("rho"))


def arm_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Units, outcome and missingness by arm, by arm and segment, and overall: one pass with grouping sets."""
    return units(spark, sf).rollup("a", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 8).alias("outcome"), F.round(F.avg(F.col("lines").isNull().cast("double")), 8).alias("lines_missing"),
        F.grouping_id().cast("long").alias("level"))


def funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Counts along the selection of units, in one pass, as one row for each step."""
    u = units(spark, sf)
    steps = {"all": F.lit(True), "observed": F.col("d") == 1, "with_lines": (F.col("d") == 1) & F.col("lines").isNotNull(),
             "treated": (F.col("d") == 1) & F.col("lines").isNotNull() & (F.col("a") == 1)}
    one = u.agg(*[F.count_if(c).alias(k) for k, c in steps.items()])
    return one.unpivot([], list(steps), "step", "n")


def segment_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Mean outcome of each nation by segment, as a table, and the ratio of its extremes."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = units(spark, sf).groupBy("nation").pivot("segment", segments).agg(F.round(F.avg("y"), 8))
    return wide.withColumn("ratio", F.round(F.try_divide(F.greatest(*segments), F.least(*segments)), 6))


def block_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the effective sample that adjusting for the segment costs."""
    each = _conditions(spark, sf).groupBy("condition").agg(E.effective_size("w", "keep").alias("ess"))
    one = each.agg(*[F.max(F.when(F.col("condition") == k, F.col("ess"))).alias(f"ess_{k}") for k in ("naive", "segment")])
    return one.select(F.round("ess_naive", 2).alias("ess_naive"), F.round("ess_segment", 2).alias("ess_segment"), S.positivity_cost(F.col("ess_naive"), F.col("ess_segment")).alias("cost"))


def model_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-fitted estimate with logistic nuisance models over five folds, and its targeted form."""
    rows = cut(E.model_nuisances(units(spark, sf), FEATURES))
    parts = []
    for name, df in (("aipw", E.influence(rows)), ("targeted", E.targeted(rows))):
        point, se, low, high, mde, n = S.influence_summary("psi", "keep")
        parts.append(df.agg(point, se, low, high, mde, n).withColumn("estimator", F.lit(name)))
    return parts[0].unionByName(parts[1])


def information_gain(spark: SparkSession, sf: str) -> DataFrame:
    """What line counts add to price and balance: held-out AUROC of arm and outcome with and without them."""
    rows = units(spark, sf).withColumn("fold", E.fold("id")).na.fill({"lines": 0})
    rows = cut(rows.withColumn("balance", F.col("balance") / 5000).withColumn("log_price", F.col("log_price") - 11))
    models = {(label, name): (features, label, None) for label in ("a", "y") for name, features in (("base", FEATURES[:2]), ("full", FEATURES))}
    fits = E.logistics(rows, models, "fold", 5)
    cells = [F.struct(F.lit(label).alias("label"), F.lit(name).alias("features"), F.round(E.predict(fits[label, name], features, "fold"), 6).alias("p"), F.col(label).alias("seen"))
             for (label, name), (features, _, _) in models.items()]
    areas = R.auc_by(rows.select(F.inline(F.array(*cells))), ["label", "features"], "p", "seen")
    return areas.groupBy("label").pivot("features", ["base", "full"]).agg(F.first("auroc")).withColumn("gain", F.col("full") - F.col("base"))


def isotonic(spark: SparkSession, sf: str) -> DataFrame:
    """Monotone fit of the outcome on the price, in steps of 1000: (price, n, outcome, fitted)."""
    steps = table(spark, sf, "orders").groupBy(F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("outcome"))
    data = VectorAssembler(inputCols=["price"], outputCol="features").transform(steps)
    fitted = IsotonicRegression(featuresCol="features", labelCol="outcome", weightCol="n", predictionCol="fitted").fit(data)
    return fitted.transform(data).select("price", "n", "outcome", "fitted")


def planted_effect(spark: SparkSession, sf: str, strengths: tuple[float, ...] = (0.0, 0.5, 1.0), effect: float = 0.2, replicates: int = 5) -> DataFrame:
    """Arms and outcomes planted on the real segments with a confounder of known strength: the bias of the
    unadjusted and the adjusted estimate in percentage points, by strength, over replicates.

    Every cell is drawn from hashes of (cell, replicate, id), so the sweep is one plan without a loop over cells.
    """
    u = units(spark, sf).select("id", "cluster", "segment").withColumn("u", F.when(F.col("segment").isin("BUILDING", "FURNITURE"), 1.0).otherwise(-0.5))
    cells = u.withColumn("strength", F.explode(F.array(*[F.lit(s) for s in strengths]))).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draw = lambda tag: E.hash_unit(F.lit(tag), F.col("strength"), F.col("replicate"), F.col("id"))
    arm = (draw("a") < 1 / (1 + F.exp(-F.col("strength") * F.col("u")))).cast("int")
    planted = cells.withColumn("a", arm).withColumn("risk", F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.3 + 0.1 * F.col("strength") * F.col("u") + effect * F.col("a"))))
    planted = planted.withColumn("y", (draw("y") < F.col("risk")).cast("int"))
    groups = planted.groupBy("strength", "replicate", "segment", "a").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    cell = groups.groupBy("strength", "replicate", "segment").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("a") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "s")])
    whole = cell.groupBy("strength", "replicate").agg(
        (F.try_divide(F.sum("s1"), F.sum("n1")) - F.try_divide(F.sum("s0"), F.sum("n0"))).alias("naive"),
        F.try_divide(F.sum(F.col("n") * (F.try_divide("s1", "n1") - F.try_divide("s0", "n0"))), F.sum("n")).alias("adjusted"))
    return whole.groupBy("strength").agg(F.round((F.avg("naive") - effect) * 100, 6).alias("naive_bias"), F.round((F.avg("adjusted") - effect) * 100, 6).alias("adjusted_bias"),
                                         F.round(F.coalesce(F.stddev_samp("adjusted"), F.lit(0.0)) * 100, 6).alias("spread"))


_HASH = "(('0x' || substr(md5({}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)".format
_UNITS = f"""WITH ln AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1),
u AS (SELECT o_orderkey AS id, o_custkey AS cluster, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS a, (o_orderstatus = 'F')::INT AS y, (o_orderstatus <> 'P')::INT AS d, c_mktsegment AS segment, c_nationkey AS nation,
  ln(o_totalprice) AS log_price, c_acctbal AS balance, lines, floor({_HASH("o_orderkey::VARCHAR")} * 5)::INT AS fold FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN ln ON l_orderkey = o_orderkey)"""
_SUMS = "count(*) AS n, sum(a) AS sa, sum(d) AS sd, count(*) FILTER (a = 1 AND d = 1) AS n1, sum(y) FILTER (a = 1 AND d = 1) AS y1, count(*) FILTER (a = 0 AND d = 1) AS n0, sum(y) FILTER (a = 0 AND d = 1) AS y0"


def _psi(name: str, segment: str) -> str:
    """psi of one condition: rates of the other folds within `segment`."""
    return f"""{name}_g AS (SELECT {segment} AS seg, fold, {_SUMS} FROM u GROUP BY 1, 2),
{name}_t AS (SELECT a.seg, a.fold, sum(b.sa)::DOUBLE / sum(b.n) AS e, sum(b.y1)::DOUBLE / sum(b.n1) AS m1, sum(b.y0)::DOUBLE / sum(b.n0) AS m0, sum(b.sd)::DOUBLE / sum(b.n) AS kc FROM {name}_g a JOIN {name}_g b ON a.seg = b.seg AND a.fold <> b.fold GROUP BY 1, 2),
{name}_p AS (SELECT '{name}' AS condition, u.*, e, (m1 - m0) + d / kc * (a * (y - m1) / e - (1 - a) * (y - m0) / (1 - e)) AS psi, e * (1 - e) AS h,
  e * (1 - e) * (m1 - m0) + d / kc * (a * (1 - e) * (y - m1) - (1 - a) * e * (y - m0)) AS psi_ato, CASE WHEN a = 1 THEN 1 / e ELSE 1 / (1 - e) END AS w FROM u JOIN {name}_t t ON t.seg = {segment.replace("segment", "u.segment")} AND t.fold = u.fold)"""


_BOTH = f"{_UNITS}, {_psi('naive', chr(39) + 'all' + chr(39))}, {_psi('segment', 'segment')}, c AS (SELECT * FROM naive_p UNION ALL SELECT * FROM segment_p)"
_WEIGHT = "CASE WHEN q < 0.36787944117144233 THEN 0 WHEN q < 0.7357588823428847 THEN 1 WHEN q < 0.9196986029286058 THEN 2 WHEN q < 0.9810118431238463 THEN 3 WHEN q < 0.9963401531726563 THEN 4 WHEN q < 0.9994058151824183 THEN 5 ELSE 6 END"
_HASH_B = _HASH("'1-' || b || '-' || cluster")


def _boot(by: str, n: int) -> str:
    return f"""s AS (SELECT {by}, cluster, sum(psi) AS s, count(psi) AS n FROM c GROUP BY 1, 2), r AS (SELECT {by}, b, s, n, {_HASH_B} AS q FROM s, range({n}) t(b)),
bt AS (SELECT {by}, b, sum(({_WEIGHT}) * s) / nullif(sum(({_WEIGHT}) * n), 0) AS value FROM r GROUP BY 1, 2)"""


_IF = "avg(psi) * 100 AS point, stddev_samp(psi) / sqrt(count(psi)) * 100 AS se, 1.959963984540054::DOUBLE AS z"
ORACLES = {
    "effects": f"""{_BOTH} SELECT condition, round(avg(psi) * 100, 5) AS point, round(stddev_samp(psi) / sqrt(count(psi)) * 100, 5) AS se, round(avg(psi) * 100 - 1.959963984540054 * stddev_samp(psi) / sqrt(count(psi)) * 100, 5) AS low,
  round(avg(psi) * 100 + 1.959963984540054 * stddev_samp(psi) / sqrt(count(psi)) * 100, 5) AS high, round({S.DETECTABLE!r} * stddev_samp(psi) / sqrt(count(psi)) * 100, 5) AS mde, count(psi) AS n,
  round(sum(psi_ato) / sum(h) * 100, 5) AS ato, round(sum(w) * sum(w) / sum(w * w), 2) AS ess, round(avg((d = 0)::INT), 5) AS censored FROM c GROUP BY 1""",
    "against_trial": f"""{_BOTH}, p AS (SELECT condition, {_IF}, avg(y) FILTER (a = 0 AND d = 1) * 100 AS b FROM c GROUP BY 1), i AS (SELECT *, point - z * se AS lo, point + z * se AS hi, (8.1 + 4.2)::DOUBLE / (2 * z) AS st FROM p),
v AS (SELECT *, CASE WHEN abs(lo) < abs(hi) THEN lo ELSE hi END AS lim FROM i), x AS (SELECT *, (b + point) / b AS r1, (b + lim) / b AS r2 FROM v), y AS (SELECT *, CASE WHEN r1 < 1 THEN 1 / r1 ELSE r1 END AS u1, CASE WHEN r2 < 1 THEN 1 / r2 ELSE r2 END AS u2 FROM x)
SELECT condition, round(b, 5) AS baseline, round((point + 1.9) / sqrt(se * se + st * st), 5) AS z, lo <= 4.2 AND -8.1 <= hi AS overlap, round(u1 + sqrt(u1 * (u1 - 1)), 4) AS e_value,
  round(CASE WHEN lo <= 0 AND hi >= 0 THEN 1.0 ELSE u2 + sqrt(u2 * (u2 - 1)) END, 4) AS e_limit FROM y""",
    "bootstrap_ci": f"{_BOTH}, {_boot('condition', REPLICATES)} SELECT condition, round(avg(value) * 100, 5) AS mean, round(stddev_samp(value) * 100, 5) AS std, round(quantile_cont(value, 0.025) * 100, 5) AS low, round(quantile_cont(value, 0.975) * 100, 5) AS high, count(value) AS replicates FROM bt GROUP BY 1",
    "paired_contrast": f"""{_BOTH}, {_boot('condition', REPLICATES)}, g AS (SELECT b, (abs(max(value) FILTER (condition = 'naive')) - abs(max(value) FILTER (condition = 'segment'))) * 100 AS gain FROM bt GROUP BY 1)
SELECT round(avg(gain), 5) AS mean, round(stddev_samp(gain) * {S.DETECTABLE!r}, 5) AS detectable, round(least(1.0, greatest(2 * least(avg((gain >= 0)::INT), avg((gain <= 0)::INT)), 1.0::DOUBLE / nullif(count(gain), 0))), 6) AS p FROM g""",
    "bh_fdr": f"""{_UNITS}, {_psi('naive', chr(39) + 'all' + chr(39))}, c AS (SELECT * FROM naive_p), {_boot('nation', REPLICATES)},
p AS (SELECT nation, least(1.0, greatest(2 * least(avg((value >= 0)::INT), avg((value <= 0)::INT)), 1.0::DOUBLE / nullif(count(value), 0))) AS p FROM bt GROUP BY 1), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, nation) AS raw FROM p)
SELECT nation, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, nation DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k""",
    "bootstrap_intervals": f"""{_BOTH}, s AS (SELECT condition, cluster, sum(psi) AS s, count(psi) AS n, sum(psi_ato) AS sa, sum(h) AS sh FROM c GROUP BY 1, 2), r AS (SELECT *, {_HASH_B} AS q FROM s, range({REPLICATES}) t(b)), k AS (SELECT *, {_WEIGHT} AS wt FROM r),
bt AS (SELECT condition, b, sum(wt * s) / nullif(sum(wt * n), 0) AS value, sum(wt * sa) / nullif(sum(wt * sh), 0) AS ato FROM k GROUP BY 1, 2)
SELECT condition, {", ".join(f"round(avg({k}) * 100, 5) AS {t}mean, round(stddev_samp({k}) * 100, 5) AS {t}std, round(quantile_cont({k}, 0.025) * 100, 5) AS {t}low, round(quantile_cont({k}, 0.975) * 100, 5) AS {t}high" for k, t in (("value", ""), ("ato", "ato_")))}, count(value) AS replicates FROM bt GROUP BY 1""",
    "paired_bootstrap": f"""{_BOTH}, {_boot('condition', REPLICATES)}, g AS (SELECT b, (abs(max(value) FILTER (condition = 'naive')) - abs(max(value) FILTER (condition = 'segment'))) * 100 AS gain FROM bt GROUP BY 1)
SELECT round(avg(gain), 5) AS mean, round(stddev_samp(gain) * {S.DETECTABLE!r}, 5) AS detectable, round(least(1.0, greatest(2 * least(avg((gain >= 0)::INT), avg((gain <= 0)::INT)), 1.0::DOUBLE / nullif(count(gain), 0))), 6) AS p FROM g""",
    "nation_fdr": f"""{_UNITS}, {_psi('naive', chr(39) + 'all' + chr(39))}, c AS (SELECT * FROM naive_p), {_boot('nation', REPLICATES)},
p AS (SELECT nation, least(1.0, greatest(2 * least(avg((value >= 0)::INT), avg((value <= 0)::INT)), 1.0::DOUBLE / nullif(count(value), 0))) AS p FROM bt GROUP BY 1), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, nation) AS raw FROM p)
SELECT nation, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC, nation DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k""",
    "block_cost": f"""{_BOTH}, k AS (SELECT condition, sum(w) * sum(w) / sum(w * w) AS ess FROM c GROUP BY 1), o AS (SELECT max(ess) FILTER (condition = 'naive') AS n, max(ess) FILTER (condition = 'segment') AS s FROM k)
SELECT round(n, 2) AS ess_naive, round(s, 2) AS ess_segment, round(1 - s / n, 3) AS cost FROM o""",
    "balance": f"""{_BOTH}, l AS (SELECT a, w, unnest(['log_price', 'balance', 'lines']) AS covariate, unnest([log_price, balance, lines::DOUBLE]) AS x FROM segment_p),
t AS (SELECT covariate, sqrt((var_samp(x) FILTER (a = 1) + var_samp(x) FILTER (a = 0)) / 2) AS sp, avg(x) FILTER (a = 1) - avg(x) FILTER (a = 0) AS d0, sum(x * w) FILTER (a = 1) / sum(w) FILTER (a = 1 AND x IS NOT NULL) - sum(x * w) FILTER (a = 0) / sum(w) FILTER (a = 0 AND x IS NOT NULL) AS d1, count(x)::DOUBLE / count(*) AS filled FROM l GROUP BY 1)
SELECT covariate, round(d0 / sp, 6) AS smd_before, round(d1 / sp, 6) AS smd_after, round(filled, 6) AS filled FROM t""",
    "auc_rank": """WITH r AS (SELECT round(o_totalprice, -2) AS s, o_orderstatus = 'F' AS y FROM orders), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM r),
t AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS m, sum(rk) FILTER (y) AS sr FROM k) SELECT p AS n_pos, m AS n_neg, round((sr - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * m), 8) AS auroc FROM t""",
    "average_precision": """WITH r AS (SELECT round(o_totalprice, -2) AS s, sum((o_orderstatus = 'F')::INT) AS pos, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen, sum(pos) OVER () AS p FROM r)
SELECT CAST(max(p) AS BIGINT) AS n_pos, round(sum(tp::DOUBLE / seen * pos / p), 8) AS average_precision FROM k""",
    "spearman": """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM k""",
    "arm_profile": f"{_UNITS} SELECT a, segment, count(*) AS n, round(avg(y), 8) AS outcome, round(avg((lines IS NULL)::INT), 8) AS lines_missing, CAST(grouping(a, segment) AS BIGINT) AS level FROM u GROUP BY ROLLUP (a, segment)",
    "funnel": f"""{_UNITS} SELECT 'all' AS step, count(*) AS n FROM u UNION ALL SELECT 'observed', count(*) FROM u WHERE d = 1 UNION ALL SELECT 'with_lines', count(*) FROM u WHERE d = 1 AND lines IS NOT NULL
UNION ALL SELECT 'treated', count(*) FROM u WHERE d = 1 AND lines IS NOT NULL AND a = 1""",
    "segment_pivot": f"""{_UNITS}, p AS (SELECT nation, {", ".join(f"round(avg(y) FILTER (segment = '{s}'), 8) AS {s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))} FROM u GROUP BY 1)
SELECT *, round(greatest(AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY) / nullif(least(AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY), 0), 6) AS ratio FROM p""",
}

QUERIES = {f.__name__: f for f in (effects, against_trial, bootstrap_ci, paired_contrast, bh_fdr, bootstrap_intervals, paired_bootstrap, nation_fdr, balance, auc_rank, average_precision, spearman, arm_profile, funnel, segment_pivot,
                                   block_cost, model_effects, information_gain, isotonic, planted_effect)}
