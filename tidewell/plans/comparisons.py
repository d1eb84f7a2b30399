"""Comparisons of adjustments, subgroups and blocks of features: paired contrasts, gains and costs, ratios, t statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewell.operators import estimate as E, ranking as R, statistics as S
from tidewell.plans.contrasts import _CELLS
from tidewell.plans.effects import _UNITS, REPLICATES, _boot, _psi, units
from tidewell.session import cut

#: Settings of the comparisons: an outside estimate in percentage points, and the rows an arm needs to be judged.
OUTSIDE = -1.9
LEAST_ROWS = 20
BLOCKS = ["segment", "nation"]


def _three(spark: SparkSession, sf: str) -> DataFrame:
    """Influence values without adjustment, within segments, and within segments and nations."""
    u = units(spark, sf)
    parts = [E.influence(E.rate_nuisances(u, strata=s)).withColumn("condition", F.lit(k)) for k, s in (("naive", None), ("segment", ["segment"]), ("both", ["segment", "nation"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def paired_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Four contrasts paired by replicate: less bias than without adjustment, distance to an outside estimate, the richer
    against the plainer adjustment, and what both together add to the better one."""
    wide = E.bootstrap(_three(spark, sf), "psi", "keep", "cluster", REPLICATES, by=["condition"]).groupBy("b").pivot("condition", ["naive", "segment", "both"]).agg(F.first("value") * 100)
    gains = {"bias_reduction": F.abs("naive") - F.abs("both"), "against_outside": F.col("both") - OUTSIDE, "richer_against_plainer": F.col("both") - F.col("segment"),
             "complementary": F.least(F.abs("naive"), F.abs("segment")) - F.abs("both")}
    long = wide.select("b", F.inline(F.array(*[F.struct(F.lit(k).alias("contrast"), v.alias("gain")) for k, v in gains.items()])))
    return long.groupBy("contrast").agg(F.round(F.avg("gain"), 5).alias("mean"), F.round(F.stddev_samp("gain") * S.DETECTABLE, 5).alias("detectable"), F.round(S.two_sided_p("gain"), 6).alias("p"))


def subgroup_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Unadjusted effect of each segment with its spread over resamples, its difference to the first segment in joint spreads, and the detectable difference."""
    psi = E.influence(E.rate_nuisances(units(spark, sf)))
    each = psi.groupBy("segment").agg((F.avg("psi") * 100).alias("point"))
    spread = E.bootstrap(psi, "psi", "keep", "cluster", REPLICATES, by=["segment"]).groupBy("segment").agg((F.stddev_samp("value") * 100).alias("sd"))
    # One row for each segment.
    order = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joint = F.sqrt(F.pow("sd", 2) + F.pow(F.first("sd").over(order), 2))
    rows = each.join(spread, "segment").withColumn("joint", joint).withColumn("difference", F.col("point") - F.first("point").over(order))
    return rows.select("segment", F.round("point", 5).alias("point"), F.round("sd", 5).alias("sd"), F.round("difference", 5).alias("difference"),
                       F.round(F.try_divide("difference", "joint"), 5).alias("z"), F.round(F.col("joint") * S.DETECTABLE, 5).alias("detectable"))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict for each block on adjusting for it: held-out gain in AUROC points for the arm and, within arms, for the outcome, the smaller
    of both, and the share of the effective sample it costs.

    Scores are the rates of the other folds, within the block or without it. An arm with fewer than LEAST_ROWS
    observed units or one class tells nothing.
    """
    u = cut(units(spark, sf))
    parts = [E.influence(E.rate_nuisances(u, strata=[b] if b else None)).withColumn("block", F.lit(b or "none")) for b in (None, *BLOCKS)]
    rows = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("block", "a", "y", "d", "e", "m1", "m0", "w", "keep"))
    arm = F.struct(F.lit("arm").alias("channel"), F.round("e", 9).alias("s"), F.col("a").alias("label"))
    outcome = F.struct(F.concat(F.lit("outcome"), F.col("a")).alias("channel"), F.round(F.when(F.col("a") == 1, F.col("m1")).otherwise(F.col("m0")), 9).alias("s"), F.when(F.col("d") == 1, F.col("y")).alias("label"))
    areas = R.auc_by(rows.select("block", F.inline(F.array(arm, outcome))), ["block", "channel"], "s", "label").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    # From here on one row for each block and channel.
    base = areas.where("block = 'none'").select("channel", F.col("auroc").alias("base"))
    told = areas.where("block <> 'none'").join(base, "channel").withColumn("gain", (F.col("auroc") - F.col("base")) * 100)
    fits = (F.col("channel") != "arm") & (F.col("n") >= LEAST_ROWS) & F.col("gain").isNotNull()
    gains = told.groupBy("block").agg(F.max(F.when(F.col("channel") == "arm", F.col("gain"))).alias("gain_a"),
                                      F.try_divide(F.sum(F.when(fits, F.col("n") * F.col("gain"))), F.sum(F.when(fits, F.col("n")))).alias("gain_y"))
    sizes = rows.groupBy("block").agg(E.effective_size("w", "keep").alias("ess"))
    none = sizes.where("block = 'none'").select(F.col("ess").alias("ess_none"))
    cost = S.positivity_cost(F.col("ess_none"), F.col("ess"))
    got = gains.join(sizes, "block").join(F.broadcast(none)).withColumn("cost", cost)
    accept, reason = S.verdict(F.col("gain_a"), F.col("gain_y"), F.col("cost"))
    return got.select("block", F.round("gain_a", 5).alias("gain_a"), F.round("gain_y", 5).alias("gain_y"), F.round(F.least("gain_a", "gain_y"), 5).alias("gain"), "cost", accept.alias("accept"), reason.alias("reason"))


def ratio_of_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price for each line by nation and segment, as ratio of means, and its median over the nations of a segment."""
    cells = units(spark, sf).groupBy("segment", "nation").agg(F.try_divide(F.avg("log_price"), F.avg("lines")).alias("ratio"))
    # As many rows as segments and nations.
    middle = R.percentiles(cells, ["segment"], "ratio", {"median": 0.5}).withColumnRenamed("segment", "_s")
    return cells.join(middle, F.col("segment").eqNullSafe(F.col("_s")), "left").select("segment", "nation", F.round("ratio", 8).alias("ratio"), F.round("median", 8).alias("median"))


def one_sample_t(spark: SparkSession, sf: str) -> DataFrame:
    """t of the mean unadjusted effect of each segment against zero over its nations, and its degrees of freedom."""
    psi = E.influence(E.rate_nuisances(units(spark, sf)))
    nations = psi.groupBy("segment", "nation").agg(F.avg("psi").alias("v"))
    return nations.groupBy("segment").agg(F.round(F.try_divide(F.avg("v"), F.stddev_samp("v") / F.sqrt(F.count("v"))), 6).alias("t"), (F.count("v") - 1).alias("freedom"))


_NAIVE, _SEGMENT, _NATION = _psi("naive", "'all'"), _psi("segment", "segment"), _psi("nation", "nation")
_P = "least(1.0, greatest(2 * least(avg((gain >= 0)::INT), avg((gain <= 0)::INT)), 1.0::DOUBLE / nullif(count(gain), 0)))"
ORACLES = {
    "paired_contrasts": f"""{_CELLS}, {_NAIVE}, {_SEGMENT}, c AS (SELECT condition, cluster, psi FROM naive_p UNION ALL SELECT condition, cluster, psi FROM segment_p UNION ALL SELECT 'both', cluster, psi FROM p WHERE e > 0.02 AND e < 0.98), {_boot("condition", REPLICATES).replace(" r AS (", " drawn AS (").replace("FROM r ", "FROM drawn ")},
wide AS (SELECT b, max(value) FILTER (condition = 'naive') * 100 AS n, max(value) FILTER (condition = 'segment') * 100 AS s, max(value) FILTER (condition = 'both') * 100 AS x FROM bt GROUP BY 1),
l AS (SELECT 'bias_reduction' AS contrast, abs(n) - abs(x) AS gain FROM wide UNION ALL SELECT 'against_outside', x + 1.9::DOUBLE FROM wide UNION ALL SELECT 'richer_against_plainer', x - s FROM wide UNION ALL SELECT 'complementary', least(abs(n), abs(s)) - abs(x) FROM wide)
SELECT contrast, round(avg(gain), 5) AS mean, round(stddev_samp(gain) * {S.DETECTABLE!r}, 5) AS detectable, round({_P}, 6) AS p FROM l GROUP BY 1""",
    "subgroup_differences": f"""{_UNITS}, {_NAIVE}, c AS (SELECT * FROM naive_p), {_boot("segment", REPLICATES)}, o AS (SELECT segment, avg(psi) * 100 AS point FROM c GROUP BY 1), i AS (SELECT segment, stddev_samp(value) * 100 AS sd FROM bt GROUP BY 1),
f AS (SELECT *, first_value(point) OVER w AS p0, sqrt(sd * sd + first_value(sd) OVER w * first_value(sd) OVER w) AS joint FROM o JOIN i USING (segment) WINDOW w AS (ORDER BY segment))
SELECT segment, round(point, 5) AS point, round(sd, 5) AS sd, round(point - p0, 5) AS difference, round((point - p0) / joint, 5) AS z, round(joint * {S.DETECTABLE!r}, 5) AS detectable FROM f""",
    "decisions": f"""{_UNITS}, {_NAIVE}, {_SEGMENT}, {_NATION},
q AS (SELECT 'none' AS block, p.a, p.y, p.d, p.e, p.w, t.m1, t.m0 FROM naive_p p JOIN naive_t t ON t.fold = p.fold UNION ALL SELECT 'segment', p.a, p.y, p.d, p.e, p.w, t.m1, t.m0 FROM segment_p p JOIN segment_t t ON t.seg = p.segment AND t.fold = p.fold
  UNION ALL SELECT 'nation', p.a, p.y, p.d, p.e, p.w, t.m1, t.m0 FROM nation_p p JOIN nation_t t ON t.seg = p.nation AND t.fold = p.fold),
l AS (SELECT block, 'arm' AS channel, round(e, 9) AS s, a AS label FROM q UNION ALL SELECT block, 'outcome' || a, round(CASE WHEN a = 1 THEN m1 ELSE m0 END, 9), y FROM q WHERE d = 1),
k AS (SELECT *, rank() OVER (PARTITION BY block, channel ORDER BY s) + (count(*) OVER (PARTITION BY block, channel, s) - 1) / 2.0::DOUBLE AS rk FROM l),
x AS (SELECT block, channel, count(*) AS n, sum(label)::DOUBLE AS p, count(*) - sum(label)::DOUBLE AS m, coalesce(sum(rk) FILTER (label = 1), 0) AS sr FROM k GROUP BY 1, 2), v AS (SELECT block, channel, n, CASE WHEN p > 0 AND m > 0 THEN (sr - p * (p + 1) / 2) / (p * m) END AS auroc FROM x),
h AS (SELECT v.block, v.channel, v.n, (v.auroc - b.auroc) * 100 AS gain FROM v JOIN v b ON b.block = 'none' AND b.channel = v.channel WHERE v.block <> 'none'),
o AS (SELECT block, max(gain) FILTER (channel = 'arm') AS ka, sum(n * gain) FILTER (channel <> 'arm' AND n >= 20 AND gain IS NOT NULL) / sum(n) FILTER (channel <> 'arm' AND n >= 20 AND gain IS NOT NULL) AS ky FROM h GROUP BY 1),
z AS (SELECT block, sum(w) * sum(w) / sum(w * w) AS ess FROM q GROUP BY 1), j AS (SELECT o.*, round(1 - z.ess / (SELECT ess FROM z WHERE block = 'none'), 3) AS cost FROM o JOIN z USING (block))
SELECT block, round(ka, 5) AS gain_a, round(ky, 5) AS gain_y, round(least(ka, ky), 5) AS gain, cost, coalesce(ka >= 2 AND ky >= 2 AND cost <= 0.15, false) AS accept, CASE WHEN ka >= 2 AND ky >= 2 AND cost <= 0.15 THEN 'informative on both channels at an acceptable cost' WHEN coalesce(ka, 0) < 2 AND coalesce(ky, 0) < 2 THEN 'redundant on both channels'
  WHEN coalesce(ka, 0) < 2 THEN 'outcome only: precision, not confounding' WHEN coalesce(ky, 0) < 2 THEN 'treatment only: like an instrument' ELSE 'informative but too costly' END AS reason FROM j""",
    "ratio_of_means": f"""{_UNITS}, c AS (SELECT segment, nation, avg(log_price) / nullif(avg(lines), 0) AS ratio FROM u GROUP BY 1, 2) SELECT segment, nation, round(ratio, 8) AS ratio, round(quantile_cont(ratio, 0.5) OVER (PARTITION BY segment), 8) AS median FROM c""",
    "one_sample_t": f"""{_UNITS}, {_NAIVE}, v AS (SELECT segment, nation, avg(psi) AS v FROM naive_p GROUP BY 1, 2) SELECT segment, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 6) AS t, count(v) - 1 AS freedom FROM v GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (paired_contrasts, subgroup_differences, decisions, ratio_of_means, one_sample_t)}
