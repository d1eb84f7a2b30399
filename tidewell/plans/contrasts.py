"""Contrasts between subgroups and settings, set operations on units, and tests of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewell.operators import estimate as E, ranking as R, statistics as S
from tidewell.plans.effects import _UNITS, _psi, units
from tidewell.sources import table


def subgroup_effects(spark: SparkSession, sf: str, least_events: int = 20) -> DataFrame:
    """Unadjusted effect in each segment with enough events in both arms, and its difference to the first segment."""
    rows = E.influence(E.rate_nuisances(units(spark, sf)))
    point, se, _, _, _, n = S.influence_summary("psi", "keep")
    events = lambda a: F.count_if((F.col("a") == a) & (F.col("d") == 1) & (F.col("y") == 1))
    each = rows.groupBy("segment").agg(point, se, n, events(1).alias("e1"), events(0).alias("e0")).where((F.col("e1") >= least_events) & (F.col("e0") >= least_events))
    # One row for each segment.
    order = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base, base_se = F.first("point").over(order), F.first("se").over(order)
    z = F.try_divide(F.col("point") - base, F.sqrt(F.col("se") * F.col("se") + base_se * base_se))
    return each.select("segment", "n", F.round("point", 5).alias("point"), F.round(F.col("point") - base, 5).alias("difference"), F.round(z, 5).alias("z"))


def robustness(spark: SparkSession, sf: str) -> DataFrame:
    """The adjusted estimate under several trims, from one pass: settings are columns of the same aggregation."""
    rows = E.influence(E.rate_nuisances(units(spark, sf), strata=["segment", "nation"]), trim=1e-6)
    trims = [0.02, 0.3, 0.38]
    keep = lambda t: (F.col("e") > t) & (F.col("e") < 1 - t)
    one = rows.agg(*[c.alias(f"{k}_{i}") for i, t in enumerate(trims) for k, c in (
        ("p", F.avg(F.when(keep(t), F.col("psi"))) * 100), ("n", F.count_if(keep(t))), ("s", F.coalesce(F.try_divide(F.pow(F.sum(F.when(keep(t), F.col("w"))), 2), F.sum(F.when(keep(t), F.col("w") * F.col("w")))), F.lit(0.0))))])
    settings = F.array(*[F.struct(F.lit(t).alias("trim"), F.round(f"p_{i}", 5).alias("point"), F.col(f"n_{i}").alias("n"), F.round(f"s_{i}", 2).alias("ess")) for i, t in enumerate(trims)])
    return one.select(F.inline(settings))


def robustness_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """The adjusted estimate with one choice changed at a time, from one pass over the influence values: trim, weights for
    unobserved outcomes left out, outcome model only, weights only, and the overlap-weighted form."""
    rows = E.influence(E.rate_nuisances(units(spark, sf), strata=["segment", "nation"]), trim=1e-6)
    a, y, d, e, m1, m0, kc = (F.col(c) for c in ("a", "y", "d", "e", "m1", "m0", "kc"))
    keep = lambda t: (e > t) & (e < 1 - t)
    own = m1 - m0 + d * (a * (y - m1) / e - (1 - a) * (y - m0) / (1 - e))
    ipw = d / kc * (a * y / e - (1 - a) * y / (1 - e))
    mean = lambda c, t=0.02: F.avg(F.when(keep(t), c)) * 100
    swaps = {"primary": mean(F.col("psi")), "trim 0.05": mean(F.col("psi"), 0.05), "no censoring weights": mean(own), "outcome model only": mean(m1 - m0), "weights only": mean(ipw),
             "overlap weights": F.sum(F.when(keep(0.02), F.col("psi_ato"))) / F.sum(F.when(keep(0.02), F.col("h"))) * 100}
    one = rows.agg(*[v.alias(f"s{k}") for k, v in enumerate(swaps.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("swap"), F.round(f"s{k}", 5).alias("point"), F.round(F.col(f"s{k}") - F.col("s0"), 5).alias("shift")) for k, name in enumerate(swaps)])
    return one.select(F.inline(cells))


def guarded(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted effect of each nation and segment; estimates that can't be (beyond 100 points) or rest on few units become null and are marked."""
    rows = E.influence(E.rate_nuisances(units(spark, sf), strata=["segment", "nation"]), trim=1e-6)
    u = rows.groupBy("nation", "segment").agg((F.avg("psi") * 100).alias("raw"), F.count(F.lit(1)).alias("n"))
    fine = F.coalesce((F.abs("raw") <= 100) & (F.col("n") >= 5), F.lit(False))
    return u.select("nation", "segment", "n", F.when(fine, F.round("raw", 5)).alias("point"), F.when(fine, "ok").otherwise("undefined").alias("status"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by what they ordered: sizes of intersection, union and difference of two sets."""
    o = table(spark, sf, "orders")
    urgent, low = (o.where(F.col("o_orderpriority") == p).select("o_custkey").distinct() for p in ("1-URGENT", "5-LOW"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count(urgent.intersect(low), "both").unionByName(count(urgent.union(low).distinct(), "either")).unionByName(count(urgent.subtract(low), "urgent only"))


def tail_band(spark: SparkSession, sf: str) -> DataFrame:
    """Empirical band of prices by priority, the share above a limit, and the order with the least price."""
    orders = table(spark, sf, "orders")
    band = R.percentiles(orders, ["o_orderpriority"], "o_totalprice", {"low": 0.025, "high": 0.975}).withColumnRenamed("o_orderpriority", "_priority")
    rest = orders.groupBy("o_orderpriority").agg(
        F.round(F.avg((F.col("o_totalprice") > 200000).cast("double")), 8).alias("above"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"))
    return rest.join(band, F.col("o_orderpriority").eqNullSafe(F.col("_priority")), "left").select("o_orderpriority", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "above", "cheapest")


def welch(spark: SparkSession, sf: str) -> DataFrame:
    """Welch's t and its degrees of freedom for prices of urgent against other orders, by segment."""
    u = units(spark, sf).groupBy("segment").agg(*[
        f(F.when(F.col("a") == a, F.col("log_price"))).alias(f"{k}{a}") for a in (1, 0) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    q1, q0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(q1 + q0))
    freedom = F.try_divide(F.pow(q1 + q0, 2), F.pow(q1, 2) / (F.col("n1") - 1) + F.pow(q0, 2) / (F.col("n0") - 1))
    return u.select("segment", F.round(t, 6).alias("t"), F.round(freedom, 4).alias("freedom"))


def scope_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Units, arm share and outcome with and without the requirement of line items, and how far they shift."""
    u = units(spark, sf)
    stats = lambda c, tag: [F.count_if(c).alias(f"n_{tag}"), F.avg(F.when(c, F.col("a"))).alias(f"a_{tag}"), F.avg(F.when(c & (F.col("d") == 1), F.col("y"))).alias(f"y_{tag}")]
    got = u.groupBy("segment").agg(*stats(F.lit(True), "all"), *stats(F.col("lines").isNotNull(), "gated"))
    return got.select("segment", "n_all", "n_gated", F.round(F.col("a_gated") - F.col("a_all"), 8).alias("arm_shift"), F.round(F.col("y_gated") - F.col("y_all"), 8).alias("outcome_shift"))


_CELLS = f"""{_UNITS}, g AS (SELECT segment, nation, fold, count(*) AS n, sum(a) AS sa, sum(d) AS sd, count(*) FILTER (a = 1 AND d = 1) AS n1, coalesce(sum(y) FILTER (a = 1 AND d = 1), 0) AS y1, count(*) FILTER (a = 0 AND d = 1) AS n0, coalesce(sum(y) FILTER (a = 0 AND d = 1), 0) AS y0 FROM u GROUP BY 1, 2, 3),
k AS (SELECT segment, nation, fold, sum(n) OVER c - n AS n, sum(sa) OVER c - sa AS sa, sum(sd) OVER c - sd AS sd, sum(n1) OVER c - n1 AS n1, sum(y1) OVER c - y1 AS y1, sum(n0) OVER c - n0 AS n0, sum(y0) OVER c - y0 AS y0 FROM g WINDOW c AS (PARTITION BY segment, nation)),
w AS (SELECT fold, sum(n) AS n, sum(sa) AS sa, sum(sd) AS sd, sum(n1) AS n1, sum(y1) AS y1, sum(n0) AS n0, sum(y0) AS y0 FROM g GROUP BY 1), b AS (SELECT a.fold, sum(b.sa)::DOUBLE / sum(b.n) AS e, sum(b.y1)::DOUBLE / sum(b.n1) AS m1, sum(b.y0)::DOUBLE / sum(b.n0) AS m0, sum(b.sd)::DOUBLE / sum(b.n) AS kc FROM w a JOIN w b ON a.fold <> b.fold GROUP BY 1),
r AS (SELECT u.*, least(greatest(coalesce(k.sa::DOUBLE / nullif(k.n, 0), b.e, 0), 1e-6), 1 - 1e-6) AS e, coalesce(k.y1::DOUBLE / nullif(k.n1, 0), b.m1, 0) AS m1, coalesce(k.y0::DOUBLE / nullif(k.n0, 0), b.m0, 0) AS m0, least(greatest(coalesce(k.sd::DOUBLE / nullif(k.n, 0), b.kc, 0), 1e-6), 1.0) AS kc
  FROM u JOIN k USING (segment, nation, fold) JOIN b USING (fold)),
p AS (SELECT *, (m1 - m0) + d / kc * (a * (y - m1) / e - (1 - a) * (y - m0) / (1 - e)) AS psi, CASE WHEN a = 1 THEN 1 / e ELSE 1 / (1 - e) END AS wt FROM r), t(trim) AS (VALUES (0.02::DOUBLE), (0.3::DOUBLE), (0.38::DOUBLE))"""

ORACLES = {
    "subgroup_effects": f"""{_UNITS}, {_psi('naive', chr(39) + 'all' + chr(39))}, s AS (SELECT segment, avg(psi) * 100 AS point, stddev_samp(psi) / sqrt(count(psi)) * 100 AS se, count(psi) AS n FROM naive_p GROUP BY 1
  HAVING count(*) FILTER (a = 1 AND d = 1 AND y = 1) >= 20 AND count(*) FILTER (a = 0 AND d = 1 AND y = 1) >= 20), f AS (SELECT *, first_value(point) OVER (ORDER BY segment) AS p0, first_value(se) OVER (ORDER BY segment) AS s0 FROM s)
SELECT segment, n, round(point, 5) AS point, round(point - p0, 5) AS difference, round((point - p0) / sqrt(se * se + s0 * s0), 5) AS z FROM f""",
    "guarded": f"""{_CELLS}, q AS (SELECT nation, segment, count(*) AS n, avg(psi) * 100 AS raw FROM p GROUP BY 1, 2)
SELECT nation, segment, n, CASE WHEN abs(raw) <= 100 AND n >= 5 THEN round(raw, 5) END AS point, CASE WHEN abs(raw) <= 100 AND n >= 5 THEN 'ok' ELSE 'undefined' END AS status FROM q""",
    "robustness_swaps": f"""{_CELLS}, i AS (SELECT *, (m1 - m0) + d * (a * (y - m1) / e - (1 - a) * (y - m0) / (1 - e)) AS own, d / kc * (a * y / e - (1 - a) * y / (1 - e)) AS ipw, e * (1 - e) AS h, e * (1 - e) * (m1 - m0) + d / kc * (a * (1 - e) * (y - m1) - (1 - a) * e * (y - m0)) AS ato FROM p),
o AS (SELECT avg(psi) * 100 AS s0, avg(psi) FILTER (e > 0.05 AND e < 0.95) * 100 AS s1, avg(own) * 100 AS s2, avg(m1 - m0) * 100 AS s3, avg(ipw) * 100 AS s4, sum(ato) / sum(h) * 100 AS s5 FROM i WHERE e > 0.02 AND e < 0.98)
SELECT swap, round(v, 5) AS point, round(v - s0, 5) AS shift FROM (SELECT s0, unnest(['primary', 'trim 0.05', 'no censoring weights', 'outcome model only', 'weights only', 'overlap weights']) AS swap, unnest([s0, s1, s2, s3, s4, s5]) AS v FROM o)""",
    "set_operations": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
SELECT 'both' AS what, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'urgent only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "tail_band": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 4) AS low, round(quantile_cont(o_totalprice, 0.975), 4) AS high, round(avg((o_totalprice > 200000)::INT), 8) AS above, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1",
    "welch": f"""{_UNITS}, g AS (SELECT segment, avg(log_price) FILTER (a = 1) AS m1, var_samp(log_price) FILTER (a = 1) / count(log_price) FILTER (a = 1) AS q1, count(log_price) FILTER (a = 1) AS n1, avg(log_price) FILTER (a = 0) AS m0,
  var_samp(log_price) FILTER (a = 0) / count(log_price) FILTER (a = 0) AS q0, count(log_price) FILTER (a = 0) AS n0 FROM u GROUP BY 1) SELECT segment, round((m1 - m0) / sqrt(q1 + q0), 6) AS t, round((q1 + q0) * (q1 + q0) / (q1 * q1 / (n1 - 1) + q0 * q0 / (n0 - 1)), 4) AS freedom FROM g""",
    "scope_shift": f"""{_UNITS} SELECT segment, count(*) AS n_all, count(lines) AS n_gated, round(avg(a) FILTER (lines IS NOT NULL) - avg(a), 8) AS arm_shift, round(avg(y) FILTER (lines IS NOT NULL AND d = 1) - avg(y) FILTER (d = 1), 8) AS outcome_shift FROM u GROUP BY 1""",
    "robustness": f"{_CELLS} SELECT trim, round(avg(psi) * 100, 5) AS point, count(*) AS n, round(sum(wt) * sum(wt) / sum(wt * wt), 2) AS ess FROM t JOIN p ON e > trim AND e < 1 - trim GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (subgroup_effects, robustness, robustness_swaps, guarded, set_operations, tail_band, welch, scope_shift)}
