from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import estimate as E, ranking as R, statistics as S
from tidewell.operators.canonical import clean
from tidewell.operators.vectors import pool, pooled_array


def test_running_sums_ranks_and_ties(spark):
    rows = [(random.Random(k).randrange(50),) for k in range(400)]
    df = spark.createDataFrame(rows, "x int").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    run, want = {r.x: r.run_n for r in R.running_sums(df, ["x"], ["n"], 5).collect()}, 0
    for x in sorted(run):
        want += sum(1 for (v,) in rows if v == x)
        assert run[x] == want


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (None, 1)], "s double, y int")
    assert R.auc(df, "s", "y").first().auroc == pytest.approx(3.5 / 4)
    assert R.average_precision(df, "s", "y").first().average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert R.auc(df.where("y = 1"), "s", "y").first().auroc is None


def test_adjusted_p_is_monotone(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, None, 0.039]
    got = sorted((r.p, r.q) for r in R.adjusted_p(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", "k").collect())
    have = sorted(x for x in p if x is not None)
    want = np.minimum(1, np.minimum.accumulate((np.array(have) * len(have) / np.arange(1, len(have) + 1))[::-1])[::-1])
    assert [q for _, q in got] == pytest.approx(list(want))


def test_e_values_and_divergence(spark):
    r = spark.range(1).select(S.e_value(F.lit(10.0), F.lit(20.0)).alias("e"), S.e_value(F.lit(-30.0), F.lit(20.0)).alias("none"), S.e_value_limit(F.lit(-1.0), F.lit(2.0), F.lit(20.0)).alias("one"),
                              S.divergence_z(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert r.e == pytest.approx(1.5 + (1.5 * 0.5) ** 0.5) and r.none is None and r.one == 1.0 and r.z is None


def test_estimators_recover_a_planted_effect(spark):
    rng = np.random.default_rng(0)
    n = 6000
    x = rng.normal(size=n)
    a = rng.random(n) < 1 / (1 + np.exp(-x))
    y = rng.random(n) < np.clip(0.35 + 0.12 * x + 0.15 * a, 0, 1)
    d = rng.random(n) < 0.9
    df = spark.createDataFrame([(k, k, int(a[k]), int(y[k]), int(d[k]), float(x[k])) for k in range(n)], "id bigint, cluster bigint, a int, y int, d int, x double")
    naive = E.influence(E.rate_nuisances(df)).agg(*S.influence_summary("psi", "keep")).first()
    rows = E.model_nuisances(df, ["x"])
    aipw = E.influence(rows).agg(*S.influence_summary("psi", "keep"), E.effective_size("w", "keep").alias("ess")).first()
    tmle = E.targeted(rows).agg(*S.influence_summary("psi", "keep")).first()
    assert naive.point > 20
    assert abs(aipw.point - 15) < 4 and abs(tmle.point - 15) < 4 and abs(aipw.point - tmle.point) < 1
    assert 0 < aipw.ess <= n


def test_bootstrap_is_paired_and_centred(spark):
    df = spark.range(2000).select(F.col("id").alias("cluster"), (F.col("id") % 7).cast("double").alias("v"), F.lit(True).alias("keep"))
    b = E.bootstrap(df, "v", "keep", "cluster", 30).toPandas()
    assert abs(b["value"].mean() - df.agg(F.avg("v")).first()[0]) < 0.05 and b["value"].std() > 0
    assert b.equals(E.bootstrap(df.repartition(5), "v", "keep", "cluster", 30).orderBy("b").toPandas()) or np.allclose(b.sort_values("b")["value"], E.bootstrap(df, "v", "keep", "cluster", 30).toPandas().sort_values("b")["value"])


def test_one_strong_nation_survives_correction(spark):
    from tidewell.plans.effects import REPLICATES, _nation_fdr

    rows = [(k, k % 500, k % 25, (k // 25) % 2) for k in range(5000)]
    df = spark.createDataFrame(rows, "id bigint, cluster bigint, nation int, a int").withColumns(
        {"d": F.lit(1), "y": F.when(F.col("nation") == 3, F.col("a")).otherwise((E.hash_unit(F.col("id")) < 0.5).cast("int"))})
    q = {r.nation: r.q for r in _nation_fdr(df, REPLICATES).collect()}
    assert REPLICATES >= 2000 and q[3] <= 0.05 and len(q) == 25
    assert next(r.q for r in _nation_fdr(df, 40).collect() if r.nation == 3) > 0.05


def test_overlap_weighted_form_has_its_own_replicates(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("c"), F.col("id").cast("double").alias("x"), (F.col("id") % 3 + 1).alias("h"))
    rows = df.toPandas()
    got = E.bootstrap_ratios(df, {"ato": (F.col("x"), F.col("h"))}, "c", 3).collect()
    weights = {(r.b, r.c): r.w for r in spark.range(40).withColumnRenamed("id", "c").join(spark.range(3).withColumnRenamed("id", "b")).withColumn("w", E.poisson_weight(E.hash_unit(F.lit(1), F.col("b"), F.col("c")))).collect()}
    for r in got:
        w = np.array([weights[r.b, c] for c in rows["c"]])
        assert r.ato == pytest.approx((w * rows["x"]).sum() / (w * rows["h"]).sum())


def test_resampled_areas_against_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(k, k % 30, rng.randrange(12) / 12, int(rng.random() < 0.4)) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, c int, p double, y int")
    got = {r.b: r for r in R.resampled_curves(df, "p", "y", "c", 3).collect()}
    for b in range(3):
        drawn = df.withColumn("k", F.explode(F.array_repeat(F.lit(1), E.poisson_weight(E.hash_unit(F.lit(1), F.lit(b), F.col("c"))))))
        assert got[b].auroc == pytest.approx(R.auc(drawn, "p", "y").first().auroc)
        assert got[b].average_precision == pytest.approx(R.average_precision(drawn, "p", "y").first().average_precision)


def test_cost_is_the_share_of_effective_sample(spark):
    r = spark.range(1).select(S.positivity_cost(F.lit(200.0), F.lit(150.0)).alias("c"), S.positivity_cost(F.lit(0.0), F.lit(1.0)).alias("none")).first()
    assert r.c == 0.25 and r.none is None


def test_folds_partition_the_rows(spark):
    f = spark.range(5000).select(E.fold("id").alias("f")).groupBy("f").count().collect()
    assert sorted(r.f for r in f) == [0, 1, 2, 3, 4] and min(r["count"] for r in f) > 800


def test_cleaning_edges(spark):
    rows = [("chart", "220045", None), ("chart", "220045", 300.0), ("chart", "220045", 301.0), ("chart", "x", None), ("chart", "x", 1e6), ("chart", "x", -1000001.0), ("input", "x", 1e9), ("lab", "50912", float("nan"))]
    got = [r.keep for r in clean(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, modality string, type string, value_num double")).orderBy("k").collect()]
    assert got == [False, True, False, True, True, False, True, False]


def test_pooling(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [3.0, None]), ("b", None)], "k string, v array<double>")
    assert {r.k: r.v for r in pooled_array(df, ["k"], "v").collect()} == {"a": [2.0, 5.0]}
    assert {r.k: r.v for r in pooled_array(df, ["k"], "v", "max").collect()} == {"a": [3.0, 5.0]}


def test_pooling_of_short_null_and_missing_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, None, -3.0]), ("a", [3.0]), ("a", None), ("b", [None, -2.0]), ("c", None), (None, [7.0])], "k string, v array<double>").withColumn("_size", F.lit("clash"))
    got = sorted(((r.k, r.pos, r["mean"], r["max"]) for r in pool(df, ["k"], "v").collect()), key=repr)
    assert got == sorted([("a", 0, 2.0, 3.0), ("a", 1, None, None), ("a", 2, -3.0, -3.0), ("b", 0, None, None), ("b", 1, -2.0, -2.0), (None, 0, 7.0, 7.0)], key=repr)
    assert pool(df.limit(0), ["k"], "v").count() == 0 and pool(df.where("v is null"), [], "v").count() == 0


def test_logistic_models_of_all_folds_at_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))
    fold = np.arange(3000) % 3
    rows = [(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(x, y, fold)] + [(None, 1.0, 1, 0), (1.0, 1.0, None, 1)]
    got = E.logistics(spark.createDataFrame(rows, "u double, v double, y int, fold int"), {"both": (["u", "v"], "y", None), "some": (["u"], "y", F.col("v") > 0), "flat": (["u"], "fold", F.col("fold") == 1)}, "fold", 3)
    for name, cols, take in (("both", [0, 1], np.ones(3000, bool)), ("some", [0], x[:, 1] > 0)):
        for g in range(3):
            t = take & (fold != g)
            z, beta = np.c_[np.ones(t.sum()), x[t][:, cols]], np.zeros(len(cols) + 1)
            for _ in range(30):
                q = 1 / (1 + np.exp(-z @ beta))
                beta += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-3 * np.diag([0] + [1] * len(cols)), z.T @ (y[t] - q) - 1e-3 * np.r_[0, beta[1:]])
            assert np.allclose(got[name][g], beta, atol=1e-5)
    assert np.isfinite(got["flat"][1]).all()


def test_areas_by_group_equal_those_of_each_group(spark):
    random.seed(9)
    rows = [(random.choice("xy"), random.choice([1.0, 2.0, 2.5, None]), random.choice([0, 1, None])) for _ in range(300)] + [("one", 1.0, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {r.g: (r.n_pos, r.n_neg, r.auroc) for r in R.auc_by(df, ["g"], "s", "y").collect()}
    for g in ("x", "y", "one"):
        assert got[g] == pytest.approx(tuple(R.auc(df.where(F.col("g") == g), "s", "y").first()))
    assert set(got) == {"x", "y", "one"}


def test_reduced_scores_see_neither_fold(spark):
    rng = np.random.default_rng(5)
    x, fold = rng.normal(size=(600, 2)), np.arange(600) % 3
    y = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0] + 0.5 * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(k, *map(float, r), int(c), int(f)) for k, (r, c, f) in enumerate(zip(x, y, fold))], "id int, u double, v double, y int, fold int")
    got = E.reduced_scores(df, ["u", "v"], "y", "s", 3).orderBy("id").toPandas()

    def fitted(train):
        z, beta = np.c_[np.ones(train.sum()), x[train]], np.zeros(3)
        for _ in range(30):
            q = 1 / (1 + np.exp(-z @ beta))
            beta += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-3 * np.diag([0, 1, 1]), z.T @ (y[train] - q) - 1e-3 * np.r_[0, beta[1:]])
        return 1 / (1 + np.exp(-np.c_[np.ones(600), x] @ beta))

    for g in range(3):
        for f in range(3):
            own = fold == f
            assert np.allclose(got[f"s_{g}"][own], fitted((fold != f) & (fold != g))[own], atol=1e-5)


def test_reduced_blocks_remove_planted_confounding(spark):
    df = spark.range(6000).select("id", (E.hash_unit(F.lit("c"), F.col("id")) - 0.5).alias("c"), F.lit(0.0).alias("x"))
    df = df.withColumn("a", (E.hash_unit(F.lit("a"), F.col("id")) < 1 / (1 + F.exp(-4 * F.col("c")))).cast("int"))
    df = df.withColumn("y", (E.hash_unit(F.lit("y"), F.col("id")) < 0.4 + 0.1 * F.col("a") + 0.6 * F.col("c")).cast("int")).withColumn("d", F.lit(1))
    point = lambda rows: E.influence(rows).agg(S.influence_summary("psi", "keep")[0]).first().point
    assert abs(point(E.reduced_nuisances(df, ["x"], ["c"])) - 10) < 3.5 < abs(point(E.rate_nuisances(df)) - 10)
