from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidewell.operators.components import components
from tidewell.operators.splits import balanced_splits, difference


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in parent}


def test_components_of_chains_stars_and_odd_edges(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(None, 3), (5, None), (7, 7), (1, 0), (0, 1)] + [(200, 201)] * 3
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == _brute(edges)


def test_components_against_brute_force(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == _brute(edges)


def test_only_the_last_round_stays_written(spark):
    from pathlib import Path

    from tidewell import session

    before = session.cut(spark.range(1))
    folder = Path(before._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")).parent
    made = set(folder.iterdir())
    got = components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a bigint, b bigint"))
    assert len(set(folder.iterdir()) - made) <= 1 and got.count() == 51
    session.uncut(before)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_difference_balances_and_places_all():
    random.seed(1)
    weights = [random.choice([1, 1, 2, 3, 50]) for _ in range(500)]
    bins = defaultdict(float)
    for w, b in zip(weights, difference(weights, 20)):
        bins[b] += w
    assert len(bins) == 20 and max(bins.values()) - min(bins.values()) <= 2
    assert difference([], 4) == [] and set(difference([1.0] * 3, 4)) == {0, 1, 2}


def test_splits_keep_groups_and_shares(spark):
    random.seed(2)
    rows = [(f"g{k}", float(random.choice([1, 1, 1, 2, 5, 20]))) for k in range(3000)] + [("hot", 400.0), (None, 5.0), ("zero", None)]
    groups = spark.createDataFrame(rows, "group_id string, weight double")
    got = balanced_splits(groups, [("train", 0.8), ("validate", 0.1), ("test", 0.1), ("none", 0.0)], bins=50, block=700).collect()
    assert len(got) == len({r.group_id for r in got}) == 3002
    total, by = sum(r.weight for r in got), defaultdict(float)
    for r in got:
        by[r.split] += r.weight
    assert set(by) == {"train", "validate", "test"}
    assert abs(by["train"] / total - 0.8) < 0.03 and abs(by["test"] / total - 0.1) < 0.03
    again = balanced_splits(groups.repartition(7), [("train", 0.8), ("validate", 0.1), ("test", 0.1), ("none", 0.0)], bins=50, block=700).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert balanced_splits(groups.limit(0), [("train", 1.0)]).count() == 0


@pytest.mark.parametrize("kind", ["equal", "heavy tail", "giant"])
def test_bins_of_many_blocks_are_as_even_as_of_one(spark, monkeypatch, kind):
    from tidewell.operators import splits as S

    random.seed(8)
    n, bins = 12_800, 10
    weights = [3.0] * n if kind == "equal" else [float(int(random.paretovariate(1.2)) + 1) for _ in range(n)]
    if kind == "giant":
        weights[77] = sum(weights) / 2
    one = defaultdict(float)
    for w, b in zip(weights, difference(weights, bins)):
        one[b] += w
    mean, seen = sum(weights) / bins, {}
    monkeypatch.setattr(S, "_allocate", lambda slots, targets: seen.update(slots) or {b: "x" for b, _ in slots})
    groups = spark.createDataFrame(list(enumerate(weights)), "group_id bigint, weight double")
    for blocks in (1, 2, 8, 16):
        seen.clear()
        assert balanced_splits(groups, [("x", 1.0)], bins, n // blocks).count() == n
        assert len(seen) == bins and sum(seen.values()) == sum(weights)
        assert max(seen.values()) / mean <= max(one.values()) / mean + 0.002
