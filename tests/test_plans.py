"""Plans: what must reach the scan, and what must not appear."""

from __future__ import annotations

import re

import pytest

from tidewell.plans import catalogue


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read(plan: str, column: str) -> bool:
    return any(re.search(rf"\b{column}\b", schema) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found", "p6_found", "lookback_last", "interval_events", "asof_value", "near_exclusion", "episode_linkage", "clean_events"])
def test_no_pairs_of_everything(spark, small, name):
    plan = _plan(catalogue.QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_and_filters_reach_the_scan(spark, small):
    plan = _plan(catalogue.QUERIES["p4_found"](spark, small))
    assert not _read(plan, "value_txt") and not _read(plan, "uom") and "IsNotNull(value_num)" in plan
    plan = _plan(catalogue.QUERIES["p6_found"](spark, small))
    assert not _read(plan, "value_txt") and "PushedFilters: [" in plan
    plan = _plan(catalogue.QUERIES["keyword_regex"](spark, small))
    assert not _read(plan, "raw") and not _read(plan, "headers")


def test_units_need_no_shuffle_of_rows(spark, small):
    from tidewell.plans.common_units import converted

    assert "Exchange hashpartitioning" not in _plan(converted(spark, small))


@pytest.mark.parametrize("name", ["tail_band", "adaptive_arm"])
def test_no_group_is_held_for_its_percentiles(spark, small, name):
    assert not re.search(r"\bpercentile\(", _plan(catalogue.QUERIES[name](spark, small)))


def test_profile_expands_no_rows(spark, small):
    assert "Expand" not in _plan(catalogue.QUERIES["qc_profile"](spark, small))


def test_vectors_are_pooled_whole(spark, small):
    plan = _plan(catalogue.QUERIES["vector_pool"](spark, small))
    assert "posexplode" in plan and not re.search(r"posexplode\(embedding", plan)
