"""Every query with SQL against it, and the behaviour of all of them on odd tables."""

from __future__ import annotations

import pytest

from tests.oracle import connect, duck_rows, spark_rows
from tidewell.plans import catalogue

WITH_SQL = sorted(catalogue.ORACLES)
DEALT = sorted(q for q in catalogue.QUERIES if q[0] == "p" and q[1].isdigit())


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, small, name):
    assert spark_rows(catalogue.QUERIES[name](spark, small)) == duck_rows(connect(small), catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(WITH_SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() >= 0


@pytest.mark.parametrize("name", DEALT)
def test_empty_tables(spark, variants, name):
    assert catalogue.QUERIES[name](spark, variants[0]).count() == 0


@pytest.mark.parametrize("name", DEALT)
def test_copies_nulls_and_extra_columns_change_nothing(spark, small, variants, name):
    query = catalogue.QUERIES[name]
    assert spark_rows(query(spark, variants[1])) == spark_rows(query(spark, small))


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
