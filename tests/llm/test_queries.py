"""The text queries on the smallest tables and on odd ones."""

from __future__ import annotations

import pytest

from tests.oracle import spark_rows
from tidewell.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, variants, name):
    assert QUERIES[name](spark, variants[0]).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_extra_columns_and_null_rows(spark, small, variants, name):
    dirty, clean = QUERIES[name](spark, variants[1]), QUERIES[name](spark, small)
    if name == "p7_ids":
        dirty = dirty.where("doc_id is not null")
    assert spark_rows(dirty) == spark_rows(clean)


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
