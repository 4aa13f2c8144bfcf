"""Every query with SQL agrees with DuckDB; the others return rows."""

from __future__ import annotations

import pytest
from oracle import DATA, compare

from fathomline.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_entry_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
