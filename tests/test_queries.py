"""Every catalogued query runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import pytest
from parity import same

from strandmill.plans import catalog

WITH_SQL = sorted(catalog.oracle_sql())
WITHOUT = sorted(set(catalog.queries()) - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, data, name):
    same(catalog.queries()[name](spark, data).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", WITHOUT)
def test_query_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
