"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import pytest
from conftest import same_rows
from stratalog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_duckdb(name, spark, duck, sf):
    same_rows(catalog.queries()[name](spark, sf), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql_has_rows(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())
