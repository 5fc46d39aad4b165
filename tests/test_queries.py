"""Every registered query runs; those with SQL must agree with DuckDB."""

import check
import pytest

from marketloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, duck, data_path, name):
    problems, _ = check.check(spark, duck, name, data_path)
    assert not problems


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data_path, name):
    out = catalog.QUERIES[name](spark, data_path)
    assert out.columns and out.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
