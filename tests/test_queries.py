"""Every registered query with a SQL twin gives the same columns and rows as DuckDB."""

import pytest

from catalog_queries import registry
from catalog_queries.check import compare

QUERIES = registry()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_equals_sql(spark, sf, duck, name):
    assert compare(QUERIES[name].run(spark, sf), QUERIES[name].sql, duck) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert first.count() > 0 and "wilson_lb" in first.columns
