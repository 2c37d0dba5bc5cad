"""Every query that SQL can express agrees with DuckDB."""

import pytest
from conftest import SMALL
from twin import same

from pairloom.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_duckdb(spark, name):
    same(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"diff"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_names_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["type", "line", "address", "name", "address2", "name2", "ratio", "nodes1", "nodes2", "description"]
