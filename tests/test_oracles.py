"""Every registered reference query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from compare import rows

from tidemark.plans import registry

SQL = registry.oracles()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, duck, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
