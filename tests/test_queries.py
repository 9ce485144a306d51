"""Every query that has SQL gives the rows of the SQL."""

import pytest
from compare import rows_of, views

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = views(sf).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry_has_rows(spark, sf):
    assert entry.entry(spark).count() > 0
