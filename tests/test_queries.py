"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

import pytest

from catalog import load
from check import database, rows_of

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con(folder):
    pytest.importorskip("duckdb")
    return database(folder)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
