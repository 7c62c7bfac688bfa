"""Queries of this subpackage that have SQL give the rows of DuckDB; the others run on the small tables."""

import pytest

import corpus_pipeline
from check import database, rows_of, type_faults
from waxworks.llm import registry

QUERIES, ORACLE = registry.load()


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cur = database(folder).execute(ORACLE[name])
    assert not type_faults(df.dtypes, [(d[0], d[1]) for d in cur.description])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
