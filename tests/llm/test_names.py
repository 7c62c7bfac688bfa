"""Columns of any name pass through the operators that keep a table's columns."""

import pytest
from pyspark.sql import functions as F

from waxworks.llm import language_id as li
from waxworks.llm import toxicity as tx
from waxworks.llm.quality_rules import keep_good, quality_rules

NAMES = ["doc_id", "text", "_text", "__text", "__letter", "a.b", "c0"]


@pytest.fixture
def rows(spark):
    words = " ".join(f"word{i}" for i in range(60))
    return spark.createDataFrame([(1, words, "x", "y", "z", "w", 1), (2, None, None, None, None, None, None)], "doc_id long, text string, `_text` string, `__text` string, `__letter` string, `a.b` string, c0 int")


def _kept(df):
    got = df.select(*[F.col(f"`{n}`") for n in NAMES if n != "text"]).orderBy("doc_id").collect()
    return [tuple(r) for r in got]


def test_names(spark, rows):
    want = [(1, "x", "y", "z", "w", 1), (2, None, None, None, None, None)]
    out = quality_rules(rows)
    assert _kept(out) == want and {r["doc_id"]: r["kept"] for r in out.collect()} == {1: True, 2: False}
    assert keep_good(rows).columns == rows.columns and keep_good(rows).count() == 1
    found = li.language_id(rows, ["a"], {})
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert _kept(tx.toxicity(rows, tx.fit(rows.select("doc_id", "text"), labels))) == want
    assert _kept(found) == want and [r["lang_pred"] for r in found.collect()] == [li.UNKNOWN] * 2
