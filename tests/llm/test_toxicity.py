import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxworks.llm import toxicity as tx


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rnd.randrange(5, 60))]
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["Blockhead", "numbskull", "nitwit"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"))
    return df, tx.fit(df, labels.filter("doc_id % 3 <> 1"))


def test_held_out_accuracy(model):
    df, fitted = model
    got = tx.toxicity(df.filter("doc_id % 3 = 1"), fitted).collect()
    assert sum(r["predicted"] == r["y"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= tx.THRESHOLD) for r in got)


def test_scores_are_sums_of_present_ngrams(model):
    _, fitted = model
    weight = dict(zip(fitted["hashes"].tolist(), fitted["weights"].tolist()))
    texts = ["", "x", "nitwit nitwit nitwit", "the numbskull", "é" * 9]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    maybe = np.zeros(1 << 20, bool)
    maybe[(fitted["hashes"] >> np.uint64(44)).astype(np.int64)] = True
    got = tx.score_rows(fitted, maybe, np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    for value, text in zip(got, texts):
        assert value == pytest.approx(sum(weight.get(h, 0.0) for h in tx._present(text).tolist()))


def test_odd_rows(spark, model):
    df, fitted = model
    rows = [(1, None, "a"), (None, "", "b"), (1, "nitwit " * 5000, "c"), (2, "ok", None), (2, "ok", None)]
    got = tx.toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string"), fitted).collect()
    assert got[0]["score"] == got[1]["score"] and got[2]["predicted"] == 1 and got[3] == got[4]
    empty = tx.fit(df, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int"))
    assert {r["score"] for r in tx.toxicity(df.limit(3), empty).collect()} == {0.5}
    assert tx.toxicity(df.filter("false"), fitted).collect() == []
