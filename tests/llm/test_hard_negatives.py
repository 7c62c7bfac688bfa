import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxworks.llm import hard_negatives as hn


def brute(rows, every, positives=5, negatives=3):
    usable = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in usable if i != a)
        for p, (s, i, _) in enumerate([x for x in scored if x[2] == label][:positives]):
            fit = [x for x in scored if x[2] != label and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, every, **more):
    df = spark.createDataFrame([(i, l, v, 0, 1) for i, l, v in rows], "vec_id long, label int, embedding array<float>, id int, asked int").repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, **more).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 2), (5, 7, 3), (33, 17, 41), (64, 64, 64), (70, 130, 9), (0, 3, 4)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(-(1 << 28), 1 << 28, (m, k)), rnd.integers(-(1 << 28), 1 << 28, (k, n))
    assert (hn.strassen(a, b, leaf=2) == a.astype(object) @ b.astype(object)).all()
    assert hn.strassen(a, b).shape == (m, n)


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hn, "_HELD", 50)
    rnd = random.Random(1)
    vector = lambda: [rnd.choice([-1.0, -0.5, 0.25, 0.125, 0.7, 2.0]) for _ in range(5)]
    hot = vector()
    rows = [(i, rnd.randrange(3), hot if i % 3 == 0 else vector()) for i in range(150)]  # a third are one vector, so many ties
    rows += [(None, 1, hot), (200, 1, None), (210, None, hot), (220, 1, [1.0, None]), (230, 1, [float("nan")] * 5), (240, 2, [float("inf")] * 5), (250, 0, [0.0] * 5), (251, 1, [0.5, 0.5]), (260, 0, [])]
    rows += [(20, 1, vector()), (33, 1, hot), (33, 1, hot)]  # repeated keys
    for every in (5, 7, 10):
        got = run(spark, rows, every)
        assert got and got == brute(rows, every)
    assert run(spark, rows, 10, positives=1, negatives=200) == brute(rows, 10, 1, 200)


def test_small_tables(spark):
    assert run(spark, [], 2) == [] and run(spark, [(2, 1, [1.0])], 2) == [] and run(spark, [(2, 1, [1.0]), (3, 1, [1.0])], 2) == []
    assert run(spark, [(2, 1, [1.0]), (3, 1, [1.0]), (5, 0, [0.75])], 2) == [(2, 3, 1, 5, 65536, 49152)]
    assert run(spark, [(2, 1, [1.0]), (3, 1, [-1.0]), (5, 0, [-0.75])], 2) == []  # no window below zero


def test_scores_that_leave_64_bits(spark):
    with pytest.raises(Exception, match="too large|64 bits"):
        run(spark, [(2, 1, [1e30]), (3, 1, [1.0])], 2)
