import math
import random

from pyspark.sql import functions as F

from waxworks.llm import exact_topk as et


def brute(rows, k, asked):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted(tuple(r) for r in et.exact_topk(df, F.col("vec_id") % 7 == 0, k).collect())


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(et, "BLOCK", 16)
    monkeypatch.setattr(et, "QUERY_BLOCK", 4)
    rnd = random.Random(1)
    vector = lambda: [rnd.choice([-1.0, -0.5, 0.25, 0.125, 2.0]) for _ in range(5)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector()) for i in range(120)]  # a third are one vector, so many ties
    rows += [(None, hot), (200, None), (203, [1.0, None, 0.0, 0.0, 0.0]), (210, [1.0, float("nan"), 0.0, 0.0, 0.0]), (217, [float("inf")] * 5), (224, [0.0] * 5), (231, [0.5, 0.5])]
    for k in (1, 5, 150):
        assert run(spark, rows, k) == brute(rows, k, lambda q: q % 7 == 0)


def test_small_tables(spark):
    assert run(spark, [], 3) == [] and run(spark, [(7, [1.0])], 3) == [] and run(spark, [(1, [1.0]), (2, [1.0])], 3) == []
    assert run(spark, [(7, [1.0]), (8, [0.5])], 3) == [(7, 1, 8, 64 * 32)]


def test_repeated_queries_get_the_results_of_each(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(30)] + [(0, [0.5, -1.0, 0.25, 2.0]), (7, [rnd.random() for _ in range(4)])]
    assert run(spark, rows, 20) == brute(rows, 20, lambda q: q % 7 == 0)
    assert sum(r[0] == 0 for r in run(spark, rows, 20)) == 40
