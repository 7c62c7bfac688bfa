import itertools
import random

import numpy as np

from waxworks.llm.packing import best_boundaries, pack, with_bytes


def padding(counts, ends):
    return sum(int(c) * (min(e for e in ends if e > u) - u - 1) for u, c in enumerate(counts) if c)


def test_boundaries_are_the_best_of_all():
    rnd = random.Random(3)
    for _ in range(60):
        counts = np.array([rnd.choice([0, 0, 1, 5, 30]) for _ in range(rnd.randrange(1, 9))])
        k = rnd.randrange(1, 5)
        ends = best_boundaries(counts, k)
        if not counts.any():
            assert ends == []
            continue
        last = int(np.flatnonzero(counts)[-1]) + 1
        ways = [(*c, last) for n in range(min(k, last)) for c in itertools.combinations(range(1, last), n)]
        assert len(ends) <= k and padding(counts, ends) == min(padding(counts, w) for w in ways)


def test_batches(spark):
    rnd = random.Random(1)
    rows = [(i, "é" * rnd.randrange(0, 90)) for i in range(300)] + [(301, None), (302, ""), (303, "x" * 1000), (7, "again"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, longest=128, budget=512, buckets=4, step=8).collect()
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
        assert r["start"] == 128 * r["part"] and r["length"] <= min(128, r["padded"])
    want = {}
    for k, t in rows:
        want[k] = want.get(k, 0) + len((t or "").encode())
    assert sizes == want and len({r["bucket"] for r in got}) <= 4
    by = {}
    for r in got:
        by.setdefault((r["bucket"], r["padded"]), {}).setdefault(r["batch"], []).append(r["place"])
    for (_, padded), batches in by.items():
        full = max(1, 512 // padded)
        assert sorted(batches) == list(range(len(batches)))
        for b, places in batches.items():
            assert sorted(places) == list(range(len(places)))
            assert len(places) == full or b == len(batches) - 1 and len(places) < full
    assert pack(df.filter("false")).collect() == []


def test_bytes_come_back(spark):
    rows = [(1, "äb" * 100), (2, "c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = {}
    for r in with_bytes(pack(df, longest=64), df).orderBy("doc_id", "part").collect():
        parts[r["doc_id"]] = parts.get(r["doc_id"], b"") + bytes(r["tokens"])
    assert parts == {k: (t or "").encode() for k, t in rows}
