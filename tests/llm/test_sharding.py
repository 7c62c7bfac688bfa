import hashlib
import zlib
from collections import Counter

import numpy as np

from waxworks.llm.sharding import assign_shards, jump, write_shards


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def test_jump_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
    for n in (1, 2, 7, 40):
        now, then = jump(keys, n), jump(keys, n + 1)
        assert now.tolist() == [plain_jump(int(k), n) for k in keys]
        assert ((now == then) | (then == n)).all()
        assert abs((then == n).mean() - 1 / (n + 1)) < 0.03


def test_rows(spark):
    rows = [(i, "é" * (i % 9)) for i in range(500)] + [(None, "a"), (None, None), (3, "same"), (3, "same"), (900, "")]
    got = assign_shards(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, shard string")).collect()
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), plain_jump(key_of(k), 40), plain_jump(key_of(k), 41)) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    assert {r["law"] for r in got} == {"key"}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_files(spark, tmp_path):
    df = spark.range(60).selectExpr("id as doc_id", "cast(id as string) as text")
    write_shards(df, str(tmp_path / "out"), shards=5)
    got = {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: plain_jump(key_of(i), 5) for i in range(60)}
