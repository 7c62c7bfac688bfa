import random
import re

import numpy as np
import pytest

from waxworks.llm import jaccard_join as jj
from waxworks.llm.components import components


def member_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """n_shingles and least reachable key of every row, from all pairs."""
    sets = [(k, member_set(t)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted((k, len(s), root(k)) for k, s in sets)


def documents(seed=4, bases=30):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6)))
    out = []
    line = " ".join(word() for _ in range(25))
    for _ in range(bases):
        size = rnd.choice([3, 5, 6, 9, 20, 60, 63, 70, 130, 300, 700])
        base = [word() for _ in range(size)]
        if rnd.random() < 0.5:
            base = base[: size // 2] + line.split() + base[size // 2 :]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 25)):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.3:
                copy += [word() for _ in range(rnd.randrange(1 + len(copy) // 3))]
            out.append(" ".join(w.upper() if rnd.random() < 0.05 else w for w in copy))
    out += ["", None, "  \n ", "one two", "ONE\ttwo", "one two three four", line, line + " end", "x"] + [line] * 4
    rnd.shuffle(out)
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def run(spark, rows, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in jj.jaccard_components(spark.createDataFrame(rows, schema)).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("few, tile", [(128, 1024), (1, 1024), (2, 3)])
def test_same_as_all_pairs(spark, monkeypatch, few, tile):
    monkeypatch.setattr(jj, "_FEW", few)
    monkeypatch.setattr(jj, "_TILE", tile)
    rows = documents()
    assert run(spark, rows) == brute(rows)


def test_similar_rows_share_a_key():
    rnd = np.random.default_rng(2)
    for size in (1, 2, 3, 4, 7, 20, 63, 64, 90, 128, 170, 500, 1500):
        for frequent in (False, True):
            a = rnd.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)
            for _ in range(40):
                gone = rnd.integers(0, 1 + size // 7)
                rest = size - gone
                more = rnd.integers(0, 1 + max(0, int(rest / 0.75 - size)))
                b = np.concatenate([rnd.permutation(a)[:rest], rnd.integers(0, 1 << 63, more).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
                assert jj.similar(len(a), len(b), rest)
                table = np.sort(np.concatenate([a[::2], b[-1:]])) if frequent else np.empty(0, np.uint64)
                row = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
                keys, of = jj.block_keys(np.concatenate([np.sort(a), np.sort(b)]), row, 2, table)
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
                apart = np.bitwise_count(np.frombuffer(jj.sketch(a), np.uint64) ^ np.frombuffer(jj.sketch(b), np.uint64)).sum()
                assert apart <= gone + more <= jj.most_different(len(a), len(b))


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "q r s t u v w", 3), (4, "q r s t u v w", 4), (6, None, 5)]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 2, 0), (4, 3, 4), (5, 2, 4), (5, 3, 4), (6, 0, 6)]
    assert run(spark, []) == []


def test_keep_one(spark):
    rows = documents(9, 12)
    want = {c for _, n, c in brute(rows)}
    assert {r["doc_id"] for r in jj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_keep_one_of_null_and_repeated_keys(spark):
    one, two, three, four = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    rows = [(None, one, 1), (None, two, 2), (None, None, 3), (7, three, 4), (7, three, 5), (5, four, 6), (9, four, 7), (9, "1 2 3 4 5 6 7", 8), (None, four, 9), (None, one, 10)]
    got = jj.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert got.columns == ["doc_id", "text", "n"]
    kept = sorted(r["n"] for r in got.collect())
    assert [n for n in kept if n not in (1, 4, 5, 10)] == [2, 3, 6, 8] and len({1, 10} & set(kept)) == len({4, 5} & set(kept)) == 1
    named = spark.createDataFrame([("b", one), ("a", one), ("c", two), (None, three)], "doc_id string, text string")
    assert sorted(r["doc_id"] or "" for r in jj.keep_one(named).collect()) == ["", "a", "c"]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)] + [(500, 500)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    want = {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_stars_need_no_round(spark, monkeypatch):
    from waxworks.llm import components as cc

    rounds = []
    monkeypatch.setattr(cc, "stable", lambda df, keep=cc.stable: rounds.append(1) or keep(df))
    for edges, most in (([(1, i) for i in range(2, 40)] + [(50, 51)], 1), ([(i, i + 1) for i in range(8)], 4), ([(3, 3)], 1)):
        rounds.clear()
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: (50 if x >= 50 else min(min(edges))) for e in edges if e[0] != e[1] for x in e}
        assert len(rounds) <= most


def test_components_are_found_over_all_links_once(spark, monkeypatch):
    """Later rounds see links between components only."""
    calls = []
    monkeypatch.setattr(jj, "components", lambda links, find=jj.components: calls.append(1) or find(links))
    rows = documents(bases=8)
    assert run(spark, rows) == brute(rows)
    assert len(calls) == 1
