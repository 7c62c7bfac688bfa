import random
import re

import numpy as np
import pytest

from waxworks.llm import minhash_dedup as md


def member_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    """n_shingles, least reachable key and whether it stays, for every row, from all pairs."""
    sets = [(k, member_set(t)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted((k or -1, len(s), root(k) or -1, k is None or root(k) == k) for k, s in sets)


def documents(seed=4, bases=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6)))
    line = [word() for _ in range(40)]
    out = []
    for _ in range(bases):
        base = [word() for _ in range(rnd.choice([3, 4, 6, 9, 20, 60, 70, 130, 300, 700]))]
        if rnd.random() < 0.5:
            base = base[: len(base) // 2] + line + base[len(base) // 2 :]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 40)):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.3:
                copy += [word() for _ in range(rnd.randrange(1 + len(copy) // 4))]
            out.append(" ".join(w.upper() if rnd.random() < 0.05 else w for w in copy))
    text = " ".join(line)
    out += ["", None, "  \n ", "one two", "ONE\ttwo", "one two three four", text, text + " end", "x"] + [text] * 4
    rnd.shuffle(out)
    return [(1 + i * 7 % 1009, t) for i, t in enumerate(out)]


def run(spark, rows):
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, id long, values long")
    return sorted((r[0] or -1, r[1], r[2] or -1, r[3]) for r in md.near_copies(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("seed, tile", [(4, 512), (5, 3)])
def test_same_as_all_pairs(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(md, "_TILE", tile)
    rows = documents(seed)
    assert run(spark, rows) == brute(rows)


def test_a_group_that_no_centre_joins(spark):
    """A chain: each text is linked with its neighbours only, so a star around the first is not enough."""
    rnd = random.Random(7)
    words = [str(rnd.randrange(10**6)) for _ in range(900)]
    rows = [(i + 1, " ".join(words[20 * i : 20 * i + 300])) for i in range(30)]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows) and len({r[2] for r in brute(rows)}) == 1


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v w"), (4, "q r s t u v w"), (6, None), (7, ""), (8, "A b C d e F"), (None, "x"), (9, "x y z"), (10, "X Y z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, "word " * 300_000), (2, "word " * 200_000), (3, None)]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_signatures_estimate_the_similarity():
    rnd = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = rnd.integers(0, 1 << 62, int(2000 * share), dtype=np.uint64)
        rest = rnd.integers(0, 1 << 62, 2000 - len(both), dtype=np.uint64)
        half = len(rest) // 2
        sets = [np.sort(md.tb.mix(np.concatenate([both, x]))) for x in (rest[:half], rest[half:])]
        x, y = md.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
        assert abs((x == y).mean() - share) < 0.15


def test_no_link_is_dropped_by_signatures():
    """Pairs of just the similarity of a link share a band and pass each test, far more often than the docstring asks."""
    rnd = np.random.default_rng(5)
    for _ in range(300):
        size = int(rnd.integers(5, 400))
        both = rnd.integers(0, 1 << 62, size, dtype=np.uint64)
        more = rnd.integers(0, 1 << 62, size // 4, dtype=np.uint64)
        cut = int(rnd.integers(0, len(more) + 1))
        sets = [md.tb.mix(np.concatenate([both, x])) for x in (more[:cut], more[cut:])]
        values = md.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
        keys = md.band_keys(values)
        assert (keys[0] == keys[1]).any() and len(md._possible(values[0], values[1:])) == 1


def test_posterior_bound():
    """The finite sum is the tail of the posterior: against a numerical integral of the Beta density."""
    t = np.linspace(0, 1, 200_001)
    for n in md.STEPS:
        for miss in (1e-9, 1e-3):
            least = md.least_matches(n, miss)
            for m, above in ((least, True), (least - 1, False)):
                if m >= 0:
                    density = t**m * (1 - t) ** (n - m)
                    tail = density[t >= 0.8].sum() / density.sum()
                    assert (tail >= miss * 0.99) if above else (tail <= miss * 1.01)
    assert [md.least_matches(n) for n in md.STEPS] == sorted(md.least_matches(n) for n in md.STEPS)
