import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from waxworks.llm import suffix_dedup as sd


def brute(texts):
    """n_bytes, n_removed, n_spans, kept of each text, by a dictionary of all 200-byte strings."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, b in enumerate(raw):
        for p in range(len(b) - 199):
            seen[hash(b[p : p + 200]), b[p : p + 200]].append((i, p))
    hit = [np.zeros(len(b) + 1, np.int64) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                hit[i][p] += 1
                hit[i][p + 200] -= 1 if p + 200 < len(hit[i]) else 0
    out = []
    for b, h in zip(raw, hit):
        gone = np.cumsum(h)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(120)
    out = [text(rnd.randrange(1, 200)) for _ in range(40)]
    out += [text(30) + passage + text(30) for _ in range(12)]  # a passage with other surroundings
    out += [text(5) + passage[k:] + text(9) for k in range(0, 60, 7)]
    out += [other, other, other + " x", "y " + other, other[:500] + "Z" + other[501:]]  # copies and near copies
    line = text(45)
    out += [f"{line}\n{line}\n{text(20)}", "ab" * 400, "a" * 900, "a" * 199, "a" * 200, "", None]
    out += [other[i : i + 230] + text(4) for i in range(0, 300, 50)]
    return out


def run(spark, rows, schema="doc_id long, text string"):
    return sd.suffix_dedup(spark.createDataFrame(rows, schema), form="digest").collect()


@pytest.mark.parametrize("piece", [sd._PIECE, 700])
def test_same_as_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(sd, "_PIECE", piece)
    given = texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in run(spark, list(enumerate(given)))}
    assert [got[i] for i in range(len(given))] == brute(given)


def test_boundaries_of_many_small_buckets(spark):
    given = texts()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in run(spark, list(enumerate(given)))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [got[i] for i in range(len(given))] == brute(given)


def test_pieces_of_a_long_text_cover_all_windows():
    rnd = np.random.default_rng(3)
    buf = rnd.integers(97, 101, 5000).astype(np.uint8)
    for size in (300, 1000, 10_000):
        old, sd._PIECE = sd._PIECE, size
        try:
            seen = []
            for rows, offs, los, his in sd._pieces(np.array([0]), np.array([5000])):
                base = int(los[0])
                _, _, row, lo, count, _ = sd.suffixes(buf[base : his.max()], los - base, his - base)
                for r, a, n in zip(row, lo, count):
                    seen += range(a + base - los[r] + offs[r], a + base - los[r] + offs[r] + n)
        finally:
            sd._PIECE = old
        assert sorted(seen) == list(range(5000 - 199))


def test_multikey_order():
    rnd = np.random.default_rng(1)
    keys = [rnd.integers(0, 3, 20_000), rnd.integers(0, 50, 20_000), rnd.integers(0, 1 << 40, 20_000)]
    order = sd.multikey_order(keys)
    assert sorted(order.tolist()) == list(range(20_000))
    rows = list(zip(*(k[order].tolist() for k in keys)))
    assert rows == sorted(rows)


def test_odd_rows(spark):
    same = "lorem ipsum dolor " * 3 + "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(None, same, 1, "x"), (7, same, 2, None), (7, same, 2, None), (8, None, None, "q"), (9, "", 5, "r")]
    got = run(spark, rows, "doc_id long, text string, n_bytes int, d string")
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["d"]) for r in got if r["d"]) == [(-1, len(same), len(same), "x"), (8, 0, 0, "q"), (9, 0, 0, "r")]
    assert [r["n_removed"] for r in got if r["doc_id"] == 7] == [len(same)] * 2
    assert run(spark, [], "doc_id long, text string") == []


def test_spans_and_bytes(spark):
    a = "x" * 10 + "".join(chr(97 + i * i * 7 % 26) for i in range(250)) + "tail"
    got = sd.suffix_dedup(spark.createDataFrame([(1, a), (2, a[10:260])], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert bytes(by[1]["kept"]).decode() == a[: by[1]["spans"][0]["start"]] + a[by[1]["spans"][0]["end"] :]
    assert bytes(by[2]["kept"]) == b""


def test_texts_stay_whole(spark):
    a = "é" * 99 + "x" + "é" * 99 + "".join(chr(224 + i * i % 26) for i in range(200))
    rows = [(1, a, "en", "s", 5), (2, "q" + a[1:], "en", "s", 5), (3, None, None, None, None)]
    got = {r["doc_id"]: r for r in sd.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert got[3]["text"] == "" and got[1]["text"] in a and got[1]["n_chars"] == len(got[1]["text"]) < 10


@pytest.mark.parametrize("key", [None, 7])
def test_many_texts_under_one_key(spark, key):
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(260)
    given = [text(rnd.randrange(0, 40)) + (passage[i % 50 :] if i % 2 else "") + text(rnd.randrange(210, 400)) for i in range(900)]
    got = run(spark, [(key, t, i) for i, t in enumerate(given)], "doc_id long, text string, i int")
    by = {r["i"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in got}
    assert [by[i] for i in range(len(given))] == brute(given)
