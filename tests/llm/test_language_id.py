import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxworks.llm import language_id as li

PIECES = ["▁", "a", "b", "ab", "▁ab", "ba", "aba", "é"]


def brute(pieces, chance, word):
    """Sum over all ways to cut the word into pieces."""
    index = {t: i for i, t in enumerate(pieces.texts)}
    text, total = b" " + word, 0.0
    for n in range(len(text)):
        for cuts in itertools.combinations(range(1, len(text)), n):
            edges = [0, *cuts, len(text)]
            ids = [index.get(text[a:b]) for a, b in zip(edges, edges[1:])]
            if None not in ids:
                total += math.prod(chance[i] for i in ids)
    return math.log(total)


def test_forward_sums_all_segmentations():
    pieces = li.Pieces(PIECES)
    chances = np.random.default_rng(1).random((pieces.size, 2)) / 20
    words = [w.encode() for w in ("a", "ab", "ababab", "é", "baé", "xyz", "ba", "abaaba")]
    got = li.forward(pieces, chances, words)
    for i, w in enumerate(words):
        for j in range(2):
            assert got[i, j] == pytest.approx(brute(pieces, chances[:, j], w), rel=1e-9)


def test_long_words_stay_finite():
    pieces = li.Pieces(PIECES)
    chances = np.full((pieces.size, 1), 1e-9)
    one, two = li.forward(pieces, chances, [b"x" * 3000, b"x" * 1500])[:, 0]
    assert np.isfinite(one) and one == pytest.approx(3001 * math.log(1e-9)) and two == pytest.approx(1501 * math.log(1e-9))


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = li.op8(spark, folder).join(docs.select("doc_id", "lang"), "doc_id")
    right, all_ = got.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert all_ > 20 and right >= 0.98 * all_ and got.filter("score < 0 or score > 1 or isnan(score)").count() == 0


def test_odd_rows(spark):
    rows = [(1, "ab ab ab", "x"), (2, "ba éé", "y"), (3, None, "x"), (4, "", None), (5, "12 34 !", "x"), (None, "ab", "x"), (1, "ab ab ab", "x")]
    df = spark.createDataFrame([(k, t, lang, 0) for k, t, lang in rows], "doc_id long, text string, lang string, score int")
    model = li.fit(df, PIECES, F.lit(True))
    got = li.language_id(df, PIECES, model).collect()
    assert [r["lang_pred"] for r in got] == ["x", "y", "und", "und", "und", "x", "x"] and set(model) == {"x", "y"}
    nothing = li.language_id(df, PIECES, {}).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert li.fit(df.filter("false"), PIECES, F.lit(True)) == {} and li.language_id(df.filter("false"), PIECES, model).collect() == []


def expected(pieces, chance, word):
    """Uses of each piece over all ways to cut the word, weighted by their probability."""
    index = {t: i for i, t in enumerate(pieces.texts)}
    text, total, counts = b" " + word, 0.0, np.zeros(pieces.size)
    for n in range(len(text)):
        for cuts in itertools.combinations(range(1, len(text)), n):
            edges = [0, *cuts, len(text)]
            ids = [index.get(text[a:b]) for a, b in zip(edges, edges[1:])]
            if None not in ids:
                p = math.prod(chance[i] for i in ids)
                total += p
                np.add.at(counts, ids, p)
    return counts / total


@pytest.mark.parametrize("cells", [250_000, 10])
def test_expected_uses(monkeypatch, cells):
    monkeypatch.setattr(li, "_CELLS", cells)
    pieces = li.Pieces(PIECES)
    chance = np.random.default_rng(2).random(pieces.size) / 20
    words = [w.encode() for w in ("a", "ababab", "é", "baé", "xyz", "abaaba", "ba")]
    got = li._expected(pieces, chance, words, np.arange(1.0, 8.0))
    assert np.allclose(got, sum(k * expected(pieces, chance, w) for k, w in enumerate(words, 1)))
    for size in (61, 5000):  # each byte is used once, whatever the pieces
        counts = li._expected(pieces, chance, [b"ab" * size], np.array([2.0]))
        assert counts @ [len(t) for t in pieces.texts] == pytest.approx(2 * (2 * size + 1))


def test_languages_without_spaces(spark):
    rng = np.random.default_rng(3)
    signs = {"x": "天地玄黃宇宙洪荒日月", "y": "あいうえおかきくけこ", "z": "abcdefghij"}
    text = lambda lang: "".join(rng.choice(list(signs[lang]), 120))
    docs = [(i, text(lang), lang) for i, lang in enumerate("xyz" * 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    pieces = [*PIECES, *"".join(signs.values())]
    model = li.fit(df, pieces, F.col("doc_id") < 18)
    got = li.language_id(df.filter("doc_id >= 18"), pieces, model).collect()
    assert len(got) == 18 and all(r["lang_pred"] == r["lang"] and r["score"] > 0.99 for r in got)
