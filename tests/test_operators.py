import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxworks.operators import bandit, knapsack, metrics, prefs, rows, similarity, stock, tfidf, triplets
from waxworks.operators.joins import join_checked
from waxworks.operators.ordering import (
    add_pages, group_rank, keep_first, row_index, seeded_sample, split_by_position, top_k_per_group,
)
from waxworks.operators.threshold import THRESHOLDS, optimal_threshold


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- order


def test_row_index_is_dense_with_ties_and_a_hot_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    got = row_index(df, F.col("k").desc(), F.col("id")).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(5000))
    assert [(r["k"], r["id"]) for r in got] == sorted(((r["k"], r["id"]) for r in got), key=lambda t: (-t[0], t[1]))


def test_row_index_of_nothing(spark):
    assert row_index(spark.range(0), F.col("id")).count() == 0


def test_group_rank_matches_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("g"))
    order = F.col("id").desc()
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(order)))
    got = group_rank(df, ["g"], order)
    assert sorted(map(tuple, got.collect())) == sorted((r["id"], r["g"], r["rank"]) for r in want.collect())


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    top = top_k_per_group(df, ["g"], F.col("id").desc(), k=4)
    assert top.count() == 12
    assert "WindowGroupLimit" in plan(top) and "Partial" in plan(top)


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "t string, id int").repartition(3)
    assert sorted(map(tuple, keep_first(df, ["t"], F.col("id")).collect())) == [("a", 1), ("b", 2)]


def test_sample_repeats_and_depends_on_the_seed(spark):
    df = spark.range(500)
    draw = lambda s, parts: [r["id"] for r in seeded_sample(df.repartition(parts), "id", 20, s).collect()]
    assert draw(1, 2) == draw(1, 7) != draw(2, 2)


def test_pages(spark):
    got = {r["id"]: r for r in add_pages(spark.range(25), F.col("id"), size=10).collect()}
    assert got[24]["page"] == 2 and got[0]["total_pages"] == 3
    assert (got[0]["has_next"], got[0]["has_previous"], got[24]["has_next"], got[24]["has_previous"]) == (True, False, False, True)


def test_split_by_position(spark):
    got = split_by_position(spark.range(13), F.col("id"), cuts=(0.6, 0.8), names=("a", "b", "c")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"a": 7, "b": 3, "c": 3}


def test_join_checked_beyond_its_limit(spark):
    big = spark.range(100).select("id", (F.col("id") % 5).alias("k"))
    side = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    few, many = join_checked(big, side, ["k"]), join_checked(big, side, ["k"], limit=1)
    assert "BroadcastHashJoin" in plan(few)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


# ---------------------------------------------------------------- thresholds, metrics


def _instances(spark, pairs):
    data = [(i, i, p, a) for i, (p, a) in enumerate(pairs)]
    df = spark.createDataFrame(data, "instance_id long, s long, predicted_prob double, actual boolean")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_thresholds_are_the_repeated_sums():
    assert list(THRESHOLDS) == np.arange(0.05, 0.95, 0.05).tolist()


def test_threshold_needs_fifty_rows(spark):
    few = _instances(spark, [(0.9, True)] * 49)
    assert tuple(optimal_threshold(few).first()) == (0.5, 0.0, 500)
    assert tuple(optimal_threshold(_instances(spark, [(0.9, True)] * 50)).first()) == (0.05, 1.0, 500)
    none = _instances(spark, [(0.01, True)] * 60)
    assert tuple(optimal_threshold(none).first()) == (0.5, 0.0, 500)
    assert tuple(optimal_threshold(few.limit(0)).first()) == (0.5, 0.0, 500)


def test_threshold_against_brute_force_on_the_window(spark):
    rng = np.random.default_rng(3)
    pairs = [(float(round(p, 2)), bool(rng.random() < p)) for p in rng.random(700)]
    got = optimal_threshold(_instances(spark, pairs)).first()
    best, best_f1 = 0.5, 0.0
    recent = pairs[-500:]
    for t in THRESHOLDS:
        tp = sum(p > t and a for p, a in recent)
        fp = sum(p > t and not a for p, a in recent)
        fn = sum(p <= t and a for p, a in recent)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best_f1 + 1e-12:
            best, best_f1 = t, f1
    assert got["threshold"] == best and got["f1_score"] == pytest.approx(best_f1)


def test_accuracy_of_no_batches(spark):
    empty = spark.createDataFrame([], "batch_number long, correct long, total long, accuracy double")
    assert tuple(metrics.rolling_accuracy(empty).first()) == (0.0, 0)
    assert metrics.mean_accuracy(empty, 10).first()[0] == 0.0
    assert metrics.next_batch_number(empty).first()[0] == 1


def test_smoothing_window_reaches_for_five(spark):
    acc = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
    df = spark.createDataFrame([(i, 1, 1, a) for i, a in enumerate(acc)], "batch_number long, correct long, total long, accuracy double")
    got = [r["smoothed"] for r in metrics.smoothed_accuracy(df).orderBy("batch_number").collect()]
    want = []
    for i in range(7):
        lo = max(0, i - 2)
        part = acc[lo : min(7, lo + 5)]
        want.append(100 * sum(part) / len(part))
    assert got == pytest.approx(want)


def test_class_weight_and_losses(spark):
    df = spark.createDataFrame([(0.0, True), (1.0, False), (0.5, False), (0.5, False)], "predicted_prob double, actual boolean")
    assert metrics.class_weight(df).first()[0] == pytest.approx(3 / (1 + 1e-6))
    got = metrics.losses(df).first()
    assert got["plain_loss"] == pytest.approx((100 + 100 + 2 * math.log(2)) / 4)
    alone = spark.createDataFrame([(0.2, False)], "predicted_prob double, actual boolean")
    assert metrics.class_weight(alone).first()[0] == 10.0


# ---------------------------------------------------------------- bandit


def test_exploration_rate_keeps_falling(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (100,), (200,)], "b int").select(bandit.exploration_rate(F.col("b"))).collect()]
    assert got == pytest.approx([0.7, 0.3, 0.9 / 7])


def _scores(spark, n):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, float(rng.random()), float(rng.random())) for i in range(n)], "id long, mean double, uncertainty double")


def test_batch_is_explorers_bets_strangers(spark):
    df = _scores(spark, 300)
    got = bandit.select_batch(df, 10, seed=1).orderBy("place").collect()
    local = df.collect()
    unsure = [r["id"] for r in sorted(local, key=lambda r: (-r["uncertainty"], r["id"]))[:12]]
    bets = [r["id"] for r in sorted(local, key=lambda r: (-(r["mean"] + 2 * r["uncertainty"]), r["id"]))[:5]]
    picked = list(dict.fromkeys(unsure + bets))[:17]
    assert [r["id"] for r in got if r["source"] != "random"] == picked
    assert len([r for r in got if r["source"] == "random"]) == 3
    assert len({r["id"] for r in got}) == len(got)


def test_batch_with_more_explorers_than_places(spark):
    got = bandit.select_batch(_scores(spark, 100), 0, size=20, random_count=10).collect()
    assert len(got) == 20 and sum(r["source"] == "explore" for r in got) == 10
    few = bandit.select_batch(_scores(spark, 6), 0).collect()
    assert len(few) == 6


def test_thompson_stays_in_range(spark):
    got = bandit.thompson(_scores(spark, 200), seed=3).agg(F.min("sampled"), F.max("sampled")).first()
    assert 0 <= got[0] <= got[1] <= 1


# ---------------------------------------------------------------- text


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "d"]), (4, ["e"])], "id int, tokens array<string>")
    terms = {r["term"]: r for r in tfidf.fit_tfidf(docs, 10, max_df=0.75).collect()}
    assert sorted(terms) == ["a", "b"] and terms["a"]["n_docs"] == 4
    assert terms["b"]["idf"] == pytest.approx(math.log(5 / 3) + 1) and [terms[t]["idx"] for t in "ab"] == [0, 1]
    assert [r["term"] for r in tfidf.fit_tfidf(docs, 10, max_df=0.7).collect()] == ["b"]
    assert [r["term"] for r in tfidf.fit_tfidf(docs, 1, max_df=1.0).collect()] == ["a"]
    fitted = tfidf.fit_tfidf(docs, 10)
    got = {r["id"]: dict(zip(r["idx"], r["weight"])) for r in tfidf.tfidf_vectors(docs, fitted).collect()}
    wa, wb = terms["a"]["idf"], terms["b"]["idf"]
    assert got[1] == pytest.approx({0: wa / math.hypot(wa, wb), 1: wb / math.hypot(wa, wb)}) and got[3] == {0: 1.0} and 4 not in got


def test_tfidf_counts_repeats(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"])], "id int, tokens array<string>")
    terms = {r["term"]: (r["tf"], r["df"]) for r in tfidf.fit_tfidf(docs, 10, 1, 1.0, distinct=False).collect()}
    assert terms == {"a": (2, 1), "b": (2, 2)}


def _brute_scores(cands, keeps, max_features):
    import re

    from waxworks.functions.text import STOP_WORDS

    def toks(t):
        return {w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if len(w) > 1 and w not in STOP_WORDS}

    kt = [toks(t) for _, t in keeps if toks(t)]
    df = {}
    for t in kt:
        for w in t:
            df[w] = df.get(w, 0) + 1
    vocab = sorted((w for w in df if 2 <= df[w] <= 0.95 * len(kt)), key=lambda w: (-df[w], w))[:max_features]
    idf = {w: math.log((1 + len(kt)) / (1 + df[w])) + 1 for w in vocab}

    def vec(t):
        v = {w: idf[w] for w in t if w in idf}
        n = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / n for w, x in v.items()}

    kv = [vec(t) for t in kt]
    out = {}
    for i, t in cands:
        if toks(t):
            v = vec(toks(t))
            out[i] = max(sum(x * k.get(w, 0) for w, x in v.items()) for k in kv)
    return out


@pytest.mark.parametrize("pieces", [(5000, 20000), (7, 11)])
def test_best_cosine_against_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(similarity, "ROWS_PER_CHUNK", pieces[0])
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", pieces[1])
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(40)]

    def title():
        return " ".join(rng.choice(words, rng.integers(1, 8)))

    hot = "w1 w2 w3"  # a third of all titles are copies
    cands = [(i, hot if i % 3 == 0 else title()) for i in range(60)] + [(60, "nothing shared zz"), (61, "the LP"), (62, None), (63, "")]
    keeps = [(i, hot if i % 3 == 0 else title()) for i in range(45)] + [(45, None), (46, "12 inch")]
    c = spark.createDataFrame(cands, "id long, title string")
    k = spark.createDataFrame(keeps, "id long, title string")
    got = {r["id"]: r["score"] for r in similarity.similarity_scores(c, k, 25).collect()}
    assert got == pytest.approx(_brute_scores(cands, keeps, 25))
    assert got[60] == 0.0 and 61 not in got
    from waxworks.functions.text import title_words

    docs = k.select("id", tfidf.usable(title_words(F.col("title"))).alias("tokens"))
    saved = similarity.similarity_scores(c, k, 25, terms=tfidf.fit_tfidf(docs, 25)).collect()
    assert {r["id"]: r["score"] for r in saved} == pytest.approx(got)
    top = similarity.similarity_filter(c, k, n=10, seed=1).collect()
    assert sorted(r["position"] for r in top) == list(range(10))


def test_bounds_leave_most_blocks_out(spark, monkeypatch):
    """Titles of many artists: work grows far less than candidates times keepers, and no score changes."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 16)

    def title():
        artist = int(rng.integers(0, 60))
        return " ".join([f"artist{artist}", *[f"w{artist}x{j}" for j in rng.integers(0, 9, 3)], *rng.choice(["live", "best", "songs"], 2)])

    met = []
    for size in (150, 600):
        cands, keeps = [(i, title()) for i in range(size)], [(i, title()) for i in range(size)]
        c, k = (spark.createDataFrame(x, "id long, title string") for x in (cands, keeps))
        pairs, plain = [], similarity._compared
        monkeypatch.setattr(similarity, "_compared", lambda p, a, b: pairs.append(p.count()) or plain(p, a, b))
        got = {r["id"]: r["score"] for r in similarity.similarity_scores(c, k).collect()}
        assert got == pytest.approx(_brute_scores(cands, keeps, 10_000))
        best = sorted(got.values(), reverse=True)[:20]
        assert sorted((r["score"] for r in similarity.similarity_filter(c, k, n=20).collect()), reverse=True) == pytest.approx(best)
        monkeypatch.setattr(similarity, "_compared", plain)
        met.append(sum(pairs[:2]))
        assert sum(pairs[2:]) <= met[-1]  # the bound of the best twenty leaves out more
    blocks = [150 / 16, 600 / 16]
    assert met[1] / met[0] < 0.6 * (600 * blocks[1]) / (150 * blocks[0]) and met[1] < 0.4 * 600 * blocks[1]


def test_tiles_leave_most_blocks_out(spark, monkeypatch):
    """After a candidate's own block, few blocks are compared, and no vector is stored per block (the pairs never leave a task)."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(similarity, "ROWS_PER_CHUNK", 100)

    def title():
        artist = int(rng.integers(0, 60))
        return " ".join([f"artist{artist}", *[f"w{artist}x{j}" for j in rng.integers(0, 9, 3)], *rng.choice(["live", "best", "songs"], 2)])

    cands, keeps = [(i, title()) for i in range(600)], [(i, title()) for i in range(600)]
    c, k = (spark.createDataFrame(x, "id long, title string") for x in (cands, keeps))
    met, plain = [], similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda *a: met.append(plain(*a)) or met[-1])
    stored, kept = [], similarity.stable
    monkeypatch.setattr(similarity, "stable", lambda df: stored.append(kept(df)) or stored[-1])
    got = {r["id"]: r["score"] for r in similarity.similarity_scores(c, k).collect()}
    assert got == pytest.approx(_brute_scores(cands, keeps, 10_000))
    assert max(df.count() for df in stored) <= len(cands) + len(keeps)
    assert 0 < met[0].agg(F.sum("pairs")).first()[0] < 0.4 * 600 * 600 / 16


def test_few_tiles_meet_for_a_shortlist(spark, monkeypatch):
    """Where a shortlist's last score is high, candidates meet keepers of about their own length, not all; the list stays."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(similarity, "ROWS_PER_CHUNK", 16)
    words = [f"w{i}" for i in range(300)]
    keeps = [(i, " ".join(rng.choice(words, rng.integers(4, 120)))) for i in range(320)]
    cands = [(i, keeps[i * 7][1] if i < 40 else " ".join(rng.choice(words, rng.integers(4, 120)))) for i in range(320)]
    cands[40] = (40, keeps[0][1] + " w1 w2 w3 w4 w5 w6")  # near, not equal
    c, k = (spark.createDataFrame(x, "id long, title string") for x in (cands, keeps))
    met, plain = [], similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda p, a, b: met.append(p.count()) or plain(p, a, b))
    got = similarity.similarity_filter(c, k, n=30, digits=6).collect()
    brute = sorted(((-round(s, 6), i) for i, s in _brute_scores(cands, keeps, 10_000).items()))[:30]
    assert sorted((-r["score"], r["id"]) for r in got) == brute
    assert met[0] < 0.25 * (320 / 16) ** 2


def test_most_vectors_meet_in_few_terms(spark, monkeypatch):
    """Long texts: bounds by blocks leave nothing out, yet few pairs have all their terms compared, and no score changes."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(similarity, "ROWS_PER_BLOCK", 16)
    words = [f"w{i}" for i in range(400)]
    often = 1 / np.arange(1, 401) ** 0.7
    texts = [" ".join(rng.choice(words, rng.integers(20, 90), p=often / often.sum())) for _ in range(640)]
    cands, keeps = ([(i, t) for i, t in enumerate(half)] for half in (texts[:320], texts[320:]))
    c, k = (spark.createDataFrame(x, "id long, title string") for x in (cands, keeps))
    met, plain = [], similarity._compared
    monkeypatch.setattr(similarity, "_compared", lambda *a: met.append(plain(*a)) or met[-1])
    got = {r["id"]: r["score"] for r in similarity.similarity_scores(c, k).collect()}
    assert got == pytest.approx(_brute_scores(cands, keeps, 10_000))
    assert 0 < met[0].agg(F.sum("pairs")).first()[0] < 0.3 * 320 * 320 / 16


def test_routes_of_a_tile_agree(monkeypatch):
    """Few terms first, or all terms in a dense product: the best cosines are those of all pairs."""
    rng = np.random.default_rng(10)
    square = np.sort(rng.uniform(1, 7, 200))[::-1] ** 2
    often = np.linspace(0.02, 0.5, 200)
    sides = [[np.flatnonzero(rng.random(200) < often * rng.uniform(0.3, 1.5)) for _ in range(150)] for _ in range(2)]
    mine, theirs = ([v for v in side if len(v)] for side in sides)
    theirs[3] = mine[5]
    theirs.sort(key=lambda v: square[v].sum())
    level = similarity._levels(200)
    all_of = np.array([[square[np.intersect1d(a, b)].sum() / math.sqrt(square[a].sum() * square[b].sum()) for b in theirs] for a in mine]).max(axis=1)
    tile = lambda kind, side: kind(np.array([len(v) for v in side]), np.concatenate(side), square, level)
    for meeting, dense, many in ((7.0, 0.045, 0.004), (1e9, 1e-9, 1.0), (1e-9, 1e9, 1.0), (1e-9, 1e9, 0.0)):
        for name, value in (("_MEETING", meeting), ("_DENSE", dense), ("_MANY", many)):
            monkeypatch.setattr(similarity, name, value)
        for start, least in ((0.0, 0.0), (0.9, 0.0), (0.0, 0.5)):
            best = all_of * start
            similarity._improve(tile(similarity._Vectors, mine), tile(similarity._Keepers, theirs), best, least)
            sure = all_of >= least
            assert best[sure] == pytest.approx(all_of[sure], abs=1e-12) and (best <= all_of + 1e-12).all()


def test_titles_cut_on_arrow_arrays(spark):
    import pyarrow as pa

    from waxworks.functions.text import cut_titles, title_words

    titles = ["The LP of a-b Abba ABBA", None, "", "12 inch", "\u0130stanbul 3\u212aelvin", "caf\u00e9 \u00c9t\u00e9 na\u00efve", "x yy  zz_9 yy", "a", "\ud55c\uae00 mix99\n", "end"]
    frame = spark.createDataFrame(list(enumerate(titles)), "id int, title string").select("id", title_words(F.col("title")).alias("w"))
    want = {r["id"]: sorted(r["w"]) for r in frame.collect() if r["w"]}
    for array in (pa.array(titles), pa.array(["skipped", *titles]).slice(1), pa.array(titles, pa.large_string())):
        got = {}
        for at, row, words in cut_titles(array):
            for r, w in zip(row, words.to_pylist()):
                got.setdefault(at + int(r), set()).add(w)
        assert {k: sorted(v) for k, v in got.items()} == want


# ---------------------------------------------------------------- stock


def _bought(spark, items, budget):
    scored = spark.createDataFrame([(1, i, float(p), float(s)) for i, s, p in items], "seller_id int, listing_id int, price double, score double")
    budgets = spark.createDataFrame([(1, float(budget))], "seller_id int, budget double")
    return sorted(r["listing_id"] for r in knapsack.knapsack_by_seller(scored, budgets).collect())


def test_knapsack_known_cases(spark):
    five = [(1, 10, 50), (2, 8, 40), (3, 6, 30), (4, 5, 25), (5, 3, 20)]
    picked = _bought(spark, five, 100)
    assert sum(p for i, _, p in five if i in picked) <= 100 and sum(s for i, s, _ in five if i in picked) == 19
    assert _bought(spark, [(1, 100, 10), (2, 50, 90), (3, 1, 5)], 100) == [1, 2]
    assert _bought(spark, [(1, 10, 50), (2, 10, 50)], 100) == [1, 2]
    assert _bought(spark, [(1, 10, 50)], 0) == []
    fifty = [(i, 10.0 - i * 0.1, 15.0 + i * 0.5) for i in range(50)]
    assert sum(15.0 + i * 0.5 for i in _bought(spark, fifty, 300)) <= 300
    assert _bought(spark, [(1, 5, 0), (2, 1, 3)], 2) == [1]


def test_best_subset_against_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(400):
        n = int(rng.integers(1, 12))
        v, w, c = rng.integers(0, 30, n), rng.integers(0, 25, n), int(rng.integers(0, 90))
        if trial % 3 == 0:
            v = w + 5
        mask = knapsack.best_subset(v, w, c)
        best = max(sum(v[list(s)]) for r in range(n + 1) for s in itertools.combinations(range(n), r) if sum(w[list(s)]) <= c)
        assert w[mask].sum() <= c and v[mask].sum() == best


def test_table_too_large_is_split(monkeypatch):
    monkeypatch.setattr(knapsack, "TABLE_BITS", 1000)
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, c = int(rng.integers(1, 30)), int(rng.integers(0, 200))
        v, w = rng.integers(1, 30, n), rng.integers(1, 25, n)
        assert v[knapsack._fill(v, w, c)].sum() == knapsack._best_values(v, w, c)[-1]


def test_pruning_keeps_the_optimum_and_bounds_a_hot_price(spark):
    rng = np.random.default_rng(4)
    items = [(1, i, 5.0 if i % 3 == 0 else float(rng.integers(1, 12)), float(rng.integers(1, 40))) for i in range(900)]
    scored = spark.createDataFrame(items, "seller_id int, listing_id int, price double, score double")
    budgets = spark.createDataFrame([(1, 50.0)], "seller_id int, budget double")
    got = knapsack.knapsack_by_seller(scored, budgets).agg(F.sum("score")).first()[0]
    values, weights = np.array([int(s * 1000) for *_, s in items]), np.array([int(p * 100) for _, _, p, _ in items])
    assert got * 1000 == knapsack._best_values(values, weights, 5000)[-1]
    full = scored.join(budgets, "seller_id").select(
        "seller_id", "listing_id", (F.col("score") * 1000).cast("long").alias("value"),
        (F.col("price") * 100).cast("long").alias("cents"), F.lit(5000).cast("long").alias("capacity"),
    )
    kept = knapsack.prune(full).groupBy("cents").count().collect()
    assert all(r["count"] <= 5000 // r["cents"] for r in kept)


def test_heap_of_a_task_keeps_the_best_of_each_price(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(knapsack, "HEAP_ROWS", 300)
    rng = np.random.default_rng(6)
    n = 4000
    seller, cents = rng.integers(0, 3, n), np.where(rng.random(n) < 0.4, 10, rng.integers(1, 60, n))
    rows = pa.table({"seller_id": [f"s{x}" for x in seller], "listing_id": np.arange(n), "value": rng.integers(1, 50, n), "cents": cents, "capacity": np.full(n, 90)})
    out = pa.Table.from_batches(knapsack._best_each(iter(rows.to_batches(max_chunksize=100))))

    def keep(table):
        frame = table.to_pandas().sort_values(["value", "listing_id"], ascending=[False, True])
        frame["rank"] = frame.groupby(["seller_id", "cents"]).cumcount()
        return sorted(frame.query("rank < 90 // cents")["listing_id"])

    assert out.num_rows < n and keep(out) == keep(rows)  # parts that were handed on merge to the same best
    assert list(knapsack._best_each(iter([]))) == []


def test_certificate_of_purchases(spark):
    scored = spark.createDataFrame(
        [("a", 1, 3.0, 9.0), ("a", 2, 4.0, 8.0), ("a", 3, 5.0, 9.0), ("b", 4, 1.0, 1.0), ("c", 5, 0.0, 2.0), ("d", 6, 99.0, 1.0)],
        "seller_id string, listing_id int, price double, score double",
    )
    budgets = spark.createDataFrame([(s, 8.0) for s in "abcd"], "seller_id string, budget double")
    got = {r["seller_id"]: tuple(r)[1:] for r in knapsack.certificate(scored, budgets).collect()}
    # By rate: 1, 2, then 1/5 of 3; the best purchase is 1 and 3.
    assert got == {"a": (3, 17000, 18800, True, True, True), "b": (1, 1000, 1000, True, True, True)}
    assert knapsack.certificate(scored.filter("false"), budgets).count() == 0


def test_failed_seller_is_a_row():
    import pandas as pd

    bad = pd.DataFrame({"seller_id": [7, 7], "listing_id": [1, 2], "price": 1.0, "score": 1.0, "value": ["x", "y"], "cents": 1, "capacity": 5})
    got = knapsack._solve_seller(bad)
    assert got["seller_id"].tolist() == [7] and got["error"].iloc[0]


def test_score_without_demand_or_edge(spark):
    listings = spark.createDataFrame(
        [("x", 1, 9, "10.0, EUR", "Near Mint (NM or M-)"), ("y", 1, 9, "10.0, YEN", "Near Mint (NM or M-)"), ("z", 1, 9, "1, EUR", "Poor (P)")],
        "listing_id string, seller_id int, record_id int, record_price string, media_condition string",
    )
    records = spark.createDataFrame([(9, 5, 0, "", 0.5)], "record_id int, wants int, haves int, suggested_price string, model_score double")
    rates = spark.createDataFrame([("EUR", 0.5)], "currency string, rate double")
    got = stock.score_listings(listings, records, rates).collect()
    assert [(r["listing_id"], r["price"], r["score"]) for r in got] == [("x", 20.0, pytest.approx(0.165))]


# ---------------------------------------------------------------- preferences, triplets


def test_tune_weights_by_hand(spark):
    ranking = [("s", 0, 0.1, 0.0, 0.0), ("s", 1, 0.9, 0.0, 0.0), ("s", 2, 0.0, 0.5, 0.0), ("lone", 0, 1.0, 1.0, 1.0), ("bad", 0, None, 1.0, 1.0), ("bad", 1, 0.1, 1.0, 1.0)]
    df = spark.createDataFrame(ranking, "session_id string, pos int, embedding double, price_diff double, demand double")
    got = prefs.tune_weights(df).collect()
    assert len(got) == 1 and got[0]["total_pairs"] == 3 and got[0]["violations"] == 2
    x = np.array([r[2:] for r in ranking[:3]], dtype=float)
    w = np.array([0.33, 0.33, 0.34])
    s = x @ w
    diffs = [x[i] - x[j] for i in range(3) for j in range(i + 1, 3) if s[i] < s[j]]
    w = np.clip(w + 0.1 * np.mean(diffs, axis=0), 0, None)
    w = w / w.sum()
    assert [got[0][f"w_{a}"] for a in prefs.AXES] == pytest.approx(w.tolist())
    fine = df.filter("session_id = 's' and pos > 0")
    kept = prefs.tune_weights(fine).first()
    assert kept["violations"] == 0 and kept["w_demand"] == 0.34
    overall = prefs.tune_weights(df, overall=True).first()
    assert overall["violations"] == 2 and overall["w_embedding"] == pytest.approx(got[0]["w_embedding"])


def _pairwise(x, score, pos):
    against = (pos[:, None] < pos[None, :]) & (score[:, None] < score[None, :])
    return int(against.sum()), (x[:, None, :] - x[None, :, :])[against].sum(axis=0)


@pytest.mark.parametrize("values", [[], [0], [1, 0], [0, 1], [3, 1, 2, 0, 4]])
def test_earlier_and_less_by_hand(values):
    want = [sum(v < w for v in values[:i]) for i, w in enumerate(values)]
    assert prefs.earlier_and_less(np.array(values, dtype=np.int64)).tolist() == want


def test_rankings_of_any_length(spark):
    """One ranking with most rows, cut into blocks on three levels, beside short ones, ties and bad rows."""
    rng = np.random.default_rng(3)
    data = []
    for name, n in (("hot", 700), ("mid", 33), ("two", 2), ("lone", 1), ("sorted", 60), ("turned", 60)):
        x = rng.integers(0, 12, (n, 3)) / 8  # scores tie
        if name in ("sorted", "turned"):
            x = np.repeat(np.linspace(1, 0, n)[:, None], 3, axis=1)[:: -1 if name == "turned" else 1]
        pos = rng.integers(0, n // 2, n) if name == "mid" else rng.permutation(n) if name == "hot" else np.arange(n)
        data += [(name, int(p), *map(float, r)) for p, r in zip(pos, x)]
    bad = [(None, 0, 1.0, 1.0, 1.0), (None, 1, 1.0, 2.0, 1.0), ("two", None, 1.0, 1.0, 1.0), ("gap", 0, None, 1.0, 1.0), ("gap", 1, 0.1, 1.0, 1.0)]
    schema = "session_id string, pos int, embedding double, price_diff double, demand double"
    df = spark.createDataFrame(data + bad, schema)
    want = {}
    for name in ("hot", "mid", "two", "sorted", "turned"):
        mine = [r for r in data if r[0] == name]
        x = np.array([r[2:] for r in mine])
        score = 0.33 * x[:, 0] + 0.33 * x[:, 1] + 0.34 * x[:, 2]
        want[name] = (len(mine) * (len(mine) - 1) // 2, *_pairwise(x, score, np.array([r[1] for r in mine])))
    assert want["sorted"][1] == 0 and want["turned"][1] == want["turned"][0]
    for block, fan in ((16384, 16), (16, 4)):
        got = {r["session_id"]: r for r in prefs.ranking_sums(df, block=block, fan=fan).collect()}
        assert {k: (r["total_pairs"], r["violations"]) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
        for k, r in got.items():
            assert [r[a] for a in prefs.AXES] == pytest.approx(want[k][2].tolist(), abs=1e-9)
    pairs = prefs.violations(prefs.usable_rankings(df)).groupBy("session_id").count().collect()
    assert {r["session_id"]: r["count"] for r in pairs} == {k: v[1] for k, v in want.items() if v[1]}
    assert prefs.tune_weights(df.limit(0)).count() == 0


def _people(spark, n, start=0):
    data = [(start + i, ["g" + str(i % 3)], ["s" + str(i % 5)], "l" + str(i % 4), 1960 + i % 30) for i in range(n)]
    return spark.createDataFrame(data, "id long, genres array<string>, styles array<string>, label string, year int")


def test_few_splits_are_dealt_to_all_cores(spark):
    kind = "slot string, anchor struct<genres: array<string>, styles: array<string>, label: string, year: int>"
    anchors = spark.createDataFrame([("a", (["g"], ["s"], "l", 1990))], kind)
    others = spark.range(0, 50, 1, 1).select("id", F.array(F.lit("g")).alias("genres"), F.array(F.lit("s")).alias("styles"), F.lit("l").alias("label"), F.lit(1991).alias("year"))
    scored = triplets.score_negatives(anchors, others)
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and scored.filter("score = 8").count() == 50


def test_picks_do_not_sort_the_scored_rows(spark, monkeypatch):
    scored = spark.range(4000).select((F.col("id") % 4).cast("string").alias("slot"), "id", (F.col("id") % 7).cast("int").alias("score"))
    plans, kept = [], triplets.stable
    monkeypatch.setattr(triplets, "stable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    picked = {r["slot"]: r["negative"] for r in triplets.pick_hard(scored, 3).collect()}
    assert plans and not any("SortAggregate" in p for p in plans)
    assert set(picked) == {"0", "1", "2", "3"} and all(i % 4 == int(s) and i % 7 in (5, 6) for s, i in picked.items())


def test_similarity_points(spark):
    kind = "a struct<genres: array<string>, styles: array<string>, label: string, year: int>, b struct<genres: array<string>, styles: array<string>, label: string, year: int>"
    rows_ = [
        ((["x"], ["y"], "l", 1970), (["x"], ["y"], "l", 1975)), ((["x"], [], None, 0), (["z"], ["y"], None, 0)),
        ((None, ["y"], "l", None), (["x"], ["y"], "m", 1970)),
    ]
    got = [r[0] for r in spark.createDataFrame(rows_, kind).select(triplets.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [8, 2, 2]


def test_mined_triplets(spark):
    keepers, others = _people(spark, 20), _people(spark, 50, 100)
    got = triplets.mine_triplets(keepers, others, n=30, seed=1).collect()
    assert len(got) == 30 and all(r["anchor"] != r["positive"] and r["negative"] >= 100 for r in got)
    scored = {(r["slot"], r["id"]): r["score"] for r in triplets.score_negatives(
        spark.createDataFrame([(r["slot"], r["anchor"]) for r in got], "slot string, id long").join(
            keepers.select("id", F.struct(*triplets.PROFILE).alias("anchor")), "id"), others).collect()}
    for r in got:  # at least as similar as the last of the best fifth
        own = sorted((s for (slot, _), s in scored.items() if slot == r["slot"]), reverse=True)
        assert scored[(r["slot"], r["negative"])] >= own[9]
    assert triplets.mine_triplets(keepers.limit(1), others, n=5, seed=1).count() == 0


def test_hard_picks_cover_the_pool_evenly(spark):
    # twelve score high, the rest tie: pool of twenty is the twelve and eight of the ties
    scored = spark.range(3000).select(F.col("id").cast("string").alias("slot")).crossJoin(
        spark.range(100).select("id", F.when(F.col("id") < 12, 5).otherwise(1).alias("score")))
    got = triplets.pick_hard(scored, seed=2).select((F.col("negative") < 12).alias("high")).groupBy("high").count().collect()
    shares = {r["high"]: r["count"] / 3000 for r in got}
    assert abs(shares[True] - 0.6) < 0.04


def test_batch_triplets_need_history(spark):
    keepers, others = _people(spark, 12), _people(spark, 30, 100)
    batch = _people(spark, 4, 50).withColumn("kept", F.col("id") % 2 == 0)
    got = triplets.mine_batch_triplets(batch, keepers, others, seed=1).collect()
    assert len(got) == 20 and len({r["slot"] for r in got}) == 20 and {r["anchor"] for r in got} == {50, 52}
    assert triplets.mine_batch_triplets(batch, keepers.limit(9), others, seed=1).count() == 0
    assert triplets.mine_batch_triplets(batch.filter("not kept"), keepers, others, seed=1).count() == 0


def test_batch_hard_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 3, 20)
    data = [(0, i, x[i].tolist(), int(y[i])) for i in range(20)] + [(1, 99, [0.0] * 4, 0)]
    df = spark.createDataFrame(data, "batch long, vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in triplets.batch_hard_triplets(df).collect()}
    assert got[99]["loss"] is None
    for i in range(20):
        d = np.linalg.norm(x - x[i], axis=1)
        same = [d[j] for j in range(20) if j != i and y[j] == y[i]]
        other = [d[j] for j in range(20) if y[j] != y[i]]
        assert got[i]["loss"] == pytest.approx(max(max(same) - min(other) + 1, 0))


# ---------------------------------------------------------------- rows


def test_recent_ids(spark):
    old = spark.createDataFrame([("u", i, i) for i in range(60)] + [("quiet", 1, 0)], "user_id string, record_id int, pos int")
    new = spark.createDataFrame([("u", 100, 0), ("u", 5, 1)] + [("fresh", i, i) for i in range(70)], "user_id string, record_id int, pos int")
    got = rows.recent_ids(old, new).collect()
    mine = [r["record_id"] for r in sorted((r for r in got if r["user_id"] == "u"), key=lambda r: (r["source"], r["pos"]))]
    assert mine == [100, 5] + [i for i in range(60) if i != 5][:48]
    assert sum(r["user_id"] == "fresh" for r in got) == 70 and sum(r["user_id"] == "quiet" for r in got) == 1


def test_training_set_needs_rows(spark):
    empty = spark.createDataFrame([], "artist string, title string, label string, genres array<string>, styles array<string>, wants int, haves int, year int, evaluated boolean, wanted boolean")
    with pytest.raises(ValueError):
        rows.training_set(empty)


def test_zip_drops_unequal_lists(spark):
    df = spark.createDataFrame([(1, [1, 2], [True, False]), (2, [1], [True, False])], "b int, r array<int>, l array<boolean>")
    assert [tuple(r) for r in rows.zip_positions(df, ["b"], "r", "l").collect()] == [(1, 0, 1, True), (1, 1, 2, False)]


def test_last_label_wins(spark):
    listings = spark.createDataFrame([("a", False, False), ("b", False, True)], "id string, wanted boolean, evaluated boolean")
    labels = spark.createDataFrame([("a", True, 1), ("a", False, 2), ("a", True, 3), ("zz", True, 4)], "id string, label boolean, pos int")
    got = {r["id"]: (r["wanted"], r["evaluated"]) for r in rows.apply_annotations(listings, labels, "id").collect()}
    assert got == {"a": (True, True), "b": (False, True)}
    assert [r["id"] for r in rows.unknown_keys(labels, listings, "id").collect()] == ["zz"]


def test_auction_window_is_strict(spark):
    ends = ["2024-01-11T00:00:00Z", "2024-01-11T00:00:01Z", "2024-01-11T23:59:59Z", "2024-01-12T00:00:00Z", "soon", None]
    df = spark.createDataFrame([(e,) for e in ends], "e string")
    got = [r[0] for r in df.select(rows.ends_within(F.col("e"), F.lit("2024-01-10 00:00:00").cast("timestamp"))).collect()]
    assert got == [False, True, True, False, False, False]


def test_anchors_are_sent_to_the_negatives(spark):
    anchors = _people(spark, 3).select(F.col("id").cast("string").alias("slot"), F.struct(*triplets.PROFILE).alias("anchor"))
    scored = triplets.score_negatives(anchors, _people(spark, 50, 100))
    assert "BroadcastNestedLoopJoin" in plan(scored) and "Exchange hashpartitioning" not in plan(scored)
    assert scored.count() == 150


def test_listings_are_not_shuffled_for_their_maxima(spark, folder):
    from catalog.composites import _scored
    from waxworks.sources.tables import Catalogue

    shown = plan(_scored(Catalogue(spark, folder)))
    assert "SortMergeJoin" not in shown and "hashpartitioning(seller_id" not in shown
