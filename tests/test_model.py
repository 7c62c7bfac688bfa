import numpy as np
import pytest
from pyspark.sql import functions as F

from waxworks.operators import model
from waxworks.operators.features import DENSE_COLUMNS, fit_features, fit_titles, transform_features, with_titles, with_vector

RECORDS = (
    "id long, artist string, title string, label string, genres array<string>, styles array<string>, wants int, haves int, "
    "year int, record_price string, media_condition string, wanted boolean"
)


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        genre = ["Jazz", "Rock", "Folk"][int(rng.integers(0, 3))]
        keep = bool(rng.random() < (0.8 if genre == "Jazz" else 0.1))
        rows.append((
            i, f"artist {i % 20}", f"title {i}", f"label {i % 7}", [genre], ["s" + str(i % 4)], int(rng.integers(0, 500)),
            int(rng.integers(0, 300)), 1960 + i % 40, f"{i % 30}.5, USD", ["NM", "VG+", None][i % 3], keep,
        ))
    return spark.createDataFrame(rows, RECORDS)


@pytest.fixture(scope="module")
def rows(records):
    fitted, terms = fit_features(records), fit_titles(records)
    featured = model.design(with_titles(transform_features(records, fitted), terms))
    return model.training_rows(featured.select("id", "wanted", "x"), "wanted", F.col("id")).cache()


def test_dense_vector(records):
    got = with_vector(transform_features(records, fit_features(records))).select("features", *DENSE_COLUMNS).first()
    assert len(got["features"]) == 21 and got["features"] == [float(got[c]) for c in DENSE_COLUMNS]
    low_high = transform_features(records, fit_features(records)).agg(*[F.min(c) for c in ("wants_n", "price_n", "year_n")], *[F.max(c) for c in ("wants_n", "price_n", "year_n")]).first()
    assert list(low_high) == [0, 0, 0, 1, 1, 1]


def test_design_has_every_slot_of_its_own(records, rows):
    """No two categories share a slot, and the title's terms have theirs."""
    got = records.join(rows.select("id", "x"), "id").orderBy("id").collect()
    slots = {}
    for r in got:
        assert [e["slot"] for e in r["x"]] == sorted({e["slot"] for e in r["x"]}) and all(e["value"] for e in r["x"])
        own = [e["slot"] for e in r["x"] if model.FIRST_CATEGORY <= e["slot"] < model.FIRST_CATEGORY + 1000]
        assert len(own) == 1 and slots.setdefault(r["artist"], own[0]) == own[0]
        assert any(e["slot"] >= model.FIRST_TERM for e in r["x"]) and r["x"][0] == (0, 1.0)
    assert len(set(slots.values())) >= 19  # 20 artists; a hash of 999 slots may have one in common
    assert max(e["slot"] for r in got for e in r["x"]) < model.width()


def test_design_without_titles(records):
    plain = model.design(transform_features(records, fit_features(records)))
    assert plain.select(F.max(F.array_max(F.transform("x", lambda e: e["slot"])))).first()[0] < model.FIRST_TERM


def test_split_is_ordered(rows):
    assert rows.filter("is_val").agg(F.min("id"), F.count("*")).first() == (320, 80)


def _local(rows):
    got = rows.collect()
    x = np.zeros((len(got), model.width()))
    for i, r in enumerate(got):
        for e in r["x"]:
            x[i, e["slot"]] = e["value"]
    return x, np.array([float(r["y"]) for r in got]), np.array([bool(r["is_val"]) for r in got])


def _newton(x, y, w, mean, precision, steps=60):
    """The optimum by full Newton steps with a line search."""
    b = mean.copy()
    value = lambda v: (w * np.logaddexp(0, -np.where(y > 0, 1, -1) * (x @ v))).sum() + 0.5 * precision @ (v - mean) ** 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        slope = x.T @ (w * (y - p)) - precision * (b - mean)
        move = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(precision), slope)
        step = 1.0
        while value(b + step * move) > value(b) and step > 1e-9:
            step /= 2
        b = b + step * move
    return b, value(b)


def test_sums_of_a_pass(rows):
    x, y, val = _local(rows)
    rng = np.random.default_rng(2)
    points = [model.Point(np.zeros(x.shape[1]), 2.0), model.Point(rng.normal(size=x.shape[1]), 1.0)]
    for point, (gradient, curvature, sums) in zip(points, model._pass(rows, points)):
        w = np.where(y > 0, point.pos_weight, 1.0)
        p = 1 / (1 + np.exp(-(x @ point.weights)))
        t = ~val
        assert np.allclose(gradient, x[t].T @ (w * (y - p))[t]) and np.allclose(curvature, (x[t] ** 2).T @ (w * p * (1 - p))[t])
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
        assert np.isclose(sums["train_loss"], (w * loss)[t].sum()) and np.isclose(sums["val_loss"], loss[val].sum())
        assert (sums["n_train"], sums["n_val"]) == (320, 80) and sums["val_right"] == ((p > model.TRAIN_CUT) == (y > 0))[val].sum()


def test_search_reaches_the_dense_optimum(rows):
    x, y, val = _local(rows)
    x, y = x[~val], y[~val]
    x = x[:, x.any(axis=0)][:, :300]  # a dense Newton step on every slot would take its time
    w = np.where(y > 0, 2.0, 1.0)
    for l2 in (0.5, 5.0):
        search = model.Search(np.zeros(x.shape[1]), np.full(x.shape[1], l2))
        search.GAIN = 1e-12
        rounds = 0
        while not search.done and rounds < 200:
            p = 1 / (1 + np.exp(-(x @ search.point)))
            loss = -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
            search.told(loss, x.T @ (w * (y - p)), (x**2).T @ (w * p * (1 - p)))
            rounds += 1
        best, value = _newton(x, y, w, np.zeros(x.shape[1]), np.full(x.shape[1], l2))
        assert rounds < 100 and abs(search.at[1] - value) < 1e-6 * value and np.allclose(search.at[0], best, atol=1e-3)


def test_fit(rows):
    fitted = model.fit_keeper_model(rows, l2=1.0)
    losses = [h["train_loss"] for h in fitted.history]
    assert losses[-1] < 0.8 * losses[0] and all(b <= a * 1.05 for a, b in zip(losses, losses[1:]))
    assert max(h["val_accuracy"] for h in fitted.history[1:]) > 0.6 and len(fitted.history) < 25
    again = model.fit_keeper_model(rows, l2=1.0)
    assert np.allclose(again.weights, fitted.weights)
    assert not np.allclose(model.fit_keeper_model(rows, l2=20.0, rounds=6).weights, fitted.weights)


def test_scores_and_uncertainty(spark, rows):
    fitted = model.fit_keeper_model(rows)
    got = model.score(rows.select("id", "x", "y"), fitted).toPandas()
    assert ((got["mean"] > 0) & (got["mean"] < 1)).all() and (got["uncertainty"] > 0).all()
    assert got.loc[got["y"] > 0, "mean"].mean() > got.loc[got["y"] == 0, "mean"].mean() + 0.2
    more = model.update_keeper_model(fitted, rows.select("x", "y"))
    after = model.score(rows.select("id", "x", "y"), more).toPandas()
    spread = lambda pdf: (pdf["uncertainty"] / (pdf["mean"] * (1 - pdf["mean"]))).mean()
    assert spread(after) < spread(got)


def test_evidence_adds_up(rows):
    at = [model.Point(np.zeros(model.width()), 1.0)]
    halves = [rows.filter(F.col("id") % 2 == k) for k in (0, 1)]
    parts = [model._pass(h, at)[0][1] for h in halves]
    assert np.allclose(parts[0] + parts[1], model._pass(rows, at)[0][1])


def test_update_starts_from_the_model(spark, rows):
    """Few new rows move a model with much evidence little, and each slot's precision only grows."""
    fitted = model.fit_keeper_model(rows)
    more = model.update_keeper_model(fitted, rows.filter("id < 20").select("x", "y"))
    assert (more.precision >= fitted.precision).all() and 0 < np.abs(more.weights - fitted.weights).max()
    firm = model.KeeperModel(fitted.weights, fitted.precision * 1e6)
    assert np.abs(model.update_keeper_model(firm, rows.filter("id < 20").select("x", "y")).weights - fitted.weights).max() < 1e-3


def test_different_records_get_different_scores(spark, rows):
    fitted = model.fit_keeper_model(rows)
    got = [r["mean"] for r in model.score(rows.select("id", "x"), fitted).orderBy("id").collect()]
    assert got == [r["mean"] for r in model.score(rows.select("id", "x"), fitted).orderBy("id").collect()]
    assert len({round(m, 9) for m in got}) > 300


def test_empty_rows(spark, rows):
    none = rows.filter("id < 0")
    fitted = model.fit_keeper_model(none, rounds=2)
    assert not fitted.weights.any() and model.score(none.select("id", "x"), fitted).count() == 0


def test_no_model_gives_one_half(rows):
    got = model.score(rows.select("id", "x"), None).select("mean", "uncertainty").distinct().collect()
    assert got == [(0.5, None)]


def test_model_survives_a_round_trip(spark, rows, tmp_path):
    fitted = model.fit_keeper_model(rows, rounds=3)
    path = str(tmp_path / "model")
    fitted.to_rows(spark).write.parquet(path)
    back = model.KeeperModel.from_rows(spark.read.parquet(path))
    assert np.array_equal(back.weights, fitted.weights) and np.array_equal(back.precision, fitted.precision)


def test_instance_log(spark, records):
    feedback = spark.createDataFrame(
        [(1, 3, 0.6, 0.1, True), (2, 3, 0.4, 0.1, True), (3, 9999, 0.9, 0.1, True)],
        "instance_id long, record_id long, predicted_prob double, uncertainty double, actual boolean",
    )
    logged, unknown = model.instance_log(feedback, records)
    assert {r["instance_id"]: r["reward"] for r in logged.collect()} == {1: 1.0, 2: -1.0}
    assert [r["instance_id"] for r in unknown.collect()] == [3]


def test_compare_models_in_the_same_scans(rows, monkeypatch):
    scans = []
    plain = model._pass
    monkeypatch.setattr(model, "_pass", lambda r, points: scans.append(len(points)) or plain(r, points))
    got = model.compare_models(rows.drop("y", "split", "is_val"), "wanted", F.col("id"), rounds=7, halve_every=3).collect()
    assert [r["name"] for r in got] and {r["name"] for r in got} == {s.name for s in model.SETTINGS} and got[0]["f1"] >= got[-1]["f1"]
    assert len(scans) <= 7 and scans[0] == 5 and max(scans[3:6], default=0) <= 3 and max(scans[6:], default=0) <= 2


def test_settings_fitted_together_as_alone(rows):
    settings = [model.Setting("a"), model.Setting("b", l2=9.0), model.Setting("c", titles=False)]
    together = model.fit_models(rows, settings, rounds=6)
    for s, m in zip(settings, together):
        assert np.allclose(m.weights, model.fit_models(rows, [s], rounds=6)[0].weights, atol=1e-9)
    assert together[0].weights[model.FIRST_TERM :].any() and not together[2].weights[model.FIRST_TERM :].any()


def test_metrics_of_models_at_once(spark, rows):
    from waxworks.operators.metrics import evaluate

    models = {"x": model.fit_keeper_model(rows, rounds=3), "y": model.fit_keeper_model(rows, rounds=2, l2=30.0)}
    got = {r["name"]: tuple(r)[1:] for r in model.metrics_of(rows, models).collect()}
    for name, m in models.items():
        alone = evaluate(model.score(rows, m).select(F.col("mean").alias("predicted_prob"), "uncertainty", (F.col("y") > 0).alias("actual"))).first()
        assert np.allclose(got[name], tuple(alone))


def test_saved_models(spark, rows, tmp_path):
    from waxworks.plans import saved

    folder = str(tmp_path / "models")
    assert saved.latest_model(spark, folder) is None
    first, second = model.fit_keeper_model(rows, rounds=2), model.fit_keeper_model(rows, rounds=4, l2=5.0)
    for day, fitted in ((2, second), (1, first)):  # the newest counts, not the last written
        saved.save_model(fitted, spark, folder, F.timestamp_seconds(F.lit(day * 86400)))
    assert np.array_equal(saved.latest_model(spark, folder).weights, second.weights)
