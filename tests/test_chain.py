"""The chain behind a full buffer, the commit log, and versions under several writers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxworks.operators.model import ENTRIES, KeeperModel, update_keeper_model
from waxworks.plans import saved
from waxworks.sources.commits import CommitLog
from waxworks.streaming import chain
from waxworks.streaming import feedback as fb

D = 12


def _designed(spark, n=40):
    rng = np.random.default_rng(4)
    rows = [(i, [(0, 1.0), *[(int(s), float(rng.normal())) for s in sorted(rng.choice(np.arange(1, D), 3, False))]]) for i in range(n)]
    return spark.createDataFrame(rows, f"record_id long, x {ENTRIES}")


def _feed(spark, batches, model="m"):
    rows = [(model, b, 4, b * 4 + i, (b * 7 + i * 3) % 45, ((b * 4 + i) % 10) / 10, 0.1, (b + i) % 3 == 0) for b in batches for i in range(4)]
    return spark.createDataFrame(rows, fb.FEED)


def _prior():
    return KeeperModel(np.linspace(-0.5, 0.5, D), np.full(D, 2.0))


def _run(spark, path, **more):
    stream = spark.readStream.schema(fb.FEED).option("maxFilesPerTrigger", 1).parquet(f"{path}/src")
    chain.run_chain(stream, _designed(spark), f"{path}/out", f"{path}/state", _prior(), window=30, **more)
    return {(r["model"], r["buffer"]): r for r in chain.versions(spark, f"{path}/out").collect()}


def _plain(spark, upto):
    """The same buffers one after the other by the whole-table update."""
    model = _prior()
    for b in range(upto + 1):
        rows = _feed(spark, range(5 * b, 5 * b + 5)).join(_designed(spark), "record_id").select("x", F.col("actual").cast("double").alias("y"))
        model = update_keeper_model(model, rows)
    return model


def test_buffers_in_order_over_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    _feed(spark, range(10, 15)).coalesce(1).write.mode("append").parquet(f"{path}/src")  # the third buffer comes first
    _feed(spark, range(0, 5)).coalesce(1).write.mode("append").parquet(f"{path}/src")
    got = _run(spark, path)
    assert set(got) == {("m", 0)} and got["m", 0]["instances"] == 20

    taken = CommitLog.commit

    def dies(self, n, entry):
        if n == 2:
            raise RuntimeError("lost")
        return taken(self, n, entry)

    _feed(spark, range(5, 10)).coalesce(1).write.mode("append").parquet(f"{path}/src")
    monkeypatch.setattr(CommitLog, "commit", dies)
    with pytest.raises(Exception, match="lost"):
        _run(spark, path)
    monkeypatch.undo()
    before = {r["buffer"]: r["weights"] for r in chain.versions(spark, f"{path}/out").collect()}
    assert set(before) == {0, 1}
    got = _run(spark, path)  # the epoch is replayed: what was committed stays, the rest follows
    assert set(got) == {("m", 0), ("m", 1), ("m", 2)} and got["m", 1]["weights"] == before[1]
    assert got == _run(spark, path)

    state = CommitLog(spark, f"{path}/out/log/m").state()[1]
    want = _plain(spark, 2)
    have = chain.model_of(spark, state, _prior())
    assert np.allclose(have.weights, want.weights, atol=1e-6) and np.allclose(have.precision, want.precision, atol=1e-6)
    known = _feed(spark, range(10, 15)).filter("record_id < 40").count()
    assert got["m", 2]["n_rows"] == known < 20

    from waxworks.operators.threshold import optimal_threshold

    for b in range(3):  # the window holds one buffer and a half
        rows = _feed(spark, range(5 * b + 5)).withColumn("ts", F.col("batch_number"))
        best = optimal_threshold(rows, 30).first()
        assert (got["m", b]["threshold"], round(got["m", b]["f1_score"], 9)) == (best["threshold"], round(best["f1_score"], 9))


def test_two_models_and_small_passes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chain, "AT_ONCE", 2)
    path = str(tmp_path)
    _feed(spark, range(15), "a/b").unionByName(_feed(spark, range(10), "m")).coalesce(1).write.parquet(f"{path}/src")
    got = _run(spark, path)
    assert set(got) == {("a/b", 0), ("a/b", 1), ("a/b", 2), ("m", 0), ("m", 1)}
    assert np.isclose(got["a/b", 1]["f1_score"], got["m", 1]["f1_score"])


def test_many_buffers_in_few_entries(spark, tmp_path, monkeypatch):
    """A round's buffers share entries and tell only what they change; every version is there, and a restart goes on after the last."""
    monkeypatch.setattr(chain, "ENTRIES_AT_ONCE", 2)
    path, commits, plain = str(tmp_path), [], CommitLog.commit
    monkeypatch.setattr(CommitLog, "commit", lambda self, n, entry: commits.append(n) or plain(self, n, entry))
    _feed(spark, range(25)).coalesce(1).write.mode("append").parquet(f"{path}/src")
    got = _run(spark, path)
    assert commits == [0, 3] and sorted(b for _, b in got) == [0, 1, 2, 3, 4]
    _feed(spark, range(25, 30)).coalesce(1).write.mode("append").parquet(f"{path}/src")
    got = _run(spark, path)
    assert commits == [0, 3, 5] and sorted(b for _, b in got) == [0, 1, 2, 3, 4, 5]
    for b in (1, 3, 5):
        have, want = chain.model_of(spark, got["m", b].asDict(), _prior()), _plain(spark, b)
        assert np.allclose(have.weights, want.weights, atol=1e-6) and np.allclose(have.precision, want.precision, atol=1e-6)


def test_log_gives_a_number_once(spark, tmp_path):
    a, b = CommitLog(spark, f"{tmp_path}/log"), CommitLog(spark, f"{tmp_path}/log")
    assert a.state() == (-1, None) and a.commit(0, {"x": 1}) and not b.commit(0, {"x": 2}) and b.state() == (0, {"x": 1})
    assert b.commit(1, {"x": 3}) and a.last() == 1 and sorted(r["x"] for r in a.entries("x long").collect()) == [1, 3]


def _model(v):
    return KeeperModel(np.full(3, float(v)), np.ones(3))


def _day(n):
    return F.timestamp_seconds(F.lit(n * 86400))


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """While one writer is about to commit, another does; both versions are in, and the newest is active."""
    folder = str(tmp_path / "models")
    saved.save_model(_model(1), spark, folder, _day(1))
    plain, others = CommitLog.commit, [_model(3)]

    def late(self, n, entry):
        if others:
            monkeypatch.setattr(CommitLog, "commit", plain)
            saved.save_model(others.pop(), spark, folder, _day(3))
            return plain(self, n, entry)
        return plain(self, n, entry)

    monkeypatch.setattr(CommitLog, "commit", late)
    saved.save_model(_model(2), spark, folder, _day(2))
    monkeypatch.undo()
    log = CommitLog(spark, f"{folder}_log")
    assert log.last() == 2 and saved.latest_model(spark, folder).weights[0] == 3
    assert [log.read(n)["entry"]["created_at"][:10] for n in range(3)] == ["1970-01-02", "1970-01-04", "1970-01-03"]


def test_a_writer_that_dies_leaves_no_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "models")
    saved.save_model(_model(1), spark, folder, _day(1))
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            saved.save_model(_model(2), spark, folder, _day(2))
    assert saved.latest_model(spark, folder).weights[0] == 1
    saved.save_model(_model(2), spark, folder, _day(2))
    assert saved.latest_model(spark, folder).weights[0] == 2
