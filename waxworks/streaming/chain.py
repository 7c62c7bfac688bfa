"""What a full buffer of feedback sets off: model update, new threshold, one version in the log."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxworks.operators.metrics import MAX_CLASS_WEIGHT
from waxworks.operators.model import KeeperModel, Search
from waxworks.operators.ordering import top_k_per_group
from waxworks.operators.threshold import optimal_threshold
from waxworks.session import stable
from waxworks.sources.commits import CommitLog
from waxworks.streaming.feedback import buffered_groups

WINDOW, STEPS = 500, 10
#: Buffers that are applied in one go, and the entries of the log in which they are committed.
AT_ONCE, ENTRIES_AT_ONCE = 4096, 64

VERSIONS = "model string, buffer long, instances long, n_rows long, threshold double, f1_score double, weights string, weights_of long, window_from long"

_BUFFERS = "model string, buffer long, batch_number long, instance_id long, record_id long, predicted_prob double, actual boolean"


def _log(spark: SparkSession, folder: str, model: str) -> CommitLog:
    return CommitLog(spark, f"{folder}/log/{quote(model, safe='')}")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each applied buffer."""
    return spark.read.schema(VERSIONS).json(f"{folder}/log/*")


def _states(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The last version of every model in the log."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [unquote(s.getPath().getName()) for s in fs.listStatus(root)] if fs.exists(root) else []
    found = {name: _log(spark, folder, name).state()[1] for name in names}
    return {name: state[-1] if isinstance(state, list) else state for name, state in found.items() if state}


def model_of(spark: SparkSession, state: dict | None, prior: KeeperModel) -> KeeperModel:
    """The model of a version of the log; the prior before the first. Of each slot the last change up to the version counts."""
    if state is None or state["weights"] is None:
        return prior
    own = (F.col("model") == state["model"]) & (F.col("buffer") <= state["weights_of"])
    last = spark.read.parquet(state["weights"]).filter(own).groupBy("slot").agg(F.max_by(F.struct("weight", "precision"), "buffer").alias("w"))
    return KeeperModel.from_rows(last.select("slot", "w.weight", "w.precision"))


def updated(model: KeeperModel, row: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = STEPS) -> KeeperModel:
    """Posterior after one buffer's rows, given as entries (row, slot, value). The same search as a whole-table update."""
    d = len(model.weights)
    balance = min((len(y) - y.sum()) / (y.sum() + 1e-6), MAX_CLASS_WEIGHT)
    w = np.where(y > 0, balance, 1.0)
    search, weights, gained = Search(model.weights, model.precision), model.weights, np.zeros(d)
    for _ in range(steps):
        point = search.point.copy()
        z = np.clip(np.bincount(row, value * point[slot], len(y)), -35, 35)
        p = 1 / (1 + np.exp(-z))
        loss = -(w * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum()
        gradient = np.bincount(slot, value * (w * (y - p))[row], d)
        curvature = np.bincount(slot, value * value * (w * p * (1 - p))[row], d)
        if search.told(loss, gradient, curvature):
            weights, gained = point, curvature
        if search.done:
            break
    return KeeperModel(weights, model.precision + gained)


def _chained(shared, steps: int):
    """The slots that a buffer changes, of the first buffer all. A slot without an entry stays where the prior has it."""

    def chained(key, pdf: pd.DataFrame) -> pd.DataFrame:
        model, out = shared.value[key[0]], []
        weights, precision = model.weights.copy(), model.precision.copy()
        for buffer, rows in pdf.sort_values(["buffer", "instance_id"]).groupby("buffer", sort=True):
            slot, value = np.concatenate(rows["slot"].to_list()).astype(np.int64), np.concatenate(rows["value"].to_list())
            met, place = np.unique(slot, return_inverse=True)
            row = np.repeat(np.arange(len(rows)), rows["slot"].map(len).to_numpy())
            after = updated(KeeperModel(weights[met], precision[met]), row, place, value, rows["y"].to_numpy(float), steps)
            weights[met], precision[met] = after.weights, after.precision
            told = met if out and len(met) else np.arange(len(weights))
            out.append(pd.DataFrame({
                "model": key[0], "buffer": buffer, "n_rows": len(rows), "slot": told.astype(np.int32), "weight": weights[told], "precision": precision[told],
            }))
        return pd.concat(out, ignore_index=True)

    return chained


def _ready(counts: list, states: dict, window: int) -> list[tuple[str, int, int, list[int], int]]:
    """(model, buffer, instances, buffers of its window, first buffer that the next window may need) of what comes next."""
    sizes: dict[str, dict[int, int]] = {}
    for r in counts:
        sizes.setdefault(r["model"], {})[r["buffer"]] = r["n"]
    out = []
    for model, own in sorted(sizes.items()):
        after = states[model]["buffer"] + 1 if model in states else 0
        while after in own and len(out) < AT_ONCE:
            back, total = after, 0
            while back in own and total < window:
                total += own[back]
                back -= 1
            out.append((model, after, own[after], list(range(back + 1, after + 1)), back + 1))
            after += 1
    return out


def apply_buffers(spark: SparkSession, folder: str, designed: DataFrame, prior: KeeperModel, window: int = WINDOW, steps: int = STEPS) -> int:
    """Apply the buffers under ``folder`` that come next, in order of number; how many.

    Each is committed under (model, buffer) where nothing is, so one that is met again, after a restart or
    in another writer, changes nothing. Many buffers are committed as runs, each under its first buffer: the next
    run starts where the last one ends. Weights that were written without a commit are never read.
    """
    states = _states(spark, folder)
    emitted = spark.read.schema(_BUFFERS).parquet(f"{folder}/buffers")
    fresh = F.lit(True)
    for model, state in states.items():
        fresh = fresh & ((F.col("model") != model) | (F.col("buffer") >= state["window_from"]))
    counts = emitted.filter(fresh).groupBy("model", "buffer").agg(F.count("*").alias("n")).collect()  # what waits, and a window before it
    ready = _ready(counts, states, window)
    if not ready:
        return 0
    own = spark.createDataFrame([(m, b) for m, b, *_ in ready], "model string, buffer long")  # at most AT_ONCE
    pairs = spark.createDataFrame([(m, c, b) for m, b, _, back, _ in ready for c in back], "model string, buffer long, upto long")
    seen = emitted.join(F.broadcast(pairs), ["model", "buffer"]).withColumn("ts", F.col("batch_number"))
    best = optimal_threshold(seen, window, ["model", "upto"])

    rows = emitted.join(F.broadcast(own), ["model", "buffer"]).join(designed, "record_id")
    rows = rows.select("model", "buffer", "instance_id", F.col("x.slot").alias("slot"), F.col("x.value").cast("array<double>").alias("value"), F.col("actual").cast("double").alias("y"))
    models = {m: model_of(spark, states.get(m), prior) for m in {m for m, *_ in ready}}
    shared = spark.sparkContext.broadcast(models)  # two numbers for each slot of these models
    path = f"{folder}/weights/{uuid.uuid4().hex}"
    made = rows.groupBy("model").applyInPandas(_chained(shared, steps), "model string, buffer long, n_rows long, slot int, weight double, precision double")
    made.write.parquet(path)
    used = {(r["model"], r["buffer"]): r["n_rows"] for r in spark.read.parquet(path).groupBy("model", "buffer").agg(F.max("n_rows").alias("n_rows")).collect()}
    found = {(r["model"], r["upto"]): r for r in best.collect()}
    where = {m: (s["weights"], s["weights_of"]) for m, s in states.items()}
    entries: dict[str, list[dict]] = {}
    for model, buffer, instances, _, first in ready:
        if (model, buffer) in used:
            where[model] = (path, buffer)
        weights, of = where.get(model, (None, None))
        row = found[model, buffer]
        entries.setdefault(model, []).append({
            "model": model, "buffer": buffer, "instances": instances, "n_rows": used.get((model, buffer), 0), "threshold": row["threshold"],
            "f1_score": row["f1_score"], "weights": weights, "weights_of": of, "window_from": first,
        })
    for model, own_entries in entries.items():
        log, size = _log(spark, folder, model), -(-len(own_entries) // ENTRIES_AT_ONCE)
        for i in range(0, len(own_entries), size):
            part = own_entries[i : i + size]
            if not log.commit(part[0]["buffer"], part if len(part) > 1 else part[0]):
                break  # another writer was faster: its version counts, the rest is looked at anew
    return len(ready)


def run_chain(feed: DataFrame, designed: DataFrame, folder: str, checkpoint: str, prior: KeeperModel, window: int = WINDOW, steps: int = STEPS) -> None:
    """Drain the feed; every whole buffer updates its model and re-tunes its threshold, once and in order.

    ``feed`` is a stream in the feedback's schema, ``designed`` (record_id, x). Emitted buffers are kept under
    their epoch, so a replayed epoch rewrites what it wrote; then those that come next are applied. A
    buffer that comes before its predecessor waits. Instances of unknown records count for the threshold
    only. A restart goes on where the log ends. Late rows have no effect.
    """
    spark = feed.sparkSession
    designed = stable(designed.select("record_id", "x"))

    def step(df: DataFrame, epoch: int) -> None:
        df.filter("not late").select(*[f.split()[0] for f in _BUFFERS.split(", ")]).write.mode("overwrite").parquet(f"{folder}/buffers/epoch={epoch}")
        while apply_buffers(df.sparkSession, folder, designed, prior, window, steps) == AT_ONCE:
            pass

    buffered_groups(feed).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    while apply_buffers(spark, folder, designed, prior, window, steps):  # what a crash left between an epoch's files and its commits
        pass
