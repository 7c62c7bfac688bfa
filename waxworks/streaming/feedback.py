"""Feedback as it arrives."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waxworks.operators.metrics import batch_performance, count_if, share
from waxworks.operators.model import KeeperModel, update_keeper_model
from waxworks.operators.rows import apply_annotations
from waxworks.operators.threshold import optimal_threshold

# Batches that are collected before the model is updated.
BUFFER = 5

FEED = "model string, batch_number bigint, batch_size bigint, instance_id bigint, record_id bigint, predicted_prob double, uncertainty double, actual boolean"


def buffered_groups(feed: DataFrame, size: int = BUFFER) -> DataFrame:
    """Whole buffers of ``size`` batches, each emitted once all rows of its batches are in.

    ``feed`` is a stream in the FEED schema; ``batch_size`` announces how many instances the row's batch
    has, so a batch may come in any number of parts and orders. A buffer is whole when it has ``size``
    batches and each has its announced number of instances. An instance that is delivered again counts
    once. Buffers are numbered by batch number, so they fill in parallel instead of one after the other
    under a single key. State holds at most one buffer, and of an emitted one only that it is done: rows
    that come later are put out at once with ``late`` set.
    """
    fields = "batch_number bigint, batch_size bigint, instance_id bigint, record_id bigint, predicted_prob double, uncertainty double, actual boolean"
    names = [f.split()[0] for f in fields.split(", ")]
    schema = f"model string, buffer bigint, {fields}, late boolean"
    state_schema = "done boolean, " + ", ".join(f"{n} array<{t}>" for n, t in (f.split() for f in fields.split(", ")))

    def collect(key, parts, state: GroupState):
        # Lists and not frames: a buffer has about a hundred rows, and there are as many calls as buffers.
        done, *held = state.get if state.exists else (False, *[[] for _ in names])
        columns = [[None if v != v else v for v in old] for old in held]  # a null may come back as NaN
        for p in parts:
            for column, name in zip(columns, names):
                values = p[name]
                column += [None if v != v else v for v in values.tolist()] if values.hasnans else values.tolist()
        if not done:
            places: dict = {}
            for i, instance in enumerate(zip(columns[0], columns[2])):
                places.setdefault(instance, i)
            first = list(places.values())
            if len(first) < len(columns[0]):
                columns = [[column[i] for i in first] for column in columns]
            there, announced = {}, {}
            for batch, many in zip(columns[0], columns[1]):
                if batch is not None:
                    there[batch] = there.get(batch, 0) + 1
                    announced[batch] = max(announced.get(batch, 0), many or 0)
            if len(there) < size or any(n < announced[batch] for batch, n in there.items()):
                state.update((False, *columns))
                return
        state.update((True, *[[] for _ in names]))
        rows = pd.DataFrame(dict(zip(names, columns)))
        rows["model"], rows["buffer"], rows["late"] = key[0], key[1], done
        yield rows[["model", "buffer", *names, "late"]]

    keyed = feed.withColumn("buffer", F.floor(F.col("batch_number") / size).cast("bigint"))
    return keyed.groupBy("model", "buffer").applyInPandasWithState(
        collect, schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


class Update(NamedTuple):
    model: KeeperModel
    threshold: float
    f1_score: float
    n_rows: int


def on_buffer(model: KeeperModel, buffer: DataFrame, designed: DataFrame, instances: DataFrame) -> Update:
    """What a whole buffer sets off: a model update on its known records, then a new threshold.

    ``designed`` is (record_id, x), ``instances`` the log that the threshold is tuned on. Use it from
    ``foreachBatch`` on the stream of :func:`buffered_groups`.
    """
    rows = buffer.join(designed, "record_id").select("x", F.col("actual").cast("double").alias("y"))
    updated = update_keeper_model(model, rows)
    best = optimal_threshold(instances).first()
    return Update(updated, best["threshold"], best["f1_score"], int(updated.history[-1]["n_rows"]))


def run_buffered(feed: DataFrame, out: str, checkpoint: str) -> None:
    """Drain the feed and append whole buffers, and late rows, to ``out``; a restart goes on from the saved state."""
    query = (
        buffered_groups(feed).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batch_accuracy(feed: DataFrame, out: str, checkpoint: str) -> None:
    """Append each micro-batch's counts per batch under its epoch; replaying an epoch rewrites it."""

    def write(df: DataFrame, epoch: int) -> None:
        batch_performance(df).drop("accuracy").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def accuracy_so_far(parts: DataFrame) -> DataFrame:
    """Batch performance from the appended counts."""
    added = parts.groupBy("batch_number").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return added.withColumn("accuracy", share(F.col("correct"), F.col("total")))


def run_annotations(feed: DataFrame, out: str, checkpoint: str) -> None:
    """Append annotations (key, label, pos) under their epoch.

    The listings are not rewritten for every micro-batch; labels are merged when they are read.
    """

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def annotated(listings: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Listings with the newest label of the log."""
    return apply_annotations(listings, log.select(key, "label", "pos"), key)


def label_counts(log: DataFrame) -> DataFrame:
    return log.agg(count_if(F.col("label")).alias("keepers"), count_if(~F.col("label")).alias("non_keepers"))
