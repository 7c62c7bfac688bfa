"""Totals, batch accuracy, model quality and losses. Everything is one pass of conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxworks.operators.ordering import row_index
from waxworks.operators.registry import latest_active
from waxworks.operators.threshold import f1_parts

BATCH_SIZE = 20
ROLLING = 100
MAX_CLASS_WEIGHT = 10.0


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, F.nullif(whole, F.lit(0))), F.lit(0.0))


def catalogue_totals(records: DataFrame) -> DataFrame:
    """Records, evaluated, keepers, the rest, and keepers per hundred evaluated."""
    counted = records.agg(
        F.count("*").alias("total"),
        count_if(F.col("evaluated")).alias("evaluated"),
        count_if(F.col("evaluated") & F.col("wanted")).alias("keepers"),
        count_if(F.col("evaluated") & ~F.col("wanted")).alias("non_keepers"),
    )
    return counted.withColumn("keeper_rate", share(F.col("keepers"), F.col("evaluated")) * 100)


def batch_performance(feedback: DataFrame, by: str = "batch_number") -> DataFrame:
    """Correct, total and accuracy of each batch of (predicted_prob, actual)."""
    right = (F.col("predicted_prob") > 0.5) == F.col("actual")
    counted = feedback.groupBy(by).agg(count_if(right).alias("correct"), F.count("*").alias("total"))
    return counted.withColumn("accuracy", share(F.col("correct"), F.col("total")))


def backfill_batches(instances: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Number instances by time, cut them into batches of 20, and rate the batches.

    ``instances`` is (instance_id, ts, predicted, actual). Batches already in ``existing`` are left
    alone.
    """
    placed = row_index(instances.select("instance_id", "ts", "predicted", "actual"), F.col("ts"), F.col("instance_id"))
    batched = placed.withColumn("batch_number", F.floor(F.col("row_idx") / BATCH_SIZE).cast("bigint"))
    rated = batched.groupBy("batch_number").agg(
        count_if(F.col("predicted") == F.col("actual")).alias("correct"), F.count("*").alias("total")
    )
    rated = rated.withColumn("accuracy", share(F.col("correct"), F.col("total")))
    return rated if existing is None else rated.join(existing.select("batch_number"), "batch_number", "left_anti")


def latest_batches(batches: DataFrame, n: int = ROLLING) -> DataFrame:
    return batches.orderBy(F.col("batch_number").desc()).limit(n)


def rolling_accuracy(batches: DataFrame, n: int = ROLLING) -> DataFrame:
    """Correct over total of the last ``n`` batches."""
    return latest_batches(batches, n).agg(
        share(F.sum("correct"), F.sum("total")).alias("rolling_accuracy"), F.count("*").alias("n_batches")
    )


def mean_accuracy(batches: DataFrame, n: int) -> DataFrame:
    """Plain mean of the batch accuracies of the last ``n`` batches."""
    return latest_batches(batches, n).agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("mean_accuracy"))


def smoothed_accuracy(batches: DataFrame) -> DataFrame:
    """Mean accuracy over five batches around each of the last hundred, oldest first.

    The window starts two batches back where it can and always reaches for five rows, so the first
    two batches see the same five and the tail sees fewer.
    """
    recent = latest_batches(batches)  # at most 100 rows
    order = Window.orderBy("batch_number")
    place = F.row_number().over(order)

    def frame(lo, hi):
        return F.avg("accuracy").over(order.rowsBetween(lo, hi))

    smooth = F.when(place == 1, frame(0, 4)).when(place == 2, frame(-1, 3)).otherwise(frame(-2, 2))
    return recent.select("batch_number", "correct", "total", (smooth * 100).alias("smoothed"))


def next_batch_number(batches: DataFrame) -> DataFrame:
    return batches.agg((F.coalesce(F.max("batch_number"), F.lit(0)) + 1).cast("bigint").alias("next_batch"))


def evaluate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 at 0.5 and mean uncertainty of (predicted_prob, uncertainty, actual)."""
    flag, actual = F.col("predicted_prob") > 0.5, F.col("actual")
    counted = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        count_if(flag & actual).alias("tp"),
        count_if(flag & ~actual).alias("fp"),
        count_if(~flag & actual).alias("fn"),
        F.avg("uncertainty").alias("mean_uncertainty"),
    )
    precision, recall, f1 = f1_parts(F.col("tp"), F.col("fp"), F.col("fn"))
    right = F.col("n_rows") - F.col("fp") - F.col("fn")
    return counted.select(
        *(by or []), share(right, F.col("n_rows")).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), "mean_uncertainty",
    )


def class_weight(labelled: DataFrame) -> DataFrame:
    """Weight of a positive: negatives per positive, at most ten."""
    positives = count_if(F.col("actual"))
    ratio = (F.count("*") - positives) / (positives + F.lit(1e-6))
    return labelled.agg(F.least(ratio, F.lit(MAX_CLASS_WEIGHT)).alias("pos_weight"))


def cross_entropy(probability: Column, actual: Column) -> Column:
    """Binary cross-entropy of one row; logarithms are cut at -100."""
    log_p = F.greatest(F.log(F.nullif(probability, F.lit(0.0))), F.lit(-100.0))
    log_q = F.greatest(F.log(F.nullif(F.lit(1.0) - probability, F.lit(0.0))), F.lit(-100.0))
    return -F.when(actual, log_p).otherwise(log_q)


def losses(scored: DataFrame) -> DataFrame:
    """Class-weighted and plain mean cross-entropy."""
    weighted = scored.crossJoin(F.broadcast(class_weight(scored)))  # one row
    loss = cross_entropy(F.col("predicted_prob"), F.col("actual"))
    weight = F.when(F.col("actual"), F.col("pos_weight")).otherwise(1.0)
    return weighted.agg(F.avg(weight * loss).alias("weighted_loss"), F.avg(loss).alias("plain_loss"))


def combined_loss(scored: DataFrame, triplets: DataFrame, classification: float = 0.8, triplet: float = 0.2) -> DataFrame:
    """Weighted sum of the classification loss and the mean of ``triplets.loss``."""
    parts = losses(scored).select(F.col("weighted_loss").alias("classification")).crossJoin(
        triplets.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("triplet"))
    )
    return parts.withColumn("total", F.lit(classification) * F.col("classification") + F.lit(triplet) * F.col("triplet"))


def label_report(labelled: DataFrame) -> DataFrame:
    """Label counts and the spread of the predictions."""
    return labelled.agg(
        F.count("*").alias("total"),
        count_if(F.col("actual")).alias("keepers"),
        (share(count_if(F.col("actual")), F.count("*")) * 100).alias("keeper_rate"),
        F.min("predicted_prob").alias("lowest"),
        F.max("predicted_prob").alias("highest"),
        F.avg("predicted_prob").alias("mean"),
        share(count_if(F.col("predicted_prob") > 0.2), F.count("*")).alias("share_positive"),
    )


def metrics_summary(records: DataFrame, instances: DataFrame, batches: DataFrame, registry: DataFrame) -> DataFrame:
    """The dashboard row: totals, rolling and recent accuracy, counts, latest model."""
    totals = catalogue_totals(records).select(
        F.col("total").alias("total_records"), "evaluated", "keepers", "non_keepers", "keeper_rate"
    )
    pieces = [
        rolling_accuracy(batches).select("rolling_accuracy"),
        mean_accuracy(batches, 10).withColumnRenamed("mean_accuracy", "recent_accuracy"),
        batches.agg(F.count("*").alias("total_batches")),
        instances.agg(F.count("*").alias("training_instances")),
        latest_active(registry).select(F.col("version").alias("model_version")),
    ]
    for piece in pieces:  # each side is one row
        totals = totals.crossJoin(piece)
    return totals
