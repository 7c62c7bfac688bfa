"""Streaming (R): the feed is written by Spark from the tables and drained as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, with_views
from catalog.composites import _design, _ruled
from catalog.relational import ANNOTATED_SQL, annotations, unlabelled
from catalog.thresholds import _F1, _PR, _best, _counts
from waxworks.session import scratch_path
from waxworks.streaming import chain
from waxworks.streaming import feedback as fb


def _feed(c, base):
    """The feedback as a stream of files; the rows of a batch are spread over several files."""
    sizes = c.feedback_batches.groupBy("batch_number").agg(F.count("*").alias("batch_size"))
    rows = c.feedback_batches.join(sizes, "batch_number").select(
        F.lit("keeper").alias("model"), "batch_number", "batch_size", "instance_id", "record_id", "predicted_prob", "uncertainty", "actual"
    )
    rows.repartition(8, "instance_id").write.parquet(f"{base}/feed")
    return c.spark.readStream.schema(fb.FEED).option("maxFilesPerTrigger", 4).parquet(f"{base}/feed")


@query(
    "r1_buffered_feedback",
    with_views(
        "feedback_batches",
        """SELECT 'keeper' AS model, batch_number // 5 AS buffer, batch_number, instance_id, record_id, predicted_prob, actual FROM feedback_batches
        WHERE batch_number // 5 IN (SELECT batch_number // 5 FROM feedback_batches GROUP BY 1 HAVING count(DISTINCT batch_number) = 5)""",
    ),
)
def r1(c):
    base = scratch_path(c.spark, "buffered")
    fb.run_buffered(_feed(c, base), f"{base}/out", f"{base}/checkpoint")
    return c.spark.read.parquet(f"{base}/out").filter("not late").drop("uncertainty", "batch_size", "late")


_WHOLE = """SELECT batch_number // 5 AS buffer FROM feedback_batches GROUP BY 1 HAVING count(DISTINCT batch_number) = 5"""


@query(
    "r1_model_updates",
    with_views(
        "feedback_batches records",
        """SELECT 'keeper' AS model, buffer, instances, n_rows, best.threshold, best.f1_score FROM used JOIN best USING (buffer)""",
        {
            "whole": _WHOLE,
            "used": """SELECT buffer, count(*) AS instances, count(r.id) AS n_rows FROM feedback_batches f JOIN whole ON buffer = batch_number // 5
            LEFT JOIN records r ON r.id = f.record_id GROUP BY buffer""",
            "recent": """SELECT buffer, predicted_prob, actual FROM whole JOIN feedback_batches f ON f.batch_number // 5 <= buffer AND f.batch_number // 5 > buffer - 6
            QUALIFY row_number() OVER (PARTITION BY buffer ORDER BY batch_number DESC, instance_id DESC) <= 500""",
            "counts": _counts("recent", "buffer"), "pr": _PR, "scored": _F1, "best": _best("buffer"),
        },
    ),
)
def r1_updates(c):
    """Every whole buffer of the feed, applied to a saved model by the chain: rows used, threshold and F1."""
    base = scratch_path(c.spark, "chain")
    designed = _design(c).select(F.col("id").alias("record_id"), "x")
    chain.run_chain(_feed(c, base), designed, f"{base}/out", f"{base}/checkpoint", _ruled())
    found = chain.versions(c.spark, f"{base}/out")
    return found.select("model", "buffer", "instances", "n_rows", "threshold", F.round("f1_score", 6).alias("f1_score"))


@query(
    "r2_streaming_accuracy",
    with_views("batch_performance", "SELECT batch_number, correct, total, round(accuracy, 6) AS accuracy FROM batch_performance"),
)
def r2(c):
    base = scratch_path(c.spark, "accuracy")
    fb.run_batch_accuracy(_feed(c, base), f"{base}/out", f"{base}/checkpoint")
    seen = fb.accuracy_so_far(c.spark.read.parquet(f"{base}/out"))
    return seen.withColumn("accuracy", F.round("accuracy", 6))


@query("r3_streaming_annotations", ANNOTATED_SQL)
def r3(c):
    base = scratch_path(c.spark, "annotations")
    annotations(c).repartition(4, "ebay_id").write.parquet(f"{base}/feed")
    feed = c.spark.readStream.schema("ebay_id string, label boolean, pos bigint").option("maxFilesPerTrigger", 2).parquet(f"{base}/feed")
    fb.run_annotations(feed, f"{base}/out", f"{base}/checkpoint")
    return fb.annotated(unlabelled(c), c.spark.read.parquet(f"{base}/out"), "ebay_id")
