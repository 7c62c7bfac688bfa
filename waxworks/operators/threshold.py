"""Decision threshold with the best F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxworks.operators.ordering import top_k_per_group

# 0.05 to 0.90 in steps of 0.05, with the rounding errors of repeated addition.
THRESHOLDS = (
    0.05, 0.1, 0.15000000000000002, 0.2, 0.25, 0.3,
    0.35000000000000003, 0.4, 0.45, 0.5, 0.55, 0.6000000000000001,
    0.6500000000000001, 0.7000000000000001, 0.7500000000000001, 0.8, 0.8500000000000001, 0.9000000000000001,
)
MIN_ROWS = 50


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def f1_parts(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where its denominator is."""
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return precision, recall, _ratio(F.lit(2.0) * precision * recall, precision + recall)


def threshold_table(df: DataFrame, by: list[str] | None = None, thresholds=THRESHOLDS) -> DataFrame:
    """Counts, precision, recall and F1 at every threshold.

    Scoring rows against thresholds is a cross join; as two conditional sums per threshold it is one
    pass with map-side combine, and no row is repeated.
    """
    by = by or []
    positive = F.col("actual").cast("boolean")
    sums = [F.count("*").alias("_n"), F.sum(positive.cast("bigint")).alias("_pos")]
    for i, t in enumerate(thresholds):
        over = F.col("predicted_prob") > F.lit(t)
        sums.append(F.sum(F.when(over & positive, 1).otherwise(0)).alias(f"_tp{i}"))
        sums.append(F.sum(F.when(over & ~positive, 1).otherwise(0)).alias(f"_fp{i}"))
    counted = df.groupBy(*by).agg(*sums)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"),
                    (F.col("_pos") - F.col(f"_tp{i}")).alias("fn"),
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    flat = counted.select(*by, "_n", rows.alias("r")).select(*by, F.col("_n").alias("n_rows"), "r.*")
    precision, recall, f1 = f1_parts(F.col("tp"), F.col("fp"), F.col("fn"))
    return flat.withColumns({"precision": precision, "recall": recall, "f1": f1})


def optimal_threshold(df: DataFrame, window: int = 500, by: list[str] | None = None) -> DataFrame:
    """Best threshold over the latest ``window`` instances, overall or per key.

    ``df`` has instance_id, ts, predicted_prob, actual. Fewer than 50 rows give (0.5, 0.0), and so
    does a window in which no threshold finds anything. The lowest of equally good thresholds wins.
    """
    by = by or []
    latest = (F.col("ts").desc(), F.col("instance_id").desc())
    recent = top_k_per_group(df, by, *latest, k=window) if by else df.orderBy(*latest).limit(window)
    table = threshold_table(recent, by)
    best = F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))
    picked = table.groupBy(*by).agg(F.max("n_rows").alias("n_rows"), best.alias("_t"), F.max("f1").alias("_f1"))
    found = (F.col("n_rows") >= MIN_ROWS) & (F.col("_f1") > 0)
    return picked.select(
        *by,
        F.coalesce(F.when(found, F.col("_t")), F.lit(0.5)).alias("threshold"),
        F.coalesce(F.when(found, F.col("_f1")), F.lit(0.0)).alias("f1_score"),
        F.lit(window).alias("window_size"),
    )
