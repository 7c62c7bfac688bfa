"""Decision thresholds (J8, A5, M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, with_views
from waxworks.operators.threshold import MIN_ROWS, THRESHOLDS, optimal_threshold, threshold_table

_T = "(VALUES " + ", ".join(f"(CAST('{t}' AS DOUBLE))" for t in THRESHOLDS) + ") t(threshold)"


def _counts(source: str, by: str = "") -> str:
    lead = by + ", " if by else ""
    return f"""SELECT {lead}threshold, count(*) AS n_rows,
    CAST(sum(CASE WHEN predicted_prob > threshold AND actual THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN predicted_prob > threshold AND NOT actual THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN predicted_prob <= threshold AND actual THEN 1 ELSE 0 END) AS BIGINT) AS fn
    FROM {source}, {_T} GROUP BY {lead}threshold"""


_PR = """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM counts"""
_F1 = "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr"


@query(
    "j8_threshold_counts",
    with_views("feedback", "SELECT threshold, tp, fp, fn FROM counts", {"counts": _counts("feedback")}),
)
def j8(c):
    return threshold_table(c.feedback).select("threshold", "tp", "fp", "fn")


@query(
    "a5_threshold_f1",
    with_views(
        "feedback",
        "SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM scored",
        {"counts": _counts("feedback"), "pr": _PR, "scored": _F1},
    ),
)
def a5(c):
    t = threshold_table(c.feedback)
    return t.select("threshold", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def _best(by: str = "") -> str:
    lead, group = (by + ", ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {lead}CASE WHEN max(n_rows) >= {MIN_ROWS} AND max(f1) > 0
      THEN arg_min(threshold, (-f1, threshold)) ELSE 0.5 END AS threshold,
    round(CASE WHEN max(n_rows) >= {MIN_ROWS} AND max(f1) > 0 THEN max(f1) ELSE 0.0 END, 6) AS f1_score,
    500 AS window_size FROM scored {group}"""


@query(
    "m7_optimal_threshold",
    with_views(
        "feedback", _best(),
        {
            "recent": "SELECT * FROM feedback ORDER BY ts DESC, instance_id DESC LIMIT 500",
            "counts": _counts("recent"), "pr": _PR, "scored": _F1,
        },
    ),
)
def m7(c):
    return optimal_threshold(c.feedback).withColumn("f1_score", F.round("f1_score", 6))


@query(
    "m7_threshold_by_day",
    with_views(
        "feedback", _best("day"),
        {
            "recent": """SELECT strftime(ts, '%Y-%m-%d') AS day, * FROM feedback
            QUALIFY row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, instance_id DESC) <= 500""",
            "counts": _counts("recent", "day"), "pr": _PR, "scored": _F1,
        },
    ),
)
def m7_by_day(c):
    daily = c.feedback.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return optimal_threshold(daily, by=["day"]).withColumn("f1_score", F.round("f1_score", 6))
