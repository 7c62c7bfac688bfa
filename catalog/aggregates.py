"""Aggregates (A), windows (W) and top-k (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, seeded_sql, tokens_sql, with_views
from catalog.scalars import DEMAND_SQL
from waxworks.functions import text
from waxworks.functions.numeric import demand
from waxworks.operators import metrics, ordering, registry, rows
from waxworks.operators.features import fit_features
from waxworks.operators.stock import selected_totals, seller_maxima
from waxworks.operators.triplets import triplet_loss
from waxworks.plans.ranking import session_progress

R = 6


def rounded(df, *names):
    return df.withColumns({n: F.round(n, R) for n in names})


@query(
    "a1_totals",
    with_views(
        "records",
        """SELECT count(*) AS total, count(*) FILTER (evaluated) AS evaluated, count(*) FILTER (wanted) AS keepers,
        count(*) FILTER (evaluated AND NOT wanted) AS non_keepers,
        round(count(*) FILTER (wanted) * 100.0::DOUBLE / count(*) FILTER (evaluated), 6) AS keeper_rate FROM records""",
    ),
)
def a1(c):
    return rounded(metrics.catalogue_totals(c.records), "keeper_rate")


@query("a1_listing_total", "SELECT count(*) AS total_listings FROM lineitem")
def a1_listings(c):
    return c.table("lineitem").agg(F.count("*").alias("total_listings"))


@query(
    "a2_batch_accuracy",
    with_views("batch_performance", "SELECT batch_number, correct, total, round(accuracy, 6) AS accuracy FROM batch_performance"),
)
def a2(c):
    return rounded(c.batch_performance, "accuracy")


_LAST = "SELECT * FROM batch_performance ORDER BY batch_number DESC LIMIT {n}"


@query(
    "a3_rolling_accuracy",
    with_views(
        "batch_performance",
        "SELECT round(sum(correct)::DOUBLE / sum(total), 6) AS rolling_accuracy, count(*) AS n_batches FROM b",
        {"b": _LAST.format(n=100)},
    ),
)
def a3(c):
    return rounded(metrics.rolling_accuracy(c.batch_performance), "rolling_accuracy")


@query(
    "a4_mean_accuracy",
    with_views("batch_performance", "SELECT round(avg(accuracy), 6) AS mean_accuracy FROM b", {"b": _LAST.format(n=10)}),
)
def a4(c):
    return rounded(metrics.mean_accuracy(c.batch_performance, 10), "mean_accuracy")


EVALUATED_SQL = """SELECT round(count(*) FILTER (f = actual)::DOUBLE / count(*), 6) AS accuracy,
 round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
 round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(avg(uncertainty), 6) AS mean_uncertainty
 FROM (SELECT *, predicted_prob > 0.5 AS f FROM feedback),
 (SELECT count(*) FILTER (predicted_prob > 0.5 AND actual)::DOUBLE AS tp, count(*) FILTER (predicted_prob > 0.5 AND NOT actual)::DOUBLE AS fp,
  count(*) FILTER (predicted_prob <= 0.5 AND actual)::DOUBLE AS fn FROM feedback) GROUP BY tp, fp, fn"""


@query("a6_evaluate", with_views("feedback", EVALUATED_SQL))
def a6(c):
    return rounded(metrics.evaluate(c.feedback), "accuracy", "precision", "recall", "f1", "mean_uncertainty")


@query(
    "a7_ranges",
    with_views(
        "records",
        """SELECT count(*) AS n_rows, CAST(min(wants) AS DOUBLE) AS wants_lo, CAST(max(wants) AS DOUBLE) AS wants_hi,
        CAST(min(haves) AS DOUBLE) AS haves_lo, CAST(max(haves) AS DOUBLE) AS haves_hi,
        round(min(ratio), 6) AS ratio_lo, round(max(ratio), 6) AS ratio_hi,
        0.0::DOUBLE AS price_lo, 0.0::DOUBLE AS price_hi, min(year) AS year_lo, max(year) AS year_hi
        FROM (SELECT *, CASE WHEN haves > 0 THEN wants::DOUBLE / haves ELSE wants::DOUBLE END AS ratio FROM records)""",
    ),
)
def a7(c):
    fitted = fit_features(c.records.withColumn("record_price", F.lit(None).cast("string")))
    return rounded(fitted, "ratio_lo", "ratio_hi")


@query(
    "a8_seller_maxima",
    with_views(
        "listings records rates",
        f"""SELECT seller_id, round(max(d), 6) AS max_demand, round(CASE WHEN max(e) > 0 THEN max(e) ELSE 1 END, 6) AS max_edge FROM (
          SELECT seller_id, {DEMAND_SQL} AS d, greatest(0.0, r.year / 80.0::DOUBLE - TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) / rate) AS e
          FROM listings JOIN records r ON r.id = record_id JOIN rates ON rates.currency = split_part(record_price, ', ', 2)) GROUP BY seller_id""",
    ),
)
def a8(c):
    records = c.records.select(F.col("id").alias("record_id"), "wants", "haves", "year")
    priced = rows.with_usd(c.listings, c.rates).join(records, "record_id").withColumns(
        {
            "demand": demand(F.col("wants"), F.col("haves")),
            "edge": F.greatest(F.lit(0.0), F.col("year") / 80 - F.col("usd")),
        }
    )
    return rounded(seller_maxima(priced), "max_demand", "max_edge")


@query(
    "a9_selected_totals",
    with_views(
        "listings rates",
        """SELECT seller_id, count(*) AS n, round(sum(TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) / rate), 4) AS total_cost,
        CAST(sum(record_id % 10) AS BIGINT) AS total_score
        FROM listings JOIN rates ON rates.currency = split_part(record_price, ', ', 2) GROUP BY seller_id""",
    ),
)
def a9(c):
    chosen = rows.with_usd(c.listings, c.rates).withColumn("score", F.col("record_id") % 10)
    return selected_totals(chosen).withColumn("total_cost", F.round("total_cost", 4))


@query(
    "a10_term_frequencies",
    f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM
    (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term""",
)
def a10(c):
    docs = c.documents.select("doc_id", F.explode(text.title_tokens(F.col("text"))).alias("term"))
    # tokens of a document are distinct, so both counts are the row count
    return docs.groupBy("term").agg(F.count("*").alias("df"), F.count("*").alias("tf"))


@query("a11_next_batch", with_views("feedback_batches", "SELECT coalesce(max(batch_number), 0) + 1 AS next_batch FROM feedback_batches"))
def a11(c):
    return metrics.next_batch_number(c.feedback_batches)


@query(
    "a12_session_batches",
    """SELECT user_id AS session_id, CAST(floor(count(*) / 10) AS BIGINT) AS total_batches,
    CAST(floor(count(*) FILTER (event_type = 'purchase') / 10) AS BIGINT) AS completed_batches FROM events GROUP BY user_id""",
)
def a12(c):
    events = c.table("events").select(
        F.col("user_id").alias("session_id"), (F.col("event_type") == "purchase").alias("done")
    )
    return session_progress(events)


@query(
    "a13_update_counts",
    with_views(
        "feedback_batches",
        "SELECT strftime(ts, 'v%Y%m%d') AS version, count(DISTINCT batch_number) AS batch_count FROM feedback_batches GROUP BY 1",
    ),
)
def a13(c):
    return registry.update_counts(
        c.feedback_batches.select(F.date_format("ts", "'v'yyyyMMdd").alias("version"), "batch_number")
    )


CLASS_WEIGHT_SQL = "least(count(*) FILTER (NOT actual) / (count(*) FILTER (actual) + 1e-6), 10.0)"


@query("a14_class_weight", with_views("feedback", f"SELECT round({CLASS_WEIGHT_SQL}, 6) AS pos_weight FROM feedback"))
def a14(c):
    return rounded(metrics.class_weight(c.feedback), "pos_weight")


LOSSES_SQL = f"""SELECT avg(CASE WHEN actual THEN w ELSE 1 END * l) AS weighted_loss, avg(l) AS plain_loss FROM
 (SELECT actual, -CASE WHEN actual THEN CASE WHEN predicted_prob = 0 THEN -100 ELSE greatest(ln(nullif(predicted_prob, 0)), -100) END
  ELSE CASE WHEN predicted_prob = 1 THEN -100 ELSE greatest(ln(nullif(1 - predicted_prob, 0)), -100) END END AS l FROM feedback),
 (SELECT {CLASS_WEIGHT_SQL} AS w FROM feedback)"""


@query(
    "a15_losses",
    with_views("feedback", "SELECT round(weighted_loss, 6) AS weighted_loss, round(plain_loss, 6) AS plain_loss FROM l", {"l": LOSSES_SQL}),
)
def a15(c):
    return rounded(metrics.losses(c.feedback), "weighted_loss", "plain_loss")


@query(
    "a16_label_report",
    with_views(
        "feedback",
        """SELECT count(*) AS total, count(*) FILTER (actual) AS keepers, round(count(*) FILTER (actual) * 100.0::DOUBLE / count(*), 6) AS keeper_rate,
        min(predicted_prob) AS lowest, max(predicted_prob) AS highest, round(avg(predicted_prob), 6) AS mean,
        round(count(*) FILTER (predicted_prob > 0.2)::DOUBLE / count(*), 6) AS share_positive FROM feedback""",
    ),
)
def a16(c):
    return rounded(metrics.label_report(c.feedback), "keeper_rate", "mean", "share_positive")


_ROWS3 = """SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS p, n.embedding::DOUBLE[] AS n FROM embeddings a
 JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings n ON n.vec_id = a.vec_id + 2"""
TRIPLET_LOSS_SQL = f"SELECT vec_id, greatest(list_distance(x, p) - list_distance(x, n) + 1.0, 0.0) AS loss FROM ({_ROWS3})"


def vector_triplets(c):
    def shifted(name, by):
        return c.embeddings.select((F.col("vec_id") - by).alias("vec_id"), F.col("embedding").alias(name))

    return shifted("x", 0).join(shifted("p", 1), "vec_id").join(shifted("n", 2), "vec_id")


@query("a17_triplet_loss", f"SELECT round(avg(loss), 6) AS loss FROM ({TRIPLET_LOSS_SQL})")
def a17(c):
    loss = triplet_loss(F.col("x"), F.col("p"), F.col("n"))
    return vector_triplets(c).agg(F.round(F.avg(loss), 6).alias("loss"))


@query(
    "w1_backfill_batches",
    with_views(
        "feedback",
        """SELECT batch_number, CAST(sum(CASE WHEN (predicted_prob > 0.5) = actual THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total,
        round(avg(CASE WHEN (predicted_prob > 0.5) = actual THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM (
          SELECT *, CAST((row_number() OVER (ORDER BY ts, instance_id) - 1) // 20 AS BIGINT) AS batch_number FROM feedback)
        WHERE batch_number % 3 <> 0 GROUP BY batch_number""",
    ),
)
def w1(c):
    instances = c.feedback.withColumn("predicted", F.col("predicted_prob") > 0.5)
    done = c.feedback_batches.select("batch_number").distinct().filter("batch_number % 3 = 0")
    return rounded(metrics.backfill_batches(instances, done), "accuracy")


@query(
    "w2_smoothed_accuracy",
    with_views(
        "batch_performance",
        """SELECT a.batch_number, any_value(a.correct) AS correct, any_value(a.total) AS total, round(avg(b.accuracy) * 100, 6) AS smoothed
        FROM r a JOIN r b ON b.i >= greatest(0, a.i - 2) AND b.i < greatest(0, a.i - 2) + 5 GROUP BY a.batch_number""",
        {"l": _LAST.format(n=100), "r": "SELECT *, row_number() OVER (ORDER BY batch_number) - 1 AS i FROM l"},
    ),
)
def w2(c):
    return rounded(metrics.smoothed_accuracy(c.batch_performance), "smoothed")


@query(
    "w3_pages",
    """SELECT p_partkey AS id, (n - 1) // 25 AS page, CAST(ceil(total / 25) AS BIGINT) AS total_pages,
    (n - 1) // 25 < ceil(total / 25) - 1 AS has_next, n > 25 AS has_previous
    FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n, count(*) OVER () AS total FROM part)""",
)
def w3(c):
    parts = c.table("part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    paged = ordering.add_pages(parts, F.col("p_retailprice").desc(), F.col("id"), size=25)
    return paged.select("id", "page", "total_pages", "has_next", "has_previous")


@query(
    "w5_agreement_split",
    with_views(
        "feedback_batches",
        """SELECT batch_number AS page, instance_id AS id, agree,
        CAST(row_number() OVER (PARTITION BY batch_number ORDER BY agree DESC, ts, instance_id) AS INT) AS place,
        CAST(count(*) FILTER (agree) OVER (PARTITION BY batch_number) AS BIGINT) AS divider,
        CAST(floor(count(*) FILTER (agree) OVER (PARTITION BY batch_number) * 100 / count(*) OVER (PARTITION BY batch_number) + 0.5) AS BIGINT) AS accuracy
        FROM (SELECT *, (predicted_prob > 0.5) = actual AS agree FROM feedback_batches)""",
    ),
)
def w5(c):
    page = c.feedback_batches.select(
        F.col("batch_number").alias("page"), F.col("row_idx").alias("pos"), F.col("instance_id").alias("id"),
        F.col("predicted_prob").alias("mean"), F.col("actual").alias("selected"),
    )
    return rows.by_agreement(page)


@query(
    "w6_ordered_split",
    with_views(
        "records",
        """SELECT id, CASE WHEN n < floor(total * 0.6) THEN 'train' WHEN n < floor(total * 0.8) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS total FROM records WHERE evaluated)""",
    ),
)
def w6(c):
    labelled = c.records.filter("evaluated").select("id")
    return ordering.split_by_position(labelled, F.col("id"), cuts=(0.6, 0.8), names=("train", "val", "test")).select("id", "split")


_OLD = "SELECT user_id, event_id // 3 AS record_id, event_id AS pos FROM events WHERE event_type <> 'purchase'"
_NEW = "SELECT user_id, event_id // 3 AS record_id, event_id AS pos FROM events WHERE event_type = 'purchase'"


@query(
    "w7_recent_ids",
    with_views(
        "",
        """SELECT user_id, record_id, 1 AS source, pos FROM o WHERE user_id NOT IN (SELECT user_id FROM n)
        UNION ALL SELECT user_id, record_id, 0, pos FROM n WHERE user_id NOT IN (SELECT user_id FROM o)
        UNION ALL SELECT user_id, record_id, source, pos FROM (
          SELECT user_id, record_id, min((source, pos)) AS k, k[1] AS source, k[2] AS pos FROM (
            SELECT user_id, record_id, pos, 0 AS source FROM n WHERE user_id IN (SELECT user_id FROM o)
            UNION ALL SELECT user_id, record_id, pos, 1 FROM o WHERE user_id IN (SELECT user_id FROM n))
          GROUP BY user_id, record_id)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY source, pos, record_id) <= 50""",
        {"o": _OLD, "n": _NEW},
    ),
)
def w7(c):
    seen = c.table("events").select(
        "user_id", F.floor(F.col("event_id") / 3).cast("bigint").alias("record_id"), F.col("event_id").alias("pos"), "event_type"
    )
    old = seen.filter("event_type <> 'purchase'").drop("event_type")
    new = seen.filter("event_type = 'purchase'").drop("event_type")
    return rows.recent_ids(old, new)


@query("t1_seeded_sample", f"SELECT p_partkey AS id FROM part ORDER BY {seeded_sql('p_partkey', seed=3)}, p_partkey LIMIT 100")
def t1(c):
    return ordering.seeded_sample(c.table("part").select(F.col("p_partkey").alias("id")), "id", 100, seed=3)


@query(
    "t2_latest_listings",
    with_views("listings", "SELECT listing_id, record_id FROM listings ORDER BY listed_at DESC, listing_id DESC LIMIT 500"),
)
def t2(c):
    latest = c.listings.orderBy(F.col("listed_at").desc(), F.col("listing_id").desc()).limit(500)
    return latest.select("listing_id", "record_id")


@query(
    "t3_top_by_score",
    with_views("feedback", "SELECT instance_id, predicted_prob FROM feedback ORDER BY predicted_prob DESC, instance_id LIMIT 50"),
)
def t3(c):
    return c.feedback.orderBy(F.col("predicted_prob").desc(), "instance_id").limit(50).select("instance_id", "predicted_prob")


@query(
    "t3_top_per_seller",
    """SELECT l_suppkey AS seller_id, l_orderkey, l_partkey, l_linenumber, CAST(n AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS n FROM lineitem)
    WHERE n <= 10""",
)
def t3_per_seller(c):
    lines = c.table("lineitem").select(
        F.col("l_suppkey").alias("seller_id"), "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"
    )
    order = (F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"))
    return ordering.top_k_per_group(lines, ["seller_id"], *order, k=10).drop("l_extendedprice")


@query(
    "t6_performance_history",
    with_views(
        "batch_performance",
        "SELECT batch_number, round(accuracy, 6) AS accuracy, correct, total FROM b ORDER BY batch_number",
        {"b": _LAST.format(n=100)},
    ),
)
def t6(c):
    recent = metrics.latest_batches(c.batch_performance).orderBy("batch_number")
    return rounded(recent, "accuracy").select("batch_number", "accuracy", "correct", "total")


_REGISTRY = """SELECT strftime(ts, 'v%Y%m%d_%H%M%S') AS version, CAST(ts AS TIMESTAMP) AS created_at, event_type <> 'error' AS is_active
 FROM events"""


def versions(c):
    """A registry with a row for every event, the errors inactive."""
    rows_ = c.table("events")
    at = F.col("ts").cast("timestamp")
    made = rows_.select(*registry.new_version(at, F.col("props")), "event_type")
    return made.withColumn("is_active", F.col("event_type") != "error").drop("event_type")


LATEST_SQL = f"SELECT arg_max(version, (created_at, version)) AS version FROM ({_REGISTRY}) WHERE is_active"


@query("t7_latest_active", LATEST_SQL)
def t7(c):
    return registry.latest_active(versions(c)).select("version")


@query(
    "t8_best_configurations",
    with_views(
        "feedback",
        """SELECT day, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT strftime(ts, '%Y-%m-%d') AS day,
        count(*) FILTER (predicted_prob > 0.5 AND actual)::DOUBLE AS tp, count(*) FILTER (predicted_prob > 0.5 AND NOT actual)::DOUBLE AS fp,
        count(*) FILTER (predicted_prob <= 0.5 AND actual)::DOUBLE AS fn FROM feedback GROUP BY 1) ORDER BY f1 DESC, day LIMIT 3""",
    ),
)
def t8(c):
    daily = c.feedback.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    scored = rounded(metrics.evaluate(daily, by=["day"]), "f1")
    return scored.orderBy(F.col("f1").desc(), "day").limit(3).select("day", "f1")


@query(
    "t9_enrichment_cap",
    with_views("feedback", "SELECT instance_id FROM feedback ORDER BY predicted_prob DESC, instance_id LIMIT 200"),
)
def t9(c):
    stage_one = c.feedback.orderBy(F.col("predicted_prob").desc(), "instance_id").limit(500)
    return stage_one.orderBy(F.col("predicted_prob").desc(), "instance_id").limit(200).select("instance_id")
