"""Scoring sellers' stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.functions.money import suggested_price
from waxworks.functions.numeric import demand
from waxworks.operators.joins import join_checked
from waxworks.operators.ordering import top_k_per_group
from waxworks.operators.rows import allowed_conditions, with_usd

# Weights before any ranking has been learnt from.
DEFAULT_WEIGHTS = {"embedding": 0.33, "price_diff": 0.33, "demand": 0.34}
CONTENDERS = 40


def seller_maxima(priced: DataFrame) -> DataFrame:
    """Highest demand and highest price edge per seller; an edge of 1 where none is positive.

    An aggregate joined back, and not a window: it combines map-side, so a seller with a third of
    the stock costs no more than any other.
    """
    return priced.groupBy("seller_id").agg(
        F.max("demand").alias("max_demand"),
        F.when(F.max("edge") > 0, F.max("edge")).otherwise(1.0).alias("max_edge"),
    )


def score_listings(listings: DataFrame, records: DataFrame, rates: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Score all sellers' stock at once: (seller_id, listing_id, record_id, price, score, ...).

    ``listings`` is (listing_id, seller_id, record_id, record_price, media_condition); ``records`` is
    (record_id, wants, haves, suggested_price, model_score). Only good grades count. Demand and price
    edge are measured against the seller's best. The maxima are a first job over the priced listings, the
    scores a second; beyond the broadcast limit both shuffle the listings to the records.
    """
    priced = with_usd(allowed_conditions(listings), rates).filter(F.col("usd").isNotNull())
    wide = priced.join(records, "record_id")
    listed = F.coalesce(suggested_price(F.col("suggested_price"), F.col("media_condition")), F.lit(0.0))
    measured = wide.withColumns(
        {
            "demand": demand(F.col("wants"), F.col("haves")),
            "edge": F.greatest(F.lit(0.0), listed - F.col("usd")),
        }
    )
    joined = join_checked(measured, seller_maxima(measured), ["seller_id"])
    score = (
        F.lit(weights["embedding"]) * F.col("model_score")
        + F.lit(weights["price_diff"]) * F.col("edge") / F.col("max_edge")
        + F.lit(weights["demand"]) * F.coalesce(F.try_divide("demand", F.nullif("max_demand", F.lit(0.0))), F.lit(0.0))
    )
    return joined.select("seller_id", "listing_id", "record_id", F.col("usd").alias("price"), score.alias("score"))


def selected_totals(selected: DataFrame, price: str = "usd") -> DataFrame:
    return selected.groupBy("seller_id").agg(
        F.count("*").alias("n"), F.sum(price).alias("total_cost"), F.sum("score").alias("total_score")
    )


def contenders(scored: DataFrame, selected: DataFrame, k: int = CONTENDERS) -> DataFrame:
    """The best ``k`` listings of each seller that were not selected."""
    rest = scored.join(selected.select("listing_id"), "listing_id", "left_anti")
    return top_k_per_group(rest, ["seller_id"], F.col("score").desc(), F.col("listing_id"), k=k, name="place")


def next_best(scored: DataFrame, skip: int, k: int = CONTENDERS) -> DataFrame:
    """As :func:`contenders`, where the selected are each seller's best ``skip``: one ranking, no join."""
    ranked = top_k_per_group(scored, ["seller_id"], F.col("score").desc(), F.col("listing_id"), k=skip + k, name="place")
    return ranked.filter(F.col("place") > skip).withColumn("place", F.col("place") - skip)
