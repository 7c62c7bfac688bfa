"""Choosing records to show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.functions.seeded import seeded_key
from waxworks.operators.bandit import select_batch
from waxworks.operators.features import fit_features, fit_titles, transform_features, with_titles
from waxworks.operators.model import KeeperModel, design, score
from waxworks.operators.ordering import seeded_sample

LATEST, TOP, CANDIDATES = 500, 50, 1000


def record_features(records: DataFrame, fitted: DataFrame | None = None, terms: DataFrame | None = None, auction_title: str | None = None) -> DataFrame:
    """Records with dense features, the block of their titles and the model's design.

    Ranges and vocabulary are fitted on the records themselves unless given. Where the column
    ``auction_title`` has a text, that is a record's title.
    """
    fitted = fit_features(records) if fitted is None else fitted
    terms = fit_titles(records, auction_title=auction_title) if terms is None else terms
    return design(with_titles(transform_features(records, fitted), terms, auction_title))


def pick_of_the_day(listings: DataFrame, scores: DataFrame, seed, latest: int = LATEST, top: int = TOP) -> DataFrame:
    """One listing at random among the best-scored of the latest.

    ``listings`` is (listing_id, record_id, listed_at); ``scores`` is (record_id, score).
    """
    recent = listings.orderBy(F.col("listed_at").desc(), F.col("listing_id").desc()).limit(latest)
    best = recent.join(scores, "record_id").orderBy(F.col("score").desc(), F.col("listing_id")).limit(top)
    key = F.col("listing_id")
    return best.orderBy(seeded_key(key, seed=seed), key).limit(1).select("listing_id", "record_id", "score")


def labelling_batch(records: DataFrame, model: KeeperModel | None, batch_number: int, seed=0) -> DataFrame:
    """The next batch to label: a random thousand unevaluated records, scored, then selected."""
    pool = seeded_sample(records.filter(~F.col("evaluated")), "id", CANDIDATES, seed)
    featured = record_features(pool, fit_features(records), fit_titles(records)).select("id", "x")
    scored = score(featured, model).select(
        "id", "mean", F.coalesce("uncertainty", F.lit(0.0)).alias("uncertainty")
    )
    return select_batch(scored, batch_number, seed=seed)
