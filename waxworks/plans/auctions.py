"""Auctions: which to look at, which to keep, what to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxworks.functions.payload import aspect_columns, current_bid, instant
from waxworks.operators.ordering import keep_first
from waxworks.operators.rows import attach_first, ends_within, insert_if_absent
from waxworks.operators.similarity import similarity_filter
from waxworks.operators.tfidf import fit_tfidf, long_form, tfidf_vectors
from waxworks.session import stable

SHORTLIST, STAGE_ONE, ENRICHED = 1000, 500, 200


def auction_shortlist(items: DataFrame, keepers: DataFrame, as_of: Column, n: int = SHORTLIST, seed=0, digits: int | None = None) -> DataFrame:
    """Auctions ending a day from now that read most like a keeper, in random order.

    ``items`` is (ebay_id, title, price, bid, bid_count, end_date), ``keepers`` is (id, title).
    """
    soon = items.filter(ends_within(F.col("end_date"), as_of))
    priced = soon.select(
        F.col("ebay_id").alias("id"), "title", F.coalesce("price", F.lit("")).alias("price"),
        current_bid(F.col("bid"), F.col("price")).alias("current_bid"), "bid_count", "end_date",
    )
    top = similarity_filter(priced.select("id", "title"), keepers, n, seed, digits=digits)
    return top.join(priced, "id").withColumnRenamed("id", "ebay_id")


def save_chosen(items: DataFrame, aspects: DataFrame, chosen: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows to append for the chosen auctions: parsed metadata, times and prices, each id once."""
    found = aspect_columns(F.col("aspects"))
    parsed = aspects.select("ebay_id", *[v.alias(k) for k, v in found.items()])
    wanted = items.join(chosen.select("ebay_id").distinct(), "ebay_id", "left_semi")
    rows = wanted.join(parsed, "ebay_id").select(
        "ebay_id", F.col("title").alias("ebay_title"), F.coalesce("price", F.lit("")).alias("price"),
        current_bid(F.col("bid"), F.col("price")).alias("current_bid"), "bid_count",
        instant(F.col("end_date")).alias("end_date"), *found,
    )
    return insert_if_absent(saved, rows, ["ebay_id"], F.col("ebay_id"))


def recommend(candidates: DataFrame, aspects: DataFrame, top: int = STAGE_ONE, enriched: int = ENRICHED) -> tuple[DataFrame, DataFrame]:
    """Best-scored auctions with their metadata, and the counts of each stage.

    ``candidates`` is (ebay_id, title, prediction). The first ``top`` by prediction are kept, the
    first ``enriched`` of them get metadata where it exists.
    """
    first = keep_first(candidates, ["ebay_id"], F.col("prediction").desc(), F.col("title"))
    order = (F.col("prediction").desc(), F.col("ebay_id"))
    stage_one = first.orderBy(*order).limit(top)
    stage_two = stage_one.orderBy(*order).limit(enriched)
    found = aspect_columns(F.col("aspects"))
    parsed = aspects.join(stage_two.select("ebay_id"), "ebay_id", "left_semi").select(
        "ebay_id", *[v.alias(k) for k, v in found.items()]
    )
    rows = attach_first(
        parsed, stage_two.select("ebay_id", "prediction"), "ebay_id", "prediction", F.col("prediction").desc()
    ).join(stage_two.select("ebay_id", "title"), "ebay_id")
    counts = (
        first.agg(F.count("*").alias("total_listings"))
        .crossJoin(stage_one.agg(F.count("*").alias("stage1_candidates")))
        .crossJoin(parsed.agg(F.count("*").alias("stage2_enriched")))
    )
    return rows.orderBy(*order), counts


def title_training_matrix(listings: DataFrame, stop_words: list[str], max_features: int = 1000) -> DataFrame:
    """TF-IDF of the titles in long form, next to price and label: (id, term, weight, price, label).

    ``listings`` is (id, title, price text, label). Words are runs of two or more letters and digits;
    no document frequency is too low or too high.
    """
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    docs = listings.select("id", F.filter(words, lambda w: ~w.isin(*stop_words)).alias("tokens"))
    terms = stable(fit_tfidf(docs, max_features, min_df=1, max_df=1.0, distinct=False))
    flat = long_form(tfidf_vectors(docs, terms, max_features, distinct=False), terms, max_features)
    known = listings.select("id", F.col("price").try_cast("double").alias("price"), "label")
    return flat.join(known, "id")
