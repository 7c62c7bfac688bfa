"""Taking in sellers' stock."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.functions.money import price_amount, price_currency
from waxworks.operators.metrics import count_if
from waxworks.operators.rows import insert_if_absent, reject_reason

REQUIRED = ["discogs_id", "record_price", "media_condition"]


class Intake(NamedTuple):
    sellers: DataFrame
    records: DataFrame
    listings: DataFrame
    rejects: DataFrame
    report: DataFrame


def split_prices(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings with price and currency taken apart, and those whose text does not allow it."""
    amount = price_amount(F.col("record_price"))
    good = listings.filter(amount.isNotNull()).withColumns({"price": amount, "currency": price_currency(F.col("record_price"))})
    return good, listings.filter(amount.isNull())


def ingest(incoming: DataFrame, sellers: DataFrame, records: DataFrame, listings: DataFrame, keep_copies: bool) -> Intake:
    """What a delivery adds to each table.

    ``incoming`` is (listing_id, seller, discogs_id, record_price, media_condition, ...). Sellers and
    records are inserted if absent. Listings are all appended with ``keep_copies``, else inserted if
    the seller does not yet list the record.
    """
    parsed = incoming.withColumns(
        {"price": price_amount(F.col("record_price")), "currency": price_currency(F.col("record_price"))}
    )
    reason = F.coalesce(reject_reason(REQUIRED), F.when(F.col("price").isNull(), F.lit("bad record_price")))
    checked = parsed.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    order = F.col("listing_id")
    new_listings = good if keep_copies else insert_if_absent(listings, good, ["seller", "discogs_id"], order)
    return Intake(
        sellers=insert_if_absent(sellers, good, ["seller"], order).select("seller"),
        records=insert_if_absent(records, good, ["discogs_id"], order).select("discogs_id", "listing_id"),
        listings=new_listings,
        rejects=checked.filter(F.col("reason").isNotNull()).select("listing_id", "reason"),
        report=checked.agg(
            count_if(F.col("reason").isNull()).alias("processed"), count_if(F.col("reason").isNotNull()).alias("errors")
        ),
    )
