"""Sessions in which a person ranks listings ten at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.functions.seeded import seeded_key
from waxworks.operators.metrics import count_if

SESSION_SIZE = 400
PAGE = 10


def session_progress(items: DataFrame, page: int = PAGE) -> DataFrame:
    """Whole batches per session and how many are done; items past the last whole batch are dropped.

    ``items`` is (session_id, done).
    """
    return items.groupBy("session_id").agg(
        F.floor(F.count("*") / page).cast("bigint").alias("total_batches"),
        F.floor(count_if(F.col("done")) / page).cast("bigint").alias("completed_batches"),
    )


def ranking_batches(listings: DataFrame, records: DataFrame, n: int = SESSION_SIZE, size: int = PAGE, seed=0) -> DataFrame:
    """A new session: listings of wanted records at random, best score first, in batches.

    ``listings`` is (listing_id, record_id, score); ``records`` has id, evaluated, wanted.
    """
    wanted = records.filter(F.col("evaluated") & F.col("wanted")).select(F.col("id").alias("record_id"))
    pool = listings.join(wanted, "record_id")
    key = F.col("listing_id")
    drawn = pool.orderBy(seeded_key(key, seed=seed), key).limit(n)
    # at most n rows: one sorted array gives the places
    entry = F.struct((-F.col("score")).alias("o"), "listing_id", "record_id", "score")
    packed = drawn.agg(F.sort_array(F.collect_list(entry)).alias("a"))
    placed = packed.select(F.posexplode("a").alias("place", "e"), F.size("a").alias("_n"))
    whole = F.floor(F.col("_n") / size) * size
    return placed.filter(F.col("place") < whole).select(
        "e.listing_id", "e.record_id", "e.score", "place",
        F.floor(F.col("place") / size).cast("int").alias("batch_index"),
    )


def next_batch(batches: DataFrame, completed: int) -> DataFrame:
    """The first batch not ranked yet; no rows when the session is over."""
    return batches.filter(F.col("batch_index") == completed)
