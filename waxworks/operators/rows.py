"""Row-level work: validation, conversion, insert-if-absent, labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxworks.functions.money import price_amount, price_currency, to_usd
from waxworks.functions.payload import instant
from waxworks.operators.ordering import keep_first, top_k_per_group

# The grades worth buying.
ALLOWED_CONDITIONS = ("Near Mint (NM or M-)", "Very Good Plus (VG+)")
TRAINING_COLUMNS = ("artist", "title", "label", "genres", "styles", "wants", "haves", "year")


def model_inputs(records: DataFrame) -> DataFrame:
    return records.select(*TRAINING_COLUMNS)


def training_set(records: DataFrame) -> DataFrame:
    """Evaluated records with their label; having none is an error."""
    rows = records.filter("evaluated").select(*TRAINING_COLUMNS, "wanted")
    if rows.isEmpty():
        raise ValueError("no evaluated records to train on")
    return rows


def allowed_conditions(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("media_condition").isin(*ALLOWED_CONDITIONS))


def worth_buying(format_text: Column, wants: Column, haves: Column) -> Column:
    """An LP that more people want than have; a missing count is 0."""
    return F.contains(format_text, F.lit("LP")) & (F.coalesce(wants, F.lit(0)) > F.coalesce(haves, F.lit(0)))


def ends_within(end_date: Column, as_of: Column, after_hours: int = 24, before_hours: int = 48) -> Column:
    """Strictly inside a span after ``as_of``; an unreadable date is outside."""
    ends = instant(end_date)
    lo = as_of + F.expr(f"INTERVAL {after_hours} HOURS")
    hi = as_of + F.expr(f"INTERVAL {before_hours} HOURS")
    return F.coalesce((ends > lo) & (ends < hi), F.lit(False))


def on_offer(df: DataFrame, option: str, until: Column | None = None, country: str = "US", condition_id: str = "3000") -> DataFrame:
    """Marketplace search: used items of one country and buying option, soonest ending first."""
    found = df.filter(
        (F.col("condition_id") == condition_id) & (F.col("country") == country) & (F.col("buying_option") == option)
    )
    ends = instant(F.col("end_date"))
    if until is not None:
        found = found.filter(ends <= until)
    return found.orderBy(ends, F.col("ebay_id"))


def reject_reason(required: list[str]) -> Column:
    """Name of the first required field that is missing or empty, null for a good row."""
    reason = F.when(F.lit(False), F.lit(""))
    for name in required:
        reason = reason.when(F.coalesce(F.col(name).cast("string"), F.lit("")) == "", F.lit(f"missing {name}"))
    return reason


def with_usd(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """Add price, currency and ``usd``; null when price or currency is unusable.

    ``rates`` has a row per currency: a list that is fixed, and small enough to broadcast.
    """
    parsed = listings.withColumns(
        {"price": price_amount(F.col("record_price")), "currency": price_currency(F.col("record_price"))}
    )
    return parsed.join(F.broadcast(rates), "currency", "left").withColumn(
        "usd", to_usd(F.col("price"), F.col("rate"))
    ).drop("rate")


def zip_positions(df: DataFrame, keep: list[str], *arrays: str) -> DataFrame:
    """One row per position of parallel lists; rows whose lists differ in length are dropped."""
    size = F.size(arrays[0])
    equal = F.lit(True)
    for name in arrays[1:]:
        equal = equal & (F.size(name) == size)
    zipped = df.filter(equal).select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"))
    return zipped.select(*keep, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of ``incoming`` to append: the first of each key that ``target`` does not have."""
    return keep_first(incoming, keys, *order).join(target.select(*keys), keys, "left_anti")


def attach_first(left: DataFrame, right: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """Left join to the first match of each key, 0 where there is none."""
    first = keep_first(right, [key], *order).select(key, value)
    return left.join(first, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def last_label(labels: DataFrame, key: str) -> DataFrame:
    """The last label of each key by position: (key, label). Combined map-side, so hot keys are fine."""
    return labels.groupBy(key).agg(F.max_by("label", "pos").alias("label"))


def apply_annotations(listings: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """New snapshot with labels applied: ``wanted`` set, ``evaluated`` true where a label exists.

    ``labels`` is (key, label, pos).
    """
    last = last_label(labels, key).withColumnRenamed("label", "_label")
    joined = listings.join(last, key, "left")
    return joined.withColumns(
        {
            "wanted": F.coalesce(F.col("_label"), F.col("wanted")),
            "evaluated": F.col("evaluated") | F.col("_label").isNotNull(),
        }
    ).drop("_label")


def unknown_keys(labels: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that were labelled but do not exist."""
    return labels.select(key).join(known.select(key), key, "left_anti").distinct()


def apply_record_labels(records: DataFrame, listings: DataFrame, labels: DataFrame) -> DataFrame:
    """New snapshot of records from labels on their listings: (listing_id, label, pos)."""
    known = listings.select("listing_id", F.col("record_id").alias("id"))
    by_record = labels.join(known, "listing_id").select("id", "label", "pos")
    return apply_annotations(records, by_record, "id")


def mark_evaluated(records: DataFrame, ids: DataFrame) -> DataFrame:
    """New snapshot in which the records of ``ids`` count as evaluated."""
    marked = ids.select("id").distinct().withColumn("_marked", F.lit(True))
    joined = records.join(marked, "id", "left")
    return joined.withColumn("evaluated", F.col("evaluated") | F.col("_marked").isNotNull()).drop("_marked")


def recent_ids(existing: DataFrame, incoming: DataFrame, k: int = 50) -> DataFrame:
    """Each user's list of ids, newest first, after an update: (user_id, record_id, source, pos).

    A known user keeps the first ``k`` of new ids followed by the old ones not among them. A user
    seen for the first time keeps the whole list, however long, so those rows are never ranked.
    """
    known = existing.select("user_id").distinct()
    fresh = incoming.withColumn("source", F.lit(0))
    # A user's stored list never outgrows k unless it is still the first one, so it may be long.
    updated = incoming.select("user_id").distinct()
    old = existing.withColumn("source", F.lit(1))
    untouched = old.join(updated, "user_id", "left_anti")
    first_lists = fresh.join(known, "user_id", "left_anti")
    both = fresh.join(known, "user_id", "left_semi").unionByName(old.join(updated, "user_id", "left_semi"))
    single = both.groupBy("user_id", "record_id").agg(F.min(F.struct("source", "pos")).alias("o"))
    kept = top_k_per_group(
        single.select("user_id", "record_id", "o.source", "o.pos"), ["user_id"],
        F.col("source"), F.col("pos"), F.col("record_id"), k=k, name="_n",
    ).drop("_n")
    cols = ["user_id", "record_id", "source", "pos"]
    return untouched.select(cols).unionByName(first_lists.select(cols)).unionByName(kept.select(cols))


def by_agreement(page: DataFrame) -> DataFrame:
    """Rows of a labelling page with agreements first, and where the others begin.

    ``page`` is (page, pos, id, mean, selected); pages hold one batch each.
    """
    agree = F.col("selected") == (F.col("mean") > 0.5)
    tagged = page.withColumn("agree", agree)
    whole = Window.partitionBy("page")
    order = whole.orderBy(F.col("agree").desc(), F.col("pos"))
    hits = F.sum(F.col("agree").cast("bigint")).over(whole)
    return tagged.select(
        "page", "id", "agree", F.row_number().over(order).alias("place"), hits.alias("divider"),
        F.floor(hits * 100 / F.count("*").over(whole) + 0.5).cast("bigint").alias("accuracy"),
    )
