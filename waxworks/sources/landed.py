"""Readers for files that other systems leave behind: CSV sets, JSON lists, search pages, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxworks.operators.ordering import keep_first

PRICE = "struct<value: string>"
ASPECT = "struct<type: string, name: string, value: string>"
ITEM = (
    f"struct<itemId: string, title: string, price: {PRICE}, itemWebUrl: string, itemEndDate: string, "
    f"itemCreationDate: string, currentBidPrice: {PRICE}, bidCount: int, localizedAspects: array<{ASPECT}>>"
)
PAGE = f"struct<href: string, total: bigint, `limit`: bigint, offset: bigint, itemSummaries: array<{ITEM}>>"
INVENTORY = (
    "struct<release: struct<id: bigint, artist: string, title: string, label: string, catalog_number: string, "
    "format: array<string>, genres: array<string>, styles: array<string>, year: int, "
    "stats: struct<community: struct<in_wantlist: bigint, in_collection: bigint>>>, "
    "condition: string, price: struct<value: double, currency: string>, seller: struct<username: string>>"
)


def read_csv_set(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All CSV files a glob names, as one frame. The schema is given, so no pass is spent on guessing."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(pattern)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON list of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("name"))


def read_object_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_pages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Search responses from JSON text; text that does not parse gives no row."""
    parsed = raw.select(F.from_json(column, PAGE).alias("p")).filter("p.offset is not null")
    return parsed.select("p.*")


def flatten_pages(pages: DataFrame, cap: int | None = None, stop_at_total: bool = False) -> DataFrame:
    """Items of a paged search, each once, at its first place: (offset, pos, item).

    Paging ends before the first empty page, or with ``stop_at_total`` once a page reaches the
    total it reports. ``cap`` keeps the first items in page order.
    """
    size = F.coalesce(F.size("itemSummaries"), F.lit(0))
    ends = [F.min(F.when(size == 0, F.col("offset"))).alias("_empty")]
    if stop_at_total:
        ends.append(F.min(F.when(F.col("offset") + F.col("limit") >= F.col("total"), F.col("offset"))).alias("_last"))
    bounded = pages.crossJoin(pages.agg(*ends))  # one-row right side
    keep = F.col("_empty").isNull() | (F.col("offset") < F.col("_empty"))
    if stop_at_total:
        keep = keep & (F.col("_last").isNull() | (F.col("offset") <= F.col("_last")))
    items = bounded.filter(keep).select("offset", F.posexplode("itemSummaries").alias("pos", "item"))
    if cap is not None:
        items = items.orderBy("offset", "pos").limit(cap)
    single = keep_first(items.withColumn("_id", F.col("item.itemId")), ["_id"], F.col("offset"), F.col("pos"))
    return single.drop("_id")


def auction_rows(items: DataFrame) -> DataFrame:
    """Flat auction columns of searched items."""
    i = "item."
    return items.select(
        F.col(i + "itemId").alias("ebay_id"), F.col(i + "title").alias("title"),
        F.col(i + "price.value").alias("price"), F.col(i + "currentBidPrice.value").alias("bid"),
        F.coalesce(i + "bidCount", F.lit(0)).alias("bid_count"), F.col(i + "itemWebUrl").alias("url"),
        F.col(i + "itemEndDate").alias("end_date"), F.col(i + "itemCreationDate").alias("creation_date"),
        F.col(i + "localizedAspects").alias("aspects"),
    )


def flatten_inventory(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """A seller's stock from JSON, with defaults for what is missing, and the rows that are unusable.

    A text is parsed once: as an expression the result would be computed again for every field of the filter,
    and so would the text. What is exploded is a column like any other.
    """
    parsed = raw.select(column, F.explode(F.array(F.from_json(column, INVENTORY))).alias("_l"))
    needed = ["release.id", "price.value", "price.currency", "seller.username"]
    usable = F.lit(True)
    for path in needed:
        usable = usable & F.col("_l." + path).isNotNull()

    def text(path):
        return F.coalesce(F.col("_l." + path), F.lit(""))

    empty = F.array().cast("array<string>")
    flat = parsed.filter(usable).select(
        F.col("_l.release.id").alias("discogs_id"),
        F.col("_l.condition").alias("media_condition"),
        F.concat(F.col("_l.price.value").cast("string"), F.lit(", "), F.col("_l.price.currency")).alias("record_price"),
        F.col("_l.seller.username").alias("seller"),
        text("release.artist").alias("artist"), text("release.title").alias("title"),
        text("release.label").alias("label"), text("release.catalog_number").alias("catno"),
        F.array_join(F.coalesce("_l.release.format", empty), " ").alias("format"),
        F.coalesce("_l.release.stats.community.in_wantlist", F.lit(0)).alias("wants"),
        F.coalesce("_l.release.stats.community.in_collection", F.lit(0)).alias("haves"),
        F.coalesce("_l.release.genres", empty).alias("genres"),
        F.coalesce("_l.release.styles", empty).alias("styles"),
        F.col("_l.release.year").alias("year"),
    )
    return flat, parsed.filter(~usable).select(column)
