"""Tables, and the catalogue views over them.

Every view is lazy: a query reads only the columns and rows it asks for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxworks.operators.joins import join_checked, spread
from waxworks.operators.metrics import batch_performance
from waxworks.operators.ordering import group_rank, row_index

# Units of each currency per US dollar.
RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.79, "CAD": 1.36, "JPY": 150.0, "BRL": 5.0}

# Grade names given to the six pairs of line status flags.
CONDITIONS = {
    "AF": "Near Mint (NM or M-)",
    "AO": "Very Good Plus (VG+)",
    "NF": "Very Good (VG)",
    "NO": "Good Plus (G+)",
    "RF": "Good (G)",
    "RO": "Fair (F)",
}

BATCH_SIZE = 20


def load_table(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Scan a table. Filter and projection reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options) -> DataFrame:
    """Scan a database table in parallel ranges of a numeric key."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options
    )


def currency_rates(spark: SparkSession, rates: dict[str, float] = RATES) -> DataFrame:
    """One row per currency. The list of currencies is fixed, so joins may broadcast it."""
    rows = ", ".join(f"('{code}', {rate}D)" for code, rate in rates.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(currency, rate)")


class Catalogue:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        key = F.col("p_partkey")
        price = (F.floor(F.col("p_retailprice") * 2) / 100).cast("string")
        evaluated = key % 3 != 0
        return self.table("part").select(
            key.alias("id"),
            key.cast("string").alias("discogs_id"),
            F.col("p_brand").alias("artist"),
            F.col("p_name").alias("title"),
            F.when(F.col("p_size") % 2 == 0, F.lit("Vinyl, LP")).otherwise("CD").alias("format"),
            F.col("p_brand").alias("label"),
            F.array("p_type").alias("genres"),
            F.split("p_name", " ").alias("styles"),
            (F.lit(1950) + F.col("p_size")).alias("year"),
            F.when(key % 3 == 0, F.concat(F.lit("<Price "), price, F.lit(" 'USD'>")))
            .when(key % 3 == 1, F.concat(price, F.lit(", USD")))
            .otherwise(price)
            .alias("suggested_price"),
            ((key * 7919) % 500).alias("wants"),
            ((key * 104729) % 400).alias("haves"),
            evaluated.alias("evaluated"),
            (evaluated & (key % 5 == 0)).alias("wanted"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        currency = F.get(F.array(*[F.lit(code) for code in RATES]), F.col("s_nationkey") % 6)
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), currency.alias("currency")
        )

    @cached_property
    def listings(self) -> DataFrame:
        flags = F.concat("l_returnflag", "l_linestatus")
        names = F.create_map(*[F.lit(x) for item in CONDITIONS.items() for x in item])
        condition = F.try_element_at(names, flags)
        price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) / 100).cast("string")
        sellers = self.sellers.select(F.col("id").alias("seller_id"), "currency")
        lines = spread(self.table("lineitem"), "l_orderkey").withColumn("seller_id", F.col("l_suppkey"))
        return lines.join(sellers, "seller_id").select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("listing_id"),
            "seller_id",
            F.col("l_partkey").alias("record_id"),
            F.concat(price, F.lit(", "), F.col("currency")).alias("record_price"),
            condition.alias("media_condition"),
            F.col("l_shipdate").cast("timestamp").alias("listed_at"),
        )

    @cached_property
    def rates(self) -> DataFrame:
        return currency_rates(self.spark)

    @cached_property
    def feedback(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            F.col("event_id").alias("instance_id"),
            F.floor(F.col("event_id") / 4).cast("bigint").alias("record_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            (k / F.lit(100.0)).alias("predicted_prob"),
            (F.col("value") / 500).alias("uncertainty"),
            F.col("event_type").isin("purchase", "signup").alias("actual"),
        )

    @cached_property
    def feedback_batches(self) -> DataFrame:
        """Feedback cut into batches of 20 in time order."""
        placed = row_index(self.feedback, F.col("ts"), F.col("instance_id"))
        return placed.withColumn("batch_number", F.floor(F.col("row_idx") / BATCH_SIZE).cast("bigint"))

    @cached_property
    def batch_performance(self) -> DataFrame:
        return batch_performance(self.feedback_batches)

    @cached_property
    def auctions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        price = F.round("value", 2).cast("string")
        return self.table("events").select(
            F.col("event_id").cast("string").alias("ebay_id"),
            F.concat_ws(" ", F.lit("LP"), "event_type", F.col("user_id").cast("string"), "props").alias("title"),
            F.when(F.col("event_type") != "error", price).alias("price"),
            F.when(F.col("event_type") == "purchase", F.round(F.col("value") + 1, 2).cast("string")).alias("bid"),
            k.alias("bid_count"),
            F.when(F.col("event_id") % 50 == 0, F.lit("soon"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .alias("end_date"),
            F.when(k % 2 == 0, F.lit("AUCTION")).otherwise("FIXED_PRICE").alias("buying_option"),
            F.when(F.col("user_id") % 4 == 0, F.lit("CA")).otherwise("US").alias("country"),
            F.when(F.col("user_id") % 3 == 0, F.lit("1000")).otherwise("3000").alias("condition_id"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """Whole texts; work on them is heavy enough to be worth spreading."""
        return spread(self.table("documents").select("doc_id", "text"), "doc_id")

    @cached_property
    def titles(self) -> DataFrame:
        """Whole texts as titles, with what is known about them."""
        labels = self.table("labels").select("doc_id", "quality")
        return join_checked(self.documents.select("doc_id", F.col("text").alias("title")), labels, ["doc_id"], "left")

    @cached_property
    def keeper_titles(self) -> DataFrame:
        return self.titles.filter("quality = 1").select("doc_id", "title")

    @cached_property
    def candidate_titles(self) -> DataFrame:
        return self.titles.filter("quality is null").select("doc_id", "title")

    @cached_property
    def rankings(self) -> DataFrame:
        """A user's events in time order, cut into rankings of ten."""
        k = F.get_json_object("props", "$.k").cast("int")
        events = self.table("events").select(
            "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
            (k / F.lit(100.0)).alias("embedding"),
            (F.col("value") / 500).alias("price_diff"),
            (F.col("event_type") == "purchase").cast("double").alias("demand"),
        )
        ranked = group_rank(events, ["user_id"], F.col("ts"), F.col("event_id"), name="_n")
        return ranked.select(
            F.concat_ws("-", "user_id", F.floor((F.col("_n") - 1) / 10).cast("bigint")).alias("session_id"),
            ((F.col("_n") - 1) % 10).alias("pos"),
            F.col("event_id").alias("item_id"),
            "embedding", "price_diff", "demand",
        )

    @cached_property
    def aspects(self) -> DataFrame:
        key = F.col("p_partkey")
        even = key % 2 == 0

        def entry(name, value):
            return F.struct(name.alias("name"), value.alias("value"))

        def either(a, b):
            return F.when(even, F.lit(a)).otherwise(F.lit(b))

        year = (F.lit(1950) + F.col("p_size")).cast("string")
        return self.table("part").select(
            key.cast("string").alias("ebay_id"),
            F.array(
                entry(F.lit("Artist"), F.col("p_brand")),
                entry(either("Release Title", "Album"), F.col("p_name")),
                entry(F.lit("Album"), F.upper("p_name")),
                entry(either("Record Label", "Label"), F.when(key % 7 == 0, F.lit("")).otherwise(F.col("p_brand"))),
                entry(F.lit("Label"), F.lit("fallback label")),
                entry(either("Format", "Record Size"), F.lit("LP")),
                entry(either("Release Year", "Year"), year),
                entry(F.lit("Genre"), F.lit("first genre")),
                entry(F.lit("Genre"), F.col("p_type")),
                entry(F.lit("Record Grading"), either("NM", "VG+")),
            ).alias("aspects"),
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        """Vectors in training batches of 128."""
        return self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label",
            F.floor(F.col("vec_id") / 128).cast("bigint").alias("batch"),
        )
