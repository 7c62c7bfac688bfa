"""Sources and sinks (S1-S9): written by Spark from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, with_views
from waxworks.operators.registry import latest_active, new_version
from waxworks.session import scratch_path
from waxworks.sources import landed, sinks
from waxworks.sources.tables import load_table


@query("s1_table_scan", "SELECT p_partkey, p_brand FROM part WHERE p_size > 25 AND p_retailprice < 1500")
def s1(c):
    where = (F.col("p_size") > 25) & (F.col("p_retailprice") < 1500)
    return load_table(c.spark, f"{c.folder}/part.parquet", ["p_partkey", "p_brand"], where)


@query(
    "s2_csv_set",
    with_views("auctions", "SELECT ebay_id, title, TRY_CAST(price AS DOUBLE) AS price, bid_count FROM auctions"),
)
def s2(c):
    base = scratch_path(c.spark, "listings")
    rows = c.auctions.select("ebay_id", "title", "price", "bid_count")
    even = F.col("bid_count") % 2 == 0
    for name, part in (("buyitnow_a", rows.filter(even)), ("buyitnow_b", rows.filter(~even))):
        part.write.option("header", True).option("escape", '"').csv(f"{base}/{name}")
    schema = "ebay_id string, title string, price double, bid_count int"
    return landed.read_csv_set(c.spark, f"{base}/buyitnow_*", schema)


@query(
    "s3_json_lists",
    with_views("sellers", "SELECT 'name' AS kind, name, NULL AS currency FROM sellers UNION ALL SELECT 'object', name, currency FROM sellers"),
)
def s3(c):
    base = scratch_path(c.spark, "sellers")
    # one list per thousand sellers
    chunk = F.floor(F.col("id") / 1000).cast("string").alias("chunk")
    grouped = c.sellers.groupBy(chunk)
    grouped.agg(F.to_json(F.collect_list("name")).alias("value")).write.partitionBy("chunk").text(f"{base}/names")
    grouped.agg(F.to_json(F.collect_list(F.struct("name", "currency"))).alias("value")).write.partitionBy("chunk").text(
        f"{base}/objects"
    )
    names = landed.read_name_list(c.spark, f"{base}/names").select(
        F.lit("name").alias("kind"), "name", F.lit(None).cast("string").alias("currency")
    )
    objects = landed.read_object_list(c.spark, f"{base}/objects", "name string, currency string")
    return names.unionByName(objects.select(F.lit("object").alias("kind"), "name", "currency"))


def _pages(c):
    """The auctions as search responses of 200 items; one item of each page also opens the next."""
    event = F.col("ebay_id").cast("bigint")
    item = F.struct(
        F.col("ebay_id").alias("itemId"), "title", F.struct(F.col("price").alias("value")).alias("price"),
        F.col("end_date").alias("itemEndDate"),
        F.when(F.col("bid").isNotNull(), F.struct(F.col("bid").alias("value"))).alias("currentBidPrice"),
        F.col("bid_count").alias("bidCount"),
    )
    spread = c.auctions.withColumn("page", F.floor(event / 200))
    repeated = spread.filter(event % 200 == 199).withColumn("page", F.col("page") + 1)
    pages = spread.unionByName(repeated).groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    total = c.auctions.agg(F.count("*").alias("total"))
    return pages.crossJoin(total).select(
        F.to_json(
            F.struct(
                "total", F.lit(200).alias("limit"), (F.col("page") * 200).alias("offset"),
                F.col("items").alias("itemSummaries"),
            )
        ).alias("value")
    )


@query(
    "s4_search_pages",
    with_views("auctions", "SELECT ebay_id, title, price, bid, bid_count, end_date FROM auctions"),
)
def s4(c):
    base = scratch_path(c.spark, "pages")
    _pages(c).write.text(base)
    pages = landed.parse_pages(c.spark.read.text(base))
    items = landed.flatten_pages(pages, stop_at_total=True)
    return landed.auction_rows(items).select("ebay_id", "title", "price", "bid", "bid_count", "end_date")


@query(
    "s4_search_pages_capped",
    with_views(
        "auctions",
        """SELECT DISTINCT ebay_id FROM (SELECT ebay_id FROM (
          SELECT ebay_id, CAST(ebay_id AS BIGINT) // 200 AS page FROM auctions
          UNION ALL SELECT ebay_id, CAST(ebay_id AS BIGINT) // 200 + 1 FROM auctions WHERE CAST(ebay_id AS BIGINT) % 200 = 199)
          ORDER BY page, ebay_id LIMIT 2000)""",
    ),
)
def s4_capped(c):
    items = landed.flatten_pages(landed.parse_pages(_pages(c)), cap=2000)
    return landed.auction_rows(items).select("ebay_id")


_STOCK = """SELECT r.id AS discogs_id, media_condition, record_price,
 s.name AS seller, CASE WHEN r.id % 4 = 0 THEN '' ELSE r.artist END AS artist, r.title, r.label, '' AS catno,
 CASE WHEN r.format = 'CD' THEN 'CD' ELSE 'Vinyl LP' END AS format,
 CASE WHEN r.id % 5 = 0 THEN 0 ELSE r.wants END AS wants, CASE WHEN r.id % 5 = 0 THEN 0 ELSE r.haves END AS haves,
 array_to_string(r.genres, '|') AS genres, CASE WHEN r.id % 6 = 0 THEN '' ELSE array_to_string(r.styles, '|') END AS styles, r.year
 FROM listings JOIN sellers s ON s.id = seller_id JOIN records r ON r.id = record_id
 WHERE split_part(listing_id, '-', 4) <> '7'"""


def _stock_json(c):
    records = c.records.withColumnRenamed("id", "record_id")
    sellers = c.sellers.select(F.col("id").alias("seller_id"), "name")
    wide = c.listings.join(records, "record_id").join(sellers, "seller_id")
    key = F.col("record_id")
    price = F.split_part("record_price", F.lit(", "), F.lit(1)).cast("double")
    community = F.when(key % 5 != 0, F.struct(F.col("wants").alias("in_wantlist"), F.col("haves").alias("in_collection")))
    release = F.struct(
        key.alias("id"), F.when(key % 4 != 0, F.col("artist")).alias("artist"), "title", "label",
        F.split("format", ", ").alias("format"), "genres", F.when(key % 6 != 0, F.col("styles")).alias("styles"),
        "year", F.struct(community.alias("community")).alias("stats"),
    )
    seventh = F.split_part("listing_id", F.lit("-"), F.lit(4)) == "7"
    money = F.struct(price.alias("value"), F.split_part("record_price", F.lit(", "), F.lit(2)).alias("currency"))
    return wide.select(
        F.to_json(
            F.struct(
                release.alias("release"), F.col("media_condition").alias("condition"),
                F.when(~seventh, money).alias("price"), F.struct(F.col("name").alias("username")).alias("seller"),
            )
        ).alias("value")
    )


@query("s5_inventory", with_views("listings sellers records", _STOCK))
def s5(c):
    flat, _ = landed.flatten_inventory(_stock_json(c))
    return flat.withColumns({n: F.array_join(n, "|") for n in ("genres", "styles")})


@query("s5_inventory_rejects", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 7")
def s5_rejects(c):
    _, rejects = landed.flatten_inventory(_stock_json(c))
    return rejects.agg(F.count("*").alias("n"))


@query(
    "s6_csv_sink",
    with_views("auctions", "SELECT ebay_id, title, coalesce(price, '') AS price, bid_count, end_date FROM auctions"),
)
def s6(c):
    rows = c.auctions.select("ebay_id", "title", F.coalesce("price", F.lit("")).alias("price"), "bid_count", "end_date")
    path = sinks.write_csv_dated(rows, scratch_path(c.spark, "csv"), "2024-01-10")
    back = landed.read_csv_set(c.spark, path, "ebay_id string, title string, price string, bid_count int, end_date string")
    return back.withColumn("price", F.coalesce("price", F.lit("")))


@query("s7_json_sink", with_views("sellers", "SELECT id, name, currency FROM sellers"))
def s7(c):
    path = sinks.write_results(c.sellers, scratch_path(c.spark, "results"))
    return c.spark.read.schema("id bigint, name string, currency string").json(path)


@query("s8_training_csv", "SELECT p_name AS title, min(lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS ebay_id FROM part GROUP BY p_name")
def s8(c):
    listings = c.table("part").select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("ebay_id"), F.col("p_name").alias("title")
    )
    path = sinks.write_training_csv(listings, scratch_path(c.spark, "training"))
    return landed.read_csv_set(c.spark, path, "ebay_id string, title string")


@query(
    "s9_save_version",
    "SELECT strftime(max(ts), 'v%Y%m%d_%H%M%S') AS version, (SELECT count(*) FROM part) AS n_weights FROM events",
)
def s9(c):
    folder = scratch_path(c.spark, "models")
    events = c.feedback
    stats = F.to_json(F.struct(F.count("*").alias("instances")))
    for moment in (F.min("ts"), F.max("ts")):
        entry = events.agg(moment.alias("at"), stats.alias("stats")).select(*new_version(F.col("at"), F.col("stats")))
        version = entry.first()["version"]
        weights = c.table("part").select(F.col("p_partkey").alias("slot"), (F.col("p_size") / 50).alias("weight"))
        sinks.save_version(weights, entry, folder, version)
    active = latest_active(c.spark.read.parquet(f"{folder}_registry")).select("version")
    saved = c.spark.read.parquet(folder).groupBy("version").agg(F.count("*").alias("n_weights"))
    return active.join(saved, "version")
