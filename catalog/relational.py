"""Predicates (P), joins (J1-J6, J12) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, seeded_sql, with_views
from waxworks.functions import payload
from waxworks.operators import rows
from waxworks.operators.bandit import optimistic
from waxworks.operators.metrics import count_if
from waxworks.operators.ordering import keep_first, seeded_sample

AS_OF = "2024-01-10 00:00:00"
_INPUTS = "artist, title, label, array_to_string(genres, '|') AS genres, array_to_string(styles, '|') AS styles, wants, haves, year"


def _flat(df):
    return df.withColumns({n: F.array_join(n, "|") for n in ("genres", "styles")})


@query("p1_training_set", with_views("records", f"SELECT {_INPUTS}, wanted FROM records WHERE evaluated"))
def p1(c):
    return _flat(rows.training_set(c.records))


@query(
    "p2_unevaluated_sample",
    with_views("records", f"SELECT id, title FROM records WHERE NOT evaluated ORDER BY {seeded_sql('id', seed=11)}, id LIMIT 1000"),
)
def p2(c):
    return seeded_sample(c.records.filter(~F.col("evaluated")), "id", 1000, seed=11).select("id", "title")


_ALLOWED = "media_condition IN (" + ", ".join(f"'{x}'" for x in rows.ALLOWED_CONDITIONS) + ")"


@query("p3_allowed_conditions", with_views("listings", f"SELECT listing_id, media_condition FROM listings WHERE {_ALLOWED}"))
def p3(c):
    return rows.allowed_conditions(c.listings).select("listing_id", "media_condition")


@query(
    "p4_worth_buying",
    with_views("records", "SELECT id, format, wants, haves FROM records WHERE contains(format, 'LP') AND wants > haves"),
)
def p4(c):
    keep = rows.worth_buying(F.col("format"), F.col("wants"), F.col("haves"))
    return c.records.filter(keep).select("id", "format", "wants", "haves")


_ENDS = "TRY_CAST(rtrim(end_date, 'Z') AS TIMESTAMP)"


@query(
    "p5_auctions_ending",
    with_views(
        "auctions",
        f"""SELECT ebay_id, end_date FROM auctions WHERE {_ENDS} > TIMESTAMP '{AS_OF}' + INTERVAL 24 HOURS
        AND {_ENDS} < TIMESTAMP '{AS_OF}' + INTERVAL 48 HOURS""",
    ),
)
def p5(c):
    as_of = F.lit(AS_OF).cast("timestamp")
    return c.auctions.filter(rows.ends_within(F.col("end_date"), as_of)).select("ebay_id", "end_date")


@query(
    "p6_on_offer",
    with_views(
        "auctions",
        f"""SELECT ebay_id, title, end_date FROM auctions WHERE condition_id = '3000' AND country = 'US'
        AND buying_option = 'AUCTION' AND {_ENDS} <= TIMESTAMP '{AS_OF}'""",
    ),
)
def p6(c):
    return rows.on_offer(c.auctions, "AUCTION", F.lit(AS_OF).cast("timestamp")).select("ebay_id", "title", "end_date")


@query(
    "p7_current_bid",
    with_views("auctions", "SELECT ebay_id, coalesce(bid, price, '') AS current_bid, coalesce(price, '') AS price FROM auctions"),
)
def p7(c):
    return c.auctions.select(
        "ebay_id", payload.current_bid(F.col("bid"), F.col("price")).alias("current_bid"),
        F.coalesce("price", F.lit("")).alias("price"),
    )


@query("p8_model_inputs", with_views("records", f"SELECT {_INPUTS} FROM records"))
def p8(c):
    return _flat(rows.model_inputs(c.records))


_INCOMING = """SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS listing_id,
 CASE WHEN l_partkey % 19 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS discogs_id,
 CASE WHEN l_linenumber < 7 THEN CAST(l_extendedprice AS VARCHAR) || ', USD' ELSE '' END AS record_price,
 CASE WHEN l_tax > 0 THEN l_returnflag END AS media_condition FROM lineitem"""


def _incoming(c):
    return c.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("listing_id"),
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_partkey").cast("string")).alias("discogs_id"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.col("l_extendedprice").cast("string"), F.lit(", USD")))
        .otherwise("").alias("record_price"),
        F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("media_condition"),
    )


@query(
    "p9_reject_reasons",
    f"""SELECT listing_id, CASE WHEN coalesce(discogs_id, '') = '' THEN 'missing discogs_id'
    WHEN coalesce(record_price, '') = '' THEN 'missing record_price'
    WHEN coalesce(media_condition, '') = '' THEN 'missing media_condition' END AS reason FROM ({_INCOMING})""",
)
def p9(c):
    reason = rows.reject_reason(["discogs_id", "record_price", "media_condition"])
    return _incoming(c).select("listing_id", reason.alias("reason"))


# Labels for auctions: each event labels the auction of its number times three.
_ANNOTATIONS = "SELECT CAST(instance_id * 3 % 12000 AS VARCHAR) AS ebay_id, actual AS label, instance_id AS pos FROM feedback"


def annotations(c):
    return c.feedback.select(
        (F.col("instance_id") * 3 % 12000).cast("string").alias("ebay_id"),
        F.col("actual").alias("label"), F.col("instance_id").alias("pos"),
    )


def unlabelled(c):
    return c.auctions.select("ebay_id", F.lit(False).alias("wanted"), F.lit(False).alias("evaluated"))


ANNOTATED_SQL = with_views(
    "feedback auctions",
    """SELECT ebay_id, coalesce(label, false) AS wanted, label IS NOT NULL AS evaluated
    FROM auctions LEFT JOIN (SELECT ebay_id, arg_max(label, pos) AS label FROM notes GROUP BY ebay_id) USING (ebay_id)""",
    {"notes": _ANNOTATIONS},
)


@query("p10_annotate", ANNOTATED_SQL)
def p10(c):
    return rows.apply_annotations(unlabelled(c), annotations(c), "ebay_id")


@query(
    "p10_unknown_ids",
    with_views(
        "feedback auctions",
        "SELECT DISTINCT ebay_id FROM notes WHERE ebay_id NOT IN (SELECT ebay_id FROM auctions)",
        {"notes": _ANNOTATIONS},
    ),
)
def p10_unknown(c):
    return rows.unknown_keys(annotations(c), c.auctions, "ebay_id")


@query(
    "p10_label_counts",
    with_views(
        "feedback",
        "SELECT count(*) FILTER (label) AS keepers, count(*) FILTER (NOT label) AS non_keepers FROM notes",
        {"notes": _ANNOTATIONS},
    ),
)
def p10_counts(c):
    label = F.col("label")
    return annotations(c).agg(count_if(label).alias("keepers"), count_if(~label).alias("non_keepers"))


@query("p11_evaluated_count", with_views("records", "SELECT count(*) AS n FROM records WHERE evaluated"))
def p11(c):
    return c.records.filter("evaluated").agg(F.count("*").alias("n"))


@query(
    "j1_listing_record_seller",
    with_views(
        "listings records sellers",
        """SELECT listing_id, r.title, r.year, s.name AS seller FROM listings l JOIN records r ON r.id = l.record_id
        JOIN sellers s ON s.id = l.seller_id""",
    ),
)
def j1(c):
    records = c.records.select(F.col("id").alias("record_id"), "title", "year")
    sellers = c.sellers.select(F.col("id").alias("seller_id"), F.col("name").alias("seller"))
    return c.listings.join(records, "record_id").join(sellers, "seller_id").select("listing_id", "title", "year", "seller")


@query(
    "j2_semi_join",
    with_views("records feedback", "SELECT id, title FROM records WHERE id IN (SELECT record_id FROM feedback WHERE actual)"),
)
def j2(c):
    ids = c.feedback.filter("actual").select(F.col("record_id").alias("id"))
    return c.records.join(ids, "id", "left_semi").select("id", "title")


@query(
    "j3_feedback_records",
    with_views(
        "records feedback",
        "SELECT instance_id, record_id, title, r.id IS NOT NULL AS found FROM feedback LEFT JOIN records r ON r.id = record_id",
    ),
)
def j3(c):
    records = c.records.select(F.col("id").alias("record_id"), "title")
    cols = ["instance_id", "record_id"]
    found = c.feedback.select(*cols).join(records, "record_id").withColumn("found", F.lit(True))
    missing = c.feedback.select(*cols).join(records, "record_id", "left_anti").select(
        *cols, F.lit(None).cast("string").alias("title"), F.lit(False).alias("found")
    )
    return found.select(*cols, "title", "found").unionByName(missing)


@query(
    "j4_attach_prediction",
    with_views(
        "metadata feedback",
        """SELECT ebay_id, artist, coalesce(p, 0.0) AS prediction FROM metadata LEFT JOIN
        (SELECT CAST(record_id AS VARCHAR) AS ebay_id, arg_min(predicted_prob, instance_id) AS p FROM feedback
         WHERE actual GROUP BY 1) USING (ebay_id)""",
    ),
)
def j4(c):
    found = payload.aspect_columns(F.col("aspects"))
    listings = c.aspects.select("ebay_id", found["artist"].alias("artist"))
    scores = c.feedback.filter("actual").select(
        F.col("record_id").cast("string").alias("ebay_id"), F.col("predicted_prob").alias("prediction"), "instance_id"
    )
    return rows.attach_first(listings, scores, "ebay_id", "prediction", F.col("instance_id"))




@query(
    "j5_usd_conversion",
    with_views(
        "listings rates",
        """SELECT listing_id, round(TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) / rate, 6) AS usd,
        rate IS NULL AS rejected FROM listings LEFT JOIN (SELECT * FROM rates WHERE currency <> 'BRL') k
        ON k.currency = split_part(record_price, ', ', 2)""",
    ),
)
def j5(c):
    priced = rows.with_usd(c.listings, c.rates.filter("currency <> 'BRL'"))
    return priced.select("listing_id", F.round("usd", 6).alias("usd"), F.col("usd").isNull().alias("rejected"))


@query(
    "j6_positional_zip",
    with_views(
        "feedback_batches",
        """SELECT batch_number, CAST(row_number() OVER (PARTITION BY batch_number ORDER BY ts, instance_id) - 1 AS INT) AS pos,
        instance_id AS records, actual AS labels, predicted_prob AS predictions FROM feedback_batches""",
    ),
)
def j6(c):
    # a batch is twenty rows, so each list is short
    item = F.struct("row_idx", "instance_id", "actual", "predicted_prob")
    packed = c.feedback_batches.groupBy("batch_number").agg(F.sort_array(F.collect_list(item)).alias("b"))
    lists = packed.select(
        "batch_number", F.col("b.instance_id").alias("records"), F.col("b.actual").alias("labels"),
        F.col("b.predicted_prob").alias("predictions"),
    )
    return rows.zip_positions(lists, ["batch_number"], "records", "labels", "predictions")


@query(
    "j12_insert_if_absent",
    with_views(
        "records feedback",
        """SELECT record_id AS id, min(instance_id) AS instance_id FROM feedback
        WHERE record_id NOT IN (SELECT id FROM records WHERE evaluated) GROUP BY record_id""",
    ),
)
def j12(c):
    incoming = c.feedback.select(F.col("record_id").alias("id"), "instance_id")
    return rows.insert_if_absent(c.records.filter("evaluated"), incoming, ["id"], F.col("instance_id"))


@query(
    "u1_union_all",
    "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer",
)
def u1(c):
    suppliers = c.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = c.table("customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return suppliers.unionByName(customers)


@query(
    "u1_flatten_batches",
    with_views("feedback_batches", "SELECT batch_number // 5 AS buffer, instance_id FROM feedback_batches"),
)
def u1_flatten(c):
    # five batches of twenty per buffer
    batches = c.feedback_batches.groupBy("batch_number").agg(F.collect_list("instance_id").alias("ids"))
    buffers = batches.groupBy(F.floor(F.col("batch_number") / 5).cast("bigint").alias("buffer")).agg(
        F.flatten(F.collect_list("ids")).alias("ids")
    )
    return buffers.select("buffer", F.explode("ids").alias("instance_id"))


@query("u2_keep_first", "SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY p_name")
def u2(c):
    titles = c.table("part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id"))
    return keep_first(titles, ["title"], F.col("id"))


_EXPLORE = "SELECT instance_id AS id, row_number() OVER (ORDER BY uncertainty DESC, instance_id) - 1 AS place FROM feedback QUALIFY place < 60"
_EXPLOIT = "SELECT instance_id AS id, 59 + row_number() OVER (ORDER BY predicted_prob + 2 * uncertainty DESC, instance_id) AS place FROM feedback QUALIFY place < 160"


def _explore_exploit(c):
    rows_ = c.feedback.select(F.col("instance_id").alias("id"), "predicted_prob", "uncertainty")

    def numbered(order, n, start):
        top = rows_.withColumn("o", order).orderBy(F.col("o").desc(), "id").limit(n)
        packed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("o")).alias("k"), "id"))).alias("a"))
        return packed.select(F.posexplode("a").alias("place", "e")).select("e.id", (F.col("place") + start).alias("place"))

    score = optimistic(F.col("predicted_prob"), F.col("uncertainty"))
    return numbered(F.col("uncertainty"), 60, 0), numbered(score, 100, 60)


@query(
    "u3_ordered_union",
    with_views(
        "feedback",
        "SELECT id, CAST(min(place) AS INT) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY 2 LIMIT 120",
        {"a": _EXPLORE, "b": _EXPLOIT},
    ),
)
def u3(c):
    explore, exploit = _explore_exploit(c)
    merged = explore.unionByName(exploit).groupBy("id").agg(F.min("place").alias("place"))
    return merged.orderBy("place").limit(120)


@query(
    "u4_difference",
    with_views("feedback", "SELECT instance_id AS id FROM feedback WHERE instance_id NOT IN (SELECT id FROM a)", {"a": _EXPLORE}),
)
def u4(c):
    explore, _ = _explore_exploit(c)
    return c.feedback.select(F.col("instance_id").alias("id")).join(explore, "id", "left_anti")


@query(
    "u5_overlap",
    with_views(
        "records",
        """SELECT a.id, list_has_any(a.styles, b.styles) AS shares_style, list_has_any(a.genres, b.genres) AS shares_genre
        FROM records a JOIN records b ON b.id = a.id + 1""",
    ),
)
def u5(c):
    right = c.records.select((F.col("id") - 1).alias("id"), F.col("styles").alias("s2"), F.col("genres").alias("g2"))
    return c.records.join(right, "id").select(
        "id", F.arrays_overlap("styles", "s2").alias("shares_style"), F.arrays_overlap("genres", "g2").alias("shares_genre")
    )


@query(
    "u6_split_by_label",
    with_views("records", "SELECT id, CASE WHEN wanted THEN 'keeper' ELSE 'other' END AS side FROM records WHERE evaluated"),
)
def u6(c):
    labelled = c.records.filter("evaluated")
    keepers = labelled.filter("wanted").select("id", F.lit("keeper").alias("side"))
    return keepers.unionByName(labelled.filter(~F.col("wanted")).select("id", F.lit("other").alias("side")))
