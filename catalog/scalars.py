"""Scalar functions (F1-F32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import hash_sql, mock_sql, query, seeded_int_sql, title_sql, with_views
from waxworks.functions import money, numeric, payload, text, vectors
from waxworks.functions.numeric import GRADE_SHORT, GRADES, VOCABULARY
from waxworks.operators import triplets
from waxworks.operators.bandit import exploration_rate, optimistic, predicted_flag, reward, thompson_sample
from waxworks.operators.features import CONDITION_COLUMNS


@query("f1_normalize_title", f"SELECT doc_id, {title_sql('text')} AS title FROM documents")
def f1(c):
    return c.documents.select("doc_id", text.normalize_title(F.col("text")).alias("title"))


@query("f2_mock_title", with_views("records", f"SELECT id, {mock_sql()} AS title FROM records"))
def f2(c):
    cols = [F.col(x) for x in ("artist", "title", "label", "year")]
    return c.records.select("id", text.mock_title(*cols).alias("title"))


_RAW_PRICES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '$' || p_retailprice WHEN 1 THEN p_retailprice || ', EUR'
 WHEN 2 THEN 'GBP ' || p_retailprice WHEN 3 THEN p_name WHEN 4 THEN '' ELSE '€' || p_size || ',50' END AS raw FROM part"""


def _raw_prices(c):
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("string")
    raw = (
        F.when(key % 6 == 0, F.concat(F.lit("$"), price))
        .when(key % 6 == 1, F.concat(price, F.lit(", EUR")))
        .when(key % 6 == 2, F.concat(F.lit("GBP "), price))
        .when(key % 6 == 3, F.col("p_name"))
        .when(key % 6 == 4, F.lit(""))
        .otherwise(F.concat(F.lit("€"), F.col("p_size").cast("string"), F.lit(",50")))
    )
    return c.table("part").select(key.alias("id"), raw.alias("raw"))


@query(
    "f3_parse_price",
    f"""SELECT id, coalesce(TRY_CAST(trim(split_part(regexp_replace(raw, '[$€£]|USD|EUR|GBP', '', 'g'), ',', 1)) AS DOUBLE), 0.0)
    AS price FROM ({_RAW_PRICES})""",
)
def f3(c):
    return _raw_prices(c).select("id", money.parse_price(F.col("raw")).alias("price"))


@query(
    "f4_split_price",
    with_views(
        "listings",
        """SELECT listing_id, TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) AS price,
        split_part(record_price, ', ', 2) AS currency FROM listings""",
    ),
)
def f4(c):
    raw = F.col("record_price")
    return c.listings.select(
        "listing_id", money.price_amount(raw).alias("price"), money.price_currency(raw).alias("currency")
    )


_GRADE_FACTOR = (
    "CASE media_condition "
    + " ".join(f"WHEN '{g}' THEN {v}::DOUBLE" for g, v in money.GRADE_FACTORS.items())
    + " ELSE 1.0::DOUBLE END"
)
SUGGESTED_SQL = (
    "CASE WHEN suggested_price LIKE '%<Price%' THEN TRY_CAST(regexp_extract(suggested_price, '<Price ([0-9.]+)', 1) AS DOUBLE) "
    "ELSE TRY_CAST(split_part(suggested_price, ', ', 1) AS DOUBLE) END * " + _GRADE_FACTOR
)


@query(
    "f5_suggested_price",
    with_views(
        "records listings",
        f"SELECT listing_id, round({SUGGESTED_SQL}, 6) AS suggested FROM listings JOIN records ON id = record_id",
    ),
)
def f5(c):
    joined = c.listings.join(c.records, F.col("record_id") == F.col("id"))
    price = money.suggested_price(F.col("suggested_price"), F.col("media_condition"))
    return joined.select("listing_id", F.round(price, 6).alias("suggested"))


@query(
    "f6_to_usd",
    """SELECT s_suppkey AS id, round(abs(s_acctbal) / CASE s_nationkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.92::DOUBLE
    ELSE 150.0::DOUBLE END, 6) AS usd FROM supplier""",
)
def f6(c):
    nation = F.col("s_nationkey") % 3
    rate = F.when(nation == 0, 1.0).when(nation == 1, 0.92).otherwise(150.0)
    usd = money.to_usd(F.abs("s_acctbal"), rate)
    return c.table("supplier").select(F.col("s_suppkey").alias("id"), F.round(usd, 6).alias("usd"))


@query(
    "f7_hash_index",
    with_views(
        "records",
        f"SELECT id, {hash_sql('artist', 1000)} AS artist_idx, {hash_sql('label', 500)} AS label_idx, "
        f"{hash_sql('discogs_id', 1000)} AS id_idx FROM records",
    ),
)
def f7(c):
    return c.records.select(
        "id",
        numeric.hash_index(F.col("artist"), VOCABULARY["artist"]).alias("artist_idx"),
        numeric.hash_index(F.col("label"), VOCABULARY["label"]).alias("label_idx"),
        numeric.hash_index(F.col("discogs_id"), VOCABULARY["artist"]).alias("id_idx"),
    )


@query(
    "f8_genre_style_slots",
    with_views(
        "records",
        "SELECT id, "
        + ", ".join(f"{hash_sql(f'genres[{i}]', 100)} AS genre_{i}" for i in (1, 2, 3))
        + ", "
        + ", ".join(f"{hash_sql(f'styles[{i}]', 200)} AS style_{i}" for i in (1, 2, 3))
        + " FROM records",
    ),
)
def f8(c):
    genres = numeric.hash_slots(F.col("genres"), VOCABULARY["genre"])
    styles = numeric.hash_slots(F.col("styles"), VOCABULARY["style"])
    return c.records.select(
        "id",
        *[g.alias(f"genre_{i + 1}") for i, g in enumerate(genres)],
        *[s.alias(f"style_{i + 1}") for i, s in enumerate(styles)],
    )


_ODD_YEAR = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 1890 WHEN id % 17 = 0 THEN 2030 ELSE year END"
YEAR_SQL = (
    "CASE WHEN {y} IS NULL OR {y} <= 1900 OR {y} > 2025 OR hi = lo THEN 0.5::DOUBLE "
    "ELSE (least(greatest({y}, lo), hi) - lo)::DOUBLE / (hi - lo) END"
)


@query(
    "f9_scale_year",
    with_views(
        "records",
        f"SELECT id, round({YEAR_SQL.format(y='y')}, 6) AS year_norm FROM (SELECT id, {_ODD_YEAR} AS y FROM records), "
        "(SELECT min(year) AS lo, max(year) AS hi FROM records)",
    ),
)
def f9(c):
    key = F.col("id")
    odd = F.when(key % 11 == 0, None).when(key % 13 == 0, 1890).when(key % 17 == 0, 2030).otherwise(F.col("year"))
    bounds = c.records.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    scaled = numeric.scale_year(odd, F.col("lo"), F.col("hi"))
    return c.records.crossJoin(bounds).select("id", F.round(scaled, 6).alias("year_norm"))


RATIO_SQL = "CASE WHEN haves > 0 THEN wants::DOUBLE / haves ELSE wants::DOUBLE END"


@query("f10_want_ratio", with_views("records", f"SELECT id, round({RATIO_SQL}, 6) AS ratio FROM records"))
def f10(c):
    ratio = numeric.want_ratio(F.col("wants"), F.col("haves"))
    return c.records.select("id", F.round(ratio, 6).alias("ratio"))


def _grade_sql(column: str, strict: bool = False) -> str:
    bare = f"replace(replace(trim({column}), '(', ''), ')', '')"
    full = f"CASE {bare} " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in GRADE_SHORT.items()) + f" ELSE {bare} END"
    order = sorted(GRADES, key=len, reverse=True) if strict else GRADES
    tests = " ".join(f"WHEN contains(lower({full}), '{g.lower()}') THEN {GRADES.index(g) + 1}" for g in order)
    return f"CASE {tests} ELSE 0 END"


@query(
    "f11_condition_one_hot",
    with_views(
        "listings",
        "SELECT listing_id, strict, "
        + ", ".join(f"CASE WHEN g = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" for i, n in enumerate(CONDITION_COLUMNS))
        + f" FROM (SELECT listing_id, {_grade_sql('media_condition')} AS g, {_grade_sql('media_condition', True)} AS strict FROM listings)",
    ),
)
def f11(c):
    grade = F.col("media_condition")
    placed = c.listings.withColumns(
        {"place": numeric.grade_index(grade), "strict": numeric.grade_index(grade, strict=True)}
    )
    one_hot = numeric.grade_one_hot(F.col("place"))
    return placed.select("listing_id", "strict", *[x.alias(n) for x, n in zip(one_hot, CONDITION_COLUMNS)])


@query(
    "f12_min_max_scale",
    with_views(
        "records",
        """SELECT id, round((wants - lo)::DOUBLE / (hi - lo), 6) AS wants_scaled, 0.0::DOUBLE AS constant_scaled
        FROM records, (SELECT min(wants) AS lo, max(wants) AS hi FROM records)""",
    ),
)
def f12(c):
    bounds = c.records.agg(F.min("wants").alias("lo"), F.max("wants").alias("hi"))
    wants = F.col("wants").cast("double")
    return c.records.crossJoin(bounds).select(
        "id",
        F.round(numeric.min_max(wants, F.col("lo"), F.col("hi")), 6).alias("wants_scaled"),
        numeric.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("constant_scaled"),
    )


DEMAND_SQL = "CASE WHEN haves = 0 THEN 0.0::DOUBLE ELSE wants::DOUBLE / haves * ln(wants + 1) END"


@query("f13_demand", with_views("records", f"SELECT id, round({DEMAND_SQL}, 6) AS demand FROM records"))
def f13(c):
    return c.records.select("id", F.round(numeric.demand(F.col("wants"), F.col("haves")), 6).alias("demand"))


@query(
    "f16_exploration_rate",
    with_views(
        "feedback_batches",
        """SELECT DISTINCT batch_number, round(0.7 * exp(ln(0.3 / 0.7) / 100 * batch_number), 6) AS rate FROM feedback_batches""",
    ),
)
def f16(c):
    batches = c.feedback_batches.groupBy("batch_number").agg(F.count("*").alias("n"))
    return batches.select("batch_number", F.round(exploration_rate(F.col("batch_number")), 6).alias("rate"))


@query(
    "f17_optimistic_score",
    with_views("feedback", "SELECT instance_id, round(predicted_prob + 2.0 * uncertainty, 6) AS score FROM feedback"),
)
def f17(c):
    score = optimistic(F.col("predicted_prob"), F.col("uncertainty"))
    return c.feedback.select("instance_id", F.round(score, 6).alias("score"))


SIMILARITY_SQL = """CASE WHEN list_has_any(a.genres, b.genres) THEN 3 ELSE 0 END + CASE WHEN list_has_any(a.styles, b.styles) THEN 2 ELSE 0 END
 + CASE WHEN a.label IS NOT DISTINCT FROM b.label THEN 2 ELSE 0 END
 + CASE WHEN a.year <> 0 AND b.year <> 0 AND abs(a.year - b.year) <= 5 THEN 1 ELSE 0 END"""


@query(
    "f18_record_similarity",
    with_views(
        "records",
        f"SELECT a.id, b.id AS other_id, {SIMILARITY_SQL} AS score FROM records a JOIN records b ON b.id = a.id + 1",
    ),
)
def f18(c):
    cols = ("genres", "styles", "label", "year")
    left = c.records.select("id", F.struct(*cols).alias("a"))
    right = c.records.select((F.col("id") - 1).alias("id"), F.col("id").alias("other_id"), F.struct(*cols).alias("b"))
    score = triplets.similarity(F.col("a"), F.col("b"))
    return left.join(right, "id").select("id", "other_id", score.alias("score"))


@query("f19_aspect_columns", with_views("metadata", "SELECT * FROM metadata"))
def f19(c):
    found = payload.aspect_columns(F.col("aspects"))
    return c.aspects.select("ebay_id", *[v.alias(k) for k, v in found.items()])


@query(
    "f20_string_list",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name ELSE '' END AS items,
    CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM part""",
)
def f20(c):
    key, name = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit('["'), name, F.lit('","'), F.col("p_type"), F.lit('"]')))
        .when(key % 4 == 1, F.concat(F.lit('"'), name, F.lit('"')))
        .when(key % 4 == 2, name)
        .otherwise("")
    )
    items = payload.string_list(raw)
    return c.table("part").select(key.alias("id"), F.array_join(items, "|").alias("items"), F.size(items).alias("n"))


@query(
    "f21_primitive",
    with_views(
        "records",
        """SELECT id, '[' || array_to_string(list_transform(styles, lambda s: '"' || s || '"'), ',') || ']' AS styles,
        CAST(wants AS VARCHAR) AS wants, CASE WHEN evaluated THEN label END AS label FROM records""",
    ),
)
def f21(c):
    label = F.when(F.col("evaluated"), F.col("label"))
    return c.records.select(
        "id",
        payload.primitive(F.col("styles"), "array").alias("styles"),
        payload.primitive(F.col("wants"), "bigint").alias("wants"),
        payload.primitive(label, "string").alias("label"),
    )


@query(
    "f22_parse_instant",
    with_views("auctions", "SELECT ebay_id, CAST(epoch(TRY_CAST(rtrim(end_date, 'Z') AS TIMESTAMP)) AS BIGINT) AS ends_at FROM auctions"),
)
def f22(c):
    return c.auctions.select("ebay_id", F.unix_timestamp(payload.instant(F.col("end_date"))).alias("ends_at"))


@query("f23_version_stamp", "SELECT DISTINCT strftime(ts, 'v%Y%m%d_%H%M%S') AS version FROM events")
def f23(c):
    return c.table("events").select(payload.version_stamp(F.col("ts").cast("timestamp")).alias("version")).distinct()


_NEXT_VECTORS = """SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a
 JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@query(
    "f25_vector_distances",
    f"""SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm,
    round(list_distance(x, y), 6) AS euclidean, round(list_cosine_distance(x, y), 6) AS cosine FROM ({_NEXT_VECTORS})""",
)
def f25(c):
    left = c.embeddings.select("vec_id", F.col("embedding").alias("x"))
    right = c.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    x, y = F.col("x"), F.col("y")
    return left.join(right, "vec_id").select(
        "vec_id",
        F.round(vectors.norm(x), 6).alias("norm"),
        F.round(vectors.distance("euclidean")(x, y), 6).alias("euclidean"),
        F.round(vectors.distance("cosine")(x, y), 6).alias("cosine"),
    )


def _normal_sql(draw: str, seed) -> str:
    def uniform(tag):
        return f"(({seeded_int_sql('instance_id', draw, tag, seed=seed)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

    return f"sqrt(-2.0 * ln({uniform(chr(39) + 'u' + chr(39))})) * cos(6.283185307179586::DOUBLE * {uniform(chr(39) + 'v' + chr(39))})"


THOMPSON_SQL = with_views(
    "feedback",
    f"""SELECT instance_id, round(avg(least(greatest(predicted_prob + uncertainty * ({_normal_sql('d', 7)}), 0.0), 1.0)), 6) AS sampled
    FROM feedback, range(10) t(d) GROUP BY instance_id""",
)


@query("f26_thompson_sample", THOMPSON_SQL)
def f26(c):
    drawn = thompson_sample(F.col("predicted_prob"), F.col("uncertainty"), F.col("instance_id"), seed=7)
    return c.feedback.select("instance_id", F.round(drawn, 6).alias("sampled"))


@query(
    "f27_head_to_scores",
    with_views(
        "feedback",
        """SELECT instance_id, round(1 / (1 + exp(-(predicted_prob * 8 - 4))), 6) AS mean,
        round(sqrt(exp(least(greatest(uncertainty * 30 - 12, -10.0), 2.0)) + 1e-6), 6) AS uncertainty FROM feedback""",
    ),
)
def f27(c):
    return c.feedback.select(
        "instance_id",
        F.round(numeric.sigmoid(F.col("predicted_prob") * 8 - 4), 6).alias("mean"),
        F.round(F.sqrt(numeric.bounded_variance(F.col("uncertainty") * 30 - 12)), 6).alias("uncertainty"),
    )


@query(
    "f28_predicted_flag",
    with_views(
        "feedback",
        """SELECT instance_id, predicted_prob >= 0.45 AS predicted,
        CASE WHEN (predicted_prob >= 0.45) = actual THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM feedback""",
    ),
)
def f28(c):
    flag = predicted_flag(F.col("predicted_prob"), F.lit(0.45))
    return c.feedback.select("instance_id", flag.alias("predicted"), reward(flag, F.col("actual")).alias("reward"))


@query(
    "f29_integer_units",
    """SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS score_units, CAST(floor(value * 100) AS BIGINT) AS cents FROM events""",
)
def f29(c):
    return c.table("events").select(
        "event_id",
        money.to_units(F.col("value"), 1000).alias("score_units"),
        money.to_units(F.col("value"), 100).alias("cents"),
    )


@query(
    "f30_display_price",
    f"""SELECT id, CASE WHEN TRY_CAST(d AS DOUBLE) IS NULL THEN '—' ELSE printf('$%.2f', TRY_CAST(d AS DOUBLE)) END AS shown
    FROM (SELECT id, regexp_replace(raw, '[^0-9.]', '', 'g') AS d FROM ({_RAW_PRICES}))""",
)
def f30(c):
    return _raw_prices(c).select("id", money.display_price(F.col("raw")).alias("shown"))


@query(
    "f31_nested_or_flat_id",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id END AS item_id FROM events",
)
def f31(c):
    nested = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("user_id").alias("id")))
    return c.table("events").select("event_id", payload.nested_or_flat(nested["id"], F.col("event_id")).alias("item_id"))
