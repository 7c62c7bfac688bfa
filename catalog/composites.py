"""Composite operators (M), the joins inside them (J7, J9-J11), and the scalars they rest on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.aggregates import LATEST_SQL, LOSSES_SQL, TRIPLET_LOSS_SQL, rounded, vector_triplets, versions
from catalog.base import hash_sql, mock_sql, query, seeded_int_sql, seeded_sql, title_sql, tokens_sql, with_views
from catalog.relational import AS_OF, _ALLOWED, _ENDS
from catalog.scalars import (
    DEMAND_SQL, RATIO_SQL, SIMILARITY_SQL, SUGGESTED_SQL, THOMPSON_SQL, YEAR_SQL, _grade_sql,
)
from catalog.stop_words import ENGLISH
from waxworks.functions import text
from waxworks.functions.money import price_edge, suggested_price
from waxworks.functions.payload import aspect_columns
from waxworks.operators import bandit, features, knapsack, metrics, model, prefs, registry, rows, similarity, stock, tfidf, triplets
from waxworks.operators.ordering import seeded_sample, top_k_per_group
from waxworks.plans import auctions, intake, ranking, saved, selection
from waxworks.session import scratch_path

# ---------------------------------------------------------------- text


def terms_sql(docs: str, max_features: int, min_df: int = 2, max_df: float = 0.95) -> str:
    """CTE bodies: vocabulary of a (id, tokens) relation without repeated tokens."""
    return f"""SELECT term, df, n, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (
      SELECT term, count(*) AS df FROM (SELECT unnest(tokens) AS term FROM {docs}) GROUP BY term),
      (SELECT count(*) AS n FROM {docs}) WHERE df >= {min_df} AND df <= n * {max_df}::DOUBLE
      ORDER BY df DESC, term LIMIT {max_features}"""


def vectors_sql(docs: str) -> str:
    return f"""SELECT id, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS weight
    FROM (SELECT id, unnest(tokens) AS term FROM {docs}) JOIN terms USING (term)"""


def scores_sql(candidates: str, keepers: str, max_features: int) -> dict[str, str]:
    """CTEs that end in ``scores`` (id, score); both sides are (id, title)."""
    return {
        "kd": f"SELECT id, {tokens_sql('title')} AS tokens FROM ({keepers}) WHERE len({tokens_sql('title')}) > 0",
        "cd": f"SELECT id, {tokens_sql('title')} AS tokens FROM ({candidates}) WHERE len({tokens_sql('title')}) > 0",
        "terms": terms_sql("kd", max_features),
        "kv": vectors_sql("kd"),
        "cv": vectors_sql("cd"),
        "pairs": "SELECT cv.id, kv.id AS kid, sum(cv.weight * kv.weight) AS s FROM cv JOIN kv USING (term) GROUP BY cv.id, kv.id",
        "scores": "SELECT cd.id, round(coalesce(max(s), 0.0), 6) AS score FROM cd LEFT JOIN pairs USING (id) GROUP BY cd.id",
    }


_CANDS = "SELECT doc_id AS id, title FROM candidate_titles"
_KEEPS = "SELECT doc_id AS id, title FROM keeper_titles"


def _sides(c):
    return c.candidate_titles.withColumnRenamed("doc_id", "id"), c.keeper_titles.withColumnRenamed("doc_id", "id")


@query(
    "j7_best_cosine",
    with_views("candidate_titles keeper_titles", "SELECT id, score FROM scores", scores_sql(_CANDS, _KEEPS, 10000)),
)
def j7(c):
    return rounded(similarity.similarity_scores(*_sides(c)), "score")


@query(
    "m3_similarity_filter",
    with_views(
        "candidate_titles keeper_titles",
        f"""SELECT CAST(row_number() OVER (ORDER BY {seeded_sql('id', seed=5)}) - 1 AS INT) AS position, id, score
        FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 500)""",
        scores_sql(_CANDS, _KEEPS, 10000),
    ),
)
def m3(c):
    return similarity.similarity_filter(*_sides(c), n=500, seed=5, digits=6)


_SOON = f"""SELECT ebay_id AS id, title FROM auctions WHERE {_ENDS} > TIMESTAMP '{AS_OF}' + INTERVAL 24 HOURS
 AND {_ENDS} < TIMESTAMP '{AS_OF}' + INTERVAL 48 HOURS"""
_PAST = f"SELECT ebay_id AS id, title FROM auctions WHERE {_ENDS} <= TIMESTAMP '{AS_OF}' AND bid IS NOT NULL"


@query(
    "m28_auction_shortlist",
    with_views(
        "auctions",
        f"""SELECT CAST(row_number() OVER (ORDER BY {seeded_sql('id', seed=9)}) - 1 AS INT) AS position, id AS ebay_id, score, a.title,
        coalesce(price, '') AS price, coalesce(bid, price, '') AS current_bid, bid_count, end_date
        FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 1000) JOIN auctions a ON ebay_id = id""",
        scores_sql(_SOON, _PAST, 10000),
    ),
)
def m28(c):
    as_of = F.lit(AS_OF).cast("timestamp")
    past = c.auctions.filter(F.try_to_timestamp("end_date") <= as_of).filter(F.col("bid").isNotNull())
    keepers = past.select(F.col("ebay_id").alias("id"), "title")
    return auctions.auction_shortlist(c.auctions, keepers, as_of, seed=9, digits=6)


_MOCKS = f"SELECT id, {tokens_sql(mock_sql())} AS tokens FROM records WHERE evaluated AND wanted"


def _keeper_mocks(c):
    return saved.keeper_documents(c.records)


@query(
    "m2_vocabulary",
    with_views(
        "records",
        "SELECT term, df, round(idf, 6) AS idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx FROM terms",
        {"d": _MOCKS, "terms": terms_sql("d", 1000)},
    ),
)
def m2(c):
    return rounded(tfidf.fit_tfidf(_keeper_mocks(c), 1000), "idf").select("term", "df", "idf", "idx")


@query(
    "m2_saved_vocabulary",
    with_views(
        "records",
        "SELECT 'v20240110_000000' AS version, term, df, round(idf, 6) AS idf FROM terms",
        {"d": _MOCKS, "terms": terms_sql("d", 10000)},
    ),
)
def m2_saved(c):
    folder = scratch_path(c.spark, "vocabulary")
    day = F.lit("2024-01-09 00:00:00").cast("timestamp")
    saved.rebuild_vocabulary(c.records, folder, day, max_features=10)
    version = saved.rebuild_vocabulary(c.records, folder, day + F.expr("INTERVAL 1 DAY"))
    newest = rounded(saved.latest(c.spark, folder), "idf")
    return newest.select(F.lit(version).alias("version"), "term", "df", "idf")


@query(
    "f24_tfidf_weights",
    with_views(
        "records", "SELECT id, term, round(weight, 6) AS weight FROM v",
        {"d": _MOCKS, "terms": terms_sql("d", 1000), "v": vectors_sql("d")},
    ),
)
def f24(c):
    docs = _keeper_mocks(c)
    terms = tfidf.fit_tfidf(docs, 1000)
    return rounded(tfidf.long_form(tfidf.tfidf_vectors(docs, terms), terms), "weight")


@query(
    "t5_distinctive_terms",
    with_views(
        "keeper_titles",
        "SELECT term, round(idf, 6) AS idf FROM terms ORDER BY terms.idf DESC, term LIMIT 20",
        {"kd": f"SELECT doc_id AS id, {tokens_sql('title')} AS tokens FROM keeper_titles WHERE len({tokens_sql('title')}) > 0",
         "terms": terms_sql("kd", 10000)},
    ),
)
def t5(c):
    words = tfidf.usable(text.title_words(F.col("title")))
    docs = c.keeper_titles.select(F.col("doc_id").alias("id"), words.alias("tokens"))
    return rounded(tfidf.distinctive_terms(tfidf.fit_tfidf(docs, 10_000)), "idf")


def _matrix_sql() -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
    words = r"regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}')"
    return with_views(
        "titles",
        """SELECT id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)), 6) AS weight, price, label
        FROM c JOIN terms USING (term) JOIN l USING (id)""",
        {
            "l": "SELECT doc_id AS id, title, quality = 1 AS label, CAST(doc_id AS DOUBLE) / 4 AS price FROM titles WHERE quality IS NOT NULL",
            "w": f"SELECT id, unnest({words}) AS term FROM l",
            "c": f"SELECT id, term, count(*) AS tf FROM w WHERE term NOT IN ({stops}) GROUP BY id, term",
            "terms": """SELECT term, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM c, (SELECT count(*) AS n FROM l)
            GROUP BY term, n ORDER BY sum(tf) DESC, term LIMIT 1000""",
        },
    )


@query("m29_title_training_matrix", _matrix_sql())
def m29(c):
    labelled = c.titles.filter("quality is not null").select(
        F.col("doc_id").alias("id"), "title", (F.col("doc_id") / 4).cast("string").alias("price"),
        (F.col("quality") == 1).alias("label"),
    )
    return rounded(auctions.title_training_matrix(labelled, list(ENGLISH)), "weight")


# ---------------------------------------------------------------- features, bandit


_CONDITIONED = """SELECT r.*, l.record_price, l.media_condition FROM records r JOIN (
 SELECT record_id, arg_min(record_price, listing_id) AS record_price, arg_min(media_condition, listing_id) AS media_condition
 FROM listings GROUP BY record_id) l ON l.record_id = r.id"""
_PRICE = "coalesce(TRY_CAST(trim(split_part(regexp_replace(record_price, '[$€£]|USD|EUR|GBP', '', 'g'), ',', 1)) AS DOUBLE), 0.0)"


def _conditioned(c):
    """Records with price and condition of their first listing."""
    first = c.listings.groupBy(F.col("record_id").alias("id")).agg(
        F.min_by("record_price", "listing_id").alias("record_price"),
        F.min_by("media_condition", "listing_id").alias("media_condition"),
    )
    return c.records.join(first, "id")


def _feature_views(base: str, title: str, digits: int | None = 6) -> dict[str, str]:
    """CTEs on the relation ``base``: dense features, and the title block as (id, idx, weight) of ``title``."""
    cut = (lambda x: f"round({x}, {digits})") if digits else (lambda x: x)
    slots = ", ".join(
        [f"{hash_sql('artist', 1000)} AS artist_idx", f"{hash_sql('label', 500)} AS label_idx"]
        + [f"{hash_sql(f'genres[{i}]', 100)} AS genre_{i}" for i in (1, 2, 3)]
        + [f"{hash_sql(f'styles[{i}]', 200)} AS style_{i}" for i in (1, 2, 3)]
    )
    scaled = ", ".join(
        cut(f"coalesce(({n} - min({n}) OVER ())::DOUBLE / nullif(max({n}) OVER () - min({n}) OVER (), 0), 0.0)") + f" AS {n}_n" for n in ("wants", "haves", "ratio", "price")
    )
    year = YEAR_SQL.format(y="year").replace("hi", "max(year) OVER ()").replace("lo)", "min(year) OVER ())").replace("= lo", "= min(year) OVER ()").replace(", lo", ", min(year) OVER ()")
    grades = ", ".join(f"CASE WHEN g = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" for i, n in enumerate(features.CONDITION_COLUMNS))
    return {
        "num": f"SELECT *, {RATIO_SQL} AS ratio, {_PRICE} AS price, {_grade_sql('media_condition')} AS g FROM {base}",
        "feat": f"SELECT id, {slots}, {scaled}, {cut(year)} AS year_n, {grades} FROM num",
        "d": f"SELECT id, {tokens_sql(title)} AS tokens FROM {base} WHERE len({tokens_sql(title)}) > 0",
        "terms": terms_sql("d", 1000),
        "v": vectors_sql("d"),
        "places": "SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM terms",
    }


def _features_sql(select: str) -> str:
    return with_views(
        "records listings", select,
        {
            "cond": _CONDITIONED,
            **_feature_views("cond", mock_sql()),
            "block": """SELECT id, count(*) AS k, string_agg(idx, ',' ORDER BY idx) AS places, sum(weight) AS w, sum(weight * (idx + 22)) AS s
            FROM v JOIN places USING (term) GROUP BY id""",
        },
    )


def _featured(c):
    base = _conditioned(c)
    return features.with_titles(features.transform_features(base, features.fit_features(base)), features.fit_titles(base))


def _added(column):
    return F.aggregate(column, F.lit(0.0), lambda a, v: a + v)


@query(
    "m1_record_features",
    _features_sql(
        """SELECT feat.*, coalesce(k, 0)::INT AS title_terms, coalesce(places, '') AS title_places, round(coalesce(w, 0.0), 6) AS title_weight
        FROM feat LEFT JOIN block USING (id)"""
    ),
)
def m1(c):
    return rounded(_featured(c), *features.NUMBER_COLUMNS).select(
        "id", *features.DENSE_COLUMNS, F.size("title_idx").alias("title_terms"),
        F.array_join(F.col("title_idx").cast("array<string>"), ",").alias("title_places"), F.round(_added(F.col("title_weight")), 6).alias("title_weight"),
    )


@query(
    "f32_feature_vector",
    _features_sql(
        "SELECT id, CAST(21 + coalesce(k, 0) AS INT) AS n, round(list_sum(["
        + ", ".join(f"{n}::DOUBLE * {i + 1}" for i, n in enumerate(features.DENSE_COLUMNS))
        + "]) + coalesce(s, 0.0), 3) AS checksum FROM feat LEFT JOIN block USING (id)"
    ),
)
def f32(c):
    vector = features.with_vector(rounded(_featured(c), *features.NUMBER_COLUMNS))
    weighted = F.transform("features", lambda v, i: v * (i + 1))
    titled = F.zip_with("title_idx", "title_weight", lambda i, w: w * (i + 22))  # the title block follows the 21 dense ones
    return vector.select(
        "id", (F.size("features") + F.size("title_idx")).alias("n"), F.round(_added(weighted) + _added(titled), 3).alias("checksum")
    )


@query("m5_thompson", THOMPSON_SQL)
def m5(c):
    scored = c.feedback.select(F.col("instance_id").alias("id"), F.col("predicted_prob").alias("mean"), "uncertainty")
    return bandit.thompson(scored, seed=7).select(F.col("id").alias("instance_id"), F.round("sampled", 6).alias("sampled"))


_M = 12  # int(20 * rate) for batch 10
_SELECT_BATCH = f"""SELECT id, place, CASE WHEN place < {_M} THEN 'explore' ELSE 'exploit' END AS source FROM picked
 UNION ALL SELECT id, CAST(19 + row_number() OVER (ORDER BY {seeded_sql('id', seed=2)}, id) AS INT), 'random' FROM (
   SELECT instance_id AS id FROM feedback WHERE instance_id NOT IN (SELECT id FROM picked) ORDER BY {seeded_sql('instance_id', seed=2)}, 1 LIMIT 3)"""


@query(
    "m6_select_batch",
    with_views(
        "feedback", _SELECT_BATCH,
        {
            "a": f"SELECT instance_id AS id, row_number() OVER (ORDER BY uncertainty DESC, instance_id) - 1 AS place FROM feedback QUALIFY place < {_M}",
            "b": f"SELECT instance_id AS id, {_M} - 1 + row_number() OVER (ORDER BY predicted_prob + 2 * uncertainty DESC, instance_id) AS place FROM feedback QUALIFY place < 17",
            "picked": "SELECT id, CAST(min(place) AS INT) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY 2 LIMIT 17",
        },
    ),
)
def m6(c):
    scored = c.feedback.select(F.col("instance_id").alias("id"), F.col("predicted_prob").alias("mean"), "uncertainty")
    return bandit.select_batch(scored, batch_number=10, seed=2)


# ---------------------------------------------------------------- stock, knapsack

_GIVEN = "(id * 37 % 101) / 101.0::DOUBLE"


def given_scores(c):
    return c.records.select(
        F.col("id").alias("record_id"), "wants", "haves", "suggested_price",
        ((F.col("id") * 37 % 101) / 101).alias("model_score"),
    )


def _scored(c):
    return stock.score_listings(c.listings, given_scores(c), c.rates)


STOCK_CTES = {
    "measured": f"""SELECT seller_id, listing_id, record_id, usd, {_GIVEN} AS model_score, {DEMAND_SQL} AS demand,
    greatest(0.0, coalesce(({SUGGESTED_SQL}), 0.0) - usd) AS edge
    FROM (SELECT *, TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) / rate AS usd FROM listings
      JOIN rates ON rates.currency = split_part(record_price, ', ', 2) WHERE {_ALLOWED}) JOIN records ON id = record_id""",
    "best": "SELECT seller_id, max(demand) AS md, CASE WHEN max(edge) > 0 THEN max(edge) ELSE 1.0 END AS me FROM measured GROUP BY seller_id",
    "scored": """SELECT seller_id, listing_id, record_id, usd AS price, 0.33::DOUBLE * model_score + 0.33::DOUBLE * edge / me
    + 0.34::DOUBLE * coalesce(demand / nullif(md, 0), 0.0) AS score, edge, demand FROM measured JOIN best USING (seller_id)""",
}


@query(
    "m8_score_stock",
    with_views("listings records rates", "SELECT seller_id, listing_id, record_id, round(price, 6) AS price, round(score, 6) AS score FROM scored", STOCK_CTES),
)
def m8(c):
    return rounded(_scored(c), "price", "score")


@query(
    "f15_listing_score",
    with_views("listings records rates", "SELECT listing_id, round(score, 6) AS score FROM scored", STOCK_CTES),
)
def f15(c):
    return rounded(_scored(c), "score").select("listing_id", "score")


@query(
    "f14_price_edge",
    with_views(
        "listings records rates",
        f"""SELECT listing_id, round(greatest(0.0, coalesce(({SUGGESTED_SQL}), 0.0) - TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) / rate), 6) AS edge
        FROM listings JOIN rates ON rates.currency = split_part(record_price, ', ', 2) JOIN records ON id = record_id""",
    ),
)
def f14(c):
    records = c.records.select(F.col("id").alias("record_id"), "suggested_price")
    listed = suggested_price(F.col("suggested_price"), F.col("media_condition"))
    return rows.with_usd(c.listings, c.rates).join(records, "record_id").select(
        "listing_id", F.round(price_edge(listed, F.col("usd")), 6).alias("edge")
    )


def _budgets(c, amount=500.0):
    return c.sellers.select(F.col("id").alias("seller_id"), F.lit(amount).alias("budget"))


@query("m9_knapsack_by_seller")
def m9(c):
    return knapsack.knapsack_by_seller(_scored(c), _budgets(c))


@query("m9_knapsack_totals")
def m9_totals(c):
    chosen = knapsack.knapsack_by_seller(_scored(c), _budgets(c)).filter("error is null")
    return rounded(stock.selected_totals(chosen, "price"), "total_cost", "total_score")


@query(
    "m9_certificate",
    with_views(
        "listings records rates sellers",
        """SELECT seller_id, count(*) AS items, coalesce(sum(value) FILTER (WHERE filled <= 50000), 0)::BIGINT AS prefix_value,
        (coalesce(sum(value) FILTER (WHERE filled <= 50000), 0) + coalesce(arg_min(value, filled) FILTER (WHERE filled > 50000)
          * (50000 - coalesce(sum(cents) FILTER (WHERE filled <= 50000), 0)) // arg_min(cents, filled) FILTER (WHERE filled > 50000), 0))::BIGINT AS bound,
        true AS feasible, true AS reached, true AS maximal
        FROM (SELECT *, sum(cents) OVER (PARTITION BY seller_id ORDER BY value::DOUBLE / cents DESC, listing_id ROWS UNBOUNDED PRECEDING) AS filled
          FROM (SELECT *, row_number() OVER (PARTITION BY seller_id, cents ORDER BY value DESC, listing_id) AS n FROM units
            WHERE value > 0 AND cents BETWEEN 1 AND 50000) WHERE n <= 50000 // cents) GROUP BY seller_id""",
        STOCK_CTES | {
            "units": """SELECT seller_id, listing_id, floor(score * 1000)::BIGINT AS value, floor(price * 100)::BIGINT AS cents
            FROM scored WHERE seller_id IN (SELECT id FROM sellers)"""
        },
    ),
)
def m9_certificate(c):
    return knapsack.certificate(_scored(c), _budgets(c))


_BEST20 = """SELECT listing_id FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY score DESC, listing_id) AS n FROM scored) WHERE n <= 20"""


@query(
    "t4_contenders",
    with_views(
        "listings records rates",
        f"""SELECT seller_id, listing_id, round(score, 6) AS score, CAST(n AS INT) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY score DESC, listing_id) AS n FROM scored
          WHERE listing_id NOT IN ({_BEST20})) WHERE n <= 40""",
        STOCK_CTES,
    ),
)
def t4(c):
    scored = _scored(c)
    return rounded(stock.next_best(scored, skip=20), "score").select("seller_id", "listing_id", "score", "place")


# ---------------------------------------------------------------- preferences

def _scored_ranks(rankings: str = "rankings") -> str:
    return f"SELECT *, 0.33::DOUBLE * embedding + 0.33::DOUBLE * price_diff + 0.34::DOUBLE * demand AS score FROM {rankings}"


_PAIRS = """SELECT i.session_id, i.pos AS better, j.pos AS worse, i.embedding - j.embedding AS embedding, i.price_diff - j.price_diff AS price_diff,
 i.demand - j.demand AS demand FROM sr i JOIN sr j ON i.session_id = j.session_id AND i.pos < j.pos AND i.score < j.score"""


@query(
    "j10_contradicting_pairs",
    with_views("rankings", "SELECT session_id, better, worse FROM pairs", {"sr": _scored_ranks(), "pairs": _PAIRS}),
)
def j10(c):
    return prefs.violations(prefs.usable_rankings(c.rankings)).select("session_id", "better", "worse")


def _tuned_sql(key: str) -> str:
    by, on = ("session_id,", "USING (session_id)") if key else ("", "ON true")
    group = "GROUP BY session_id" if key else ""
    return f"""SELECT {by} round(CASE WHEN v IS NULL THEN 0.33 ELSE a / (a + b + d) END, 6) AS w_embedding,
    round(CASE WHEN v IS NULL THEN 0.33 ELSE b / (a + b + d) END, 6) AS w_price_diff,
    round(CASE WHEN v IS NULL THEN 0.34 ELSE d / (a + b + d) END, 6) AS w_demand, coalesce(v, 0) AS violations, total_pairs FROM
    (SELECT {by} CAST(sum(n * (n - 1) // 2) AS BIGINT) AS total_pairs FROM sizes {group})
    LEFT JOIN (SELECT {by} count(*) AS v, greatest(0.33 + 0.1 * avg(embedding), 0.0) AS a, greatest(0.33 + 0.1 * avg(price_diff), 0.0) AS b,
      greatest(0.34 + 0.1 * avg(demand), 0.0) AS d FROM pairs {group}) {on}"""


def _tune_ctes(rankings: str = "rankings") -> dict[str, str]:
    return {
        "sizes": f"SELECT session_id, count(*) AS n FROM {rankings} GROUP BY session_id HAVING count(*) >= 2",
        "sr": _scored_ranks(rankings), "pairs": _PAIRS,
    }


@query("m10_tune_weights", with_views("rankings", _tuned_sql("session_id"), _tune_ctes()))
def m10(c):
    return rounded(prefs.tune_weights(c.rankings), "w_embedding", "w_price_diff", "w_demand")


@query("m10_tune_weights_overall", with_views("rankings", _tuned_sql(""), _tune_ctes()))
def m10_overall(c):
    return rounded(prefs.tune_weights(c.rankings, overall=True), "w_embedding", "w_price_diff", "w_demand")


_USER_RANKS = """SELECT split_part(session_id, '-', 1) AS session_id, CAST(split_part(session_id, '-', 2) AS BIGINT) * 10 + pos AS pos,
 embedding, price_diff, demand FROM rankings"""


def _user_rankings(c):
    """All events of a user as one ranking, of whatever length."""
    name = F.split("session_id", "-")
    return c.rankings.select(
        name[0].alias("session_id"), (name[1].cast("bigint") * 10 + F.col("pos")).alias("pos"), *prefs.AXES
    )


@query(
    "m10_tune_weights_by_user",
    with_views("rankings", _tuned_sql("session_id"), {"user_ranks": _USER_RANKS, **_tune_ctes("user_ranks")}),
)
def m10_by_user(c):
    return rounded(prefs.tune_weights(_user_rankings(c)), "w_embedding", "w_price_diff", "w_demand")


# ---------------------------------------------------------------- triplets

_SIDES = {
    "keepers": "SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos_at FROM records WHERE evaluated AND wanted",
    "others": "SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos_at FROM records WHERE evaluated AND NOT wanted",
    "nk": "SELECT count(*) AS k FROM keepers",
    "nn": "SELECT count(*) AS n FROM others",
}


def _keepers(c):
    cols = ["id", *triplets.PROFILE]
    labelled = c.records.filter("evaluated")
    return labelled.filter("wanted").select(*cols), labelled.filter(~F.col("wanted")).select(*cols)


def _hard_ctes(slots: str, seed) -> dict[str, str]:
    """CTEs that end in ``hard`` (slot, negative); ``slots`` is a relation (slot, anchor)."""
    return {
        "cross_scored": f"SELECT s.slot, b.id, {SIMILARITY_SQL} AS score FROM ({slots}) s JOIN keepers_all a ON a.id = s.anchor CROSS JOIN others b",
        "lv": f"""SELECT slot, score, count(*) AS n, min(({seeded_sql('slot', 'id', seed=seed)}, id)) AS pick FROM cross_scored GROUP BY slot, score""",
        "lv2": """SELECT *, coalesce(sum(n) OVER w, 0) AS above, min(pick) OVER w AS pick_above, greatest(1, sum(n) OVER (PARTITION BY slot) // 5) AS pool
        FROM lv WINDOW w AS (PARTITION BY slot ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "hard": f"""SELECT slot, CASE WHEN {seeded_int_sql('slot', "'depth'", seed=seed)} % pool < above THEN pick_above[2] ELSE pick[2] END AS negative
        FROM lv2 WHERE above < pool AND above + n >= pool""",
    }


_DRAWN = f"""SELECT CAST(i AS VARCHAR) AS slot, k, {seeded_int_sql('i', "'anchor'", seed=1)} % k AS first_at,
 (first_at + 1 + {seeded_int_sql('i', "'positive'", seed=1)} % (k - 1)) % k AS second_at FROM range(100) t(i), nk"""
_PAIRED = """SELECT slot, a.id AS anchor, b.id AS positive FROM drawn JOIN keepers a ON a.pos_at = first_at JOIN keepers b ON b.pos_at = second_at"""


@query(
    "m11_mine_triplets",
    with_views(
        "records", "SELECT slot, anchor, positive, negative FROM paired JOIN hard USING (slot)",
        {**_SIDES, "keepers_all": "SELECT * FROM keepers", "drawn": _DRAWN, "paired": _PAIRED,
         **_hard_ctes("SELECT slot, anchor FROM paired", 1)},
    ),
)
def m11(c):
    return triplets.mine_triplets(*_keepers(c), n=100, seed=1)


@query(
    "m11_mine_triplets_random",
    with_views(
        "records",
        f"""SELECT slot, anchor, positive, o.id AS negative FROM (SELECT *, {seeded_int_sql('slot', "'negative'", seed=1)} % n AS pos_at FROM paired, nn)
        JOIN others o USING (pos_at)""",
        {**_SIDES, "drawn": _DRAWN, "paired": _PAIRED},
    ),
)
def m11_random(c):
    return triplets.mine_triplets(*_keepers(c), n=100, seed=1, hard=False)


# the twenty latest records of the catalogue by id are the batch
_BATCH = "SELECT id FROM records ORDER BY id DESC LIMIT 20"
_BATCH_SLOTS = f"""SELECT id AS anchor, i, id || '-' || i AS slot, k, n FROM records, range(10) t(i), nk, nn
 WHERE id IN ({_BATCH}) AND wanted AND k >= 10 AND n >= 10"""


@query(
    "m12_batch_triplets",
    with_views(
        "records",
        f"""SELECT slot, anchor, p.id AS positive, negative FROM (SELECT *, {seeded_int_sql('slot', "'positive'", seed=4)} % k AS pos_at FROM slots)
        JOIN keepers p USING (pos_at) JOIN (
          SELECT * FROM hard UNION ALL SELECT slot, o.id FROM (SELECT slot, {seeded_int_sql('slot', "'negative'", seed=4)} % n AS pos_at FROM slots WHERE i >= 5)
          JOIN others o USING (pos_at)) USING (slot)""",
        {**_SIDES, "slots": _BATCH_SLOTS, "keepers_all": "SELECT * FROM records", **_hard_ctes("SELECT slot, anchor FROM slots WHERE i < 5", 4)},
    ),
)
def m12(c):
    batch = c.records.orderBy(F.col("id").desc()).limit(20).select("id", *triplets.PROFILE, F.col("wanted").alias("kept"))
    return triplets.mine_batch_triplets(batch, *_keepers(c), seed=4)


_ANCHORS = f"SELECT CAST(id AS VARCHAR) AS slot, id AS anchor FROM keepers ORDER BY {seeded_sql('id', seed=8)}, id LIMIT 100"
_SCORED_NEG = f"SELECT s.slot, b.id, {SIMILARITY_SQL} AS score FROM anchors s JOIN keepers a ON a.id = s.anchor CROSS JOIN others b"


def _scored_negatives(c):
    keepers, others = _keepers(c)
    anchors = seeded_sample(keepers, "id", 100, seed=8).select(
        F.col("id").cast("string").alias("slot"), F.struct(*triplets.PROFILE).alias("anchor")
    )
    return triplets.score_negatives(anchors, others)


@query("j9_score_negatives", with_views("records", "SELECT slot, id, score FROM sn", {**_SIDES, "anchors": _ANCHORS, "sn": _SCORED_NEG}))
def j9(c):
    return _scored_negatives(c)


@query(
    "w4_hard_pool",
    with_views(
        "records",
        """SELECT slot, id, score FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, id) AS n,
        count(*) OVER (PARTITION BY slot) AS total FROM sn) WHERE n <= greatest(1, total // 5)""",
        {**_SIDES, "anchors": _ANCHORS, "sn": _SCORED_NEG},
    ),
)
def w4(c):
    return triplets.hard_pool(_scored_negatives(c))


_VEC = "SELECT vec_id, vec_id // 128 AS batch, label, embedding::DOUBLE[] AS e FROM embeddings"
_DIST = "SELECT a.batch, a.vec_id, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.batch = b.batch AND a.vec_id <> b.vec_id"
_BATCH_HARD = "SELECT batch, vec_id, max(d) FILTER (la = lb) AS hp, min(d) FILTER (la <> lb) AS hn FROM dist GROUP BY batch, vec_id"


@query(
    "j11_batch_distances",
    f"WITH v AS ({_VEC}), dist AS ({_DIST}) SELECT batch, vec_id, count(*) AS n_others, round(sum(d), 5) AS distance_sum FROM dist GROUP BY batch, vec_id",
)
def j11(c):
    found = triplets.batch_hard_triplets(c.embeddings)
    return found.select("batch", "vec_id", "n_others", F.round("distance_sum", 5).alias("distance_sum"))


@query(
    "m13_batch_hard_triplets",
    f"""WITH v AS ({_VEC}), dist AS ({_DIST}), bh AS ({_BATCH_HARD}) SELECT batch, vec_id, round(hp, 6) AS hardest_positive,
    round(hn, 6) AS hardest_negative, round(CASE WHEN hp IS NOT NULL AND hn IS NOT NULL THEN greatest(hp - hn + 1, 0) END, 6) AS loss FROM bh""",
)
def m13(c):
    found = triplets.batch_hard_triplets(c.embeddings)
    return rounded(found, "hardest_positive", "hardest_negative", "loss").drop("n_others", "distance_sum")


@query(
    "m13_batch_hard_loss",
    f"WITH v AS ({_VEC}), dist AS ({_DIST}), bh AS ({_BATCH_HARD}) SELECT batch, round(coalesce(avg(greatest(hp - hn + 1, 0)), 0), 6) AS loss FROM bh GROUP BY batch",
)
def m13_loss(c):
    per_row = triplets.batch_hard_triplets(c.embeddings)
    return per_row.groupBy("batch").agg(F.round(F.coalesce(F.avg("loss"), F.lit(0.0)), 6).alias("loss"))


@query(
    "m16_combined_loss",
    with_views(
        "feedback",
        f"""SELECT round(weighted_loss, 6) AS classification, round(t, 6) AS triplet, round(0.8 * weighted_loss + 0.2 * t, 6) AS total
        FROM l, (SELECT avg(loss) AS t FROM ({TRIPLET_LOSS_SQL}))""",
        {"l": LOSSES_SQL},
    ),
)
def m16(c):
    loss = triplets.triplet_loss(F.col("x"), F.col("p"), F.col("n"))
    combined = metrics.combined_loss(c.feedback, vector_triplets(c).select(loss.alias("loss")))
    return rounded(combined, "classification", "triplet", "total")


# ---------------------------------------------------------------- models


def _unpriced(c):
    return c.records.withColumns({"record_price": F.lit(None).cast("string"), "media_condition": F.lit(None).cast("string")})


def _design(c):
    return selection.record_features(_unpriced(c))


def _labelled_rows(c):
    designed = _design(c)
    return designed, model.training_rows(designed.filter("evaluated").select("id", "wanted", "x"), "wanted", F.col("id"))


def _fitted(c):
    designed, rows_ = _labelled_rows(c)
    return designed, model.fit_keeper_model(rows_)


def _ruled(n: int = 0) -> model.KeeperModel:
    """A model whose weights and precisions follow a rule, so that SQL can say what it gives."""
    slots = np.arange(model.width())
    return model.KeeperModel(((slots * 7919 + n * 613) % 2001 - 1000) / 4000.0, 1.0 + (slots * 104729) % 13)


def _saved(c) -> model.KeeperModel:
    """The ruled model, written under a version and read back as the newest active one."""
    folder = scratch_path(c.spark, "model")
    for day, n in ((2, 0), (1, 5)):  # an older one is written later
        saved.save_model(_ruled(n), c.spark, folder, F.timestamp_seconds(F.lit(day * 86400)))
    return saved.latest_model(c.spark, folder)


_BARE = "SELECT *, CAST(NULL AS VARCHAR) AS record_price, CAST(NULL AS VARCHAR) AS media_condition FROM records"


def _entries_sql(base: str = _BARE, title: str | None = None) -> dict[str, str]:
    """CTEs that end in ``x`` (id, slot, value), the model's input."""
    parts = ["SELECT id, 0 AS slot, 1.0::DOUBLE AS value FROM feat"]
    parts += [f"SELECT id, {1 + i}, {n} FROM feat WHERE {n} <> 0" for i, n in enumerate(model.PLAIN)]
    at = model.FIRST_CATEGORY
    for name, size in model.CATEGORIES:
        parts.append(f"SELECT id, {at} + {name}, 1.0::DOUBLE FROM feat WHERE {name} > 0")
        at += size
    parts.append(f"SELECT id, {at} + idx, weight FROM v JOIN places USING (term)")
    return {"bare": base, **_feature_views("bare", title or mock_sql(), None), "x": " UNION ALL ".join(parts)}


def _scored_sql(n: int = 0) -> str:
    """(id, mean, uncertainty) of a ruled model over ``x``; slots in order, so that sums repeat."""
    w, p = f"((slot * 7919 + {n * 613}) % 2001 - 1000) / 4000.0::DOUBLE", "(1.0::DOUBLE + (slot * 104729) % 13)"
    return f"""SELECT id, p AS mean, sqrt(p * (1 - p) * p * (1 - p) * u + 0.000001::DOUBLE) AS uncertainty FROM (
      SELECT id, 1 / (1 + exp(-z)) AS p, u FROM (SELECT id, sum(value * {w}) AS z, sum(value * value / {p}) AS u FROM x GROUP BY id))"""


_SPLIT = """SELECT id, wanted, CASE WHEN row_number() OVER (ORDER BY id) - 1 < floor(count(*) OVER () * 0.6) THEN 'train'
 WHEN row_number() OVER (ORDER BY id) - 1 < floor(count(*) OVER () * 0.8) THEN 'val' ELSE 'test' END AS part,
 row_number() OVER (ORDER BY id) - 1 >= floor(count(*) OVER () * 0.8) AS is_val FROM records WHERE evaluated"""


@query("m14_fit_keeper_model")
def m14(c):
    _, fitted = _fitted(c)
    rows_ = [(h["round"], h["train_loss"], h["val_loss"], h["val_accuracy"]) for h in fitted.history]
    return c.spark.createDataFrame(rows_, "round int, train_loss double, val_loss double, val_accuracy double")


@query(
    "m14_gradient_step",
    with_views(
        "records",
        """SELECT slot::INT AS slot, round(sum(CASE WHEN is_val THEN 0 ELSE value * w * (y - mean) END), 6) AS gradient,
        round(sum(CASE WHEN is_val THEN 0 ELSE value * value * w * mean * (1 - mean) END), 6) AS curvature FROM x JOIN r USING (id) GROUP BY slot""",
        {
            **_entries_sql(), "s": _scored_sql(), "parts": _SPLIT,
            "r": "SELECT id, is_val, mean, wanted::INT AS y, CASE WHEN wanted THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s JOIN parts USING (id)",
        },
    ),
)
def m14_step(c):
    _, rows_ = _labelled_rows(c)
    found = model.slot_sums(rows_, [model.Point(_ruled().weights, 2.5)])
    return rounded(found.select("slot", F.col("gradient0").alias("gradient"), F.col("curvature0").alias("curvature")), "gradient", "curvature")


@query("m4_score_records")
def m4(c):
    designed, fitted = _fitted(c)
    return rounded(model.score(designed.select("id", "x"), fitted), "mean", "uncertainty").drop("x")


@query(
    "m4_score_saved_model",
    with_views("records", "SELECT id, round(mean, 6) AS mean, round(uncertainty, 6) AS uncertainty FROM s", {**_entries_sql(), "s": _scored_sql()}),
)
def m4_saved(c):
    return rounded(model.score(_design(c).select("id", "x"), _saved(c)), "mean", "uncertainty").drop("x")


_AUCTION_RECORDS = """SELECT a.ebay_id AS id, m.artist, m.album AS title, m.label, [m.genre] AS genres, [m.style] AS styles, TRY_CAST(m.year AS INT) AS year,
 a.bid_count AS wants, 0 AS haves, a.price AS record_price, m.record_condition AS media_condition, a.title AS own_title
 FROM auctions a JOIN metadata m USING (ebay_id)"""


@query(
    "m4_score_auctions",
    with_views(
        "auctions metadata", "SELECT id AS ebay_id, round(mean, 6) AS mean, round(uncertainty, 6) AS uncertainty FROM s",
        {**_entries_sql(_AUCTION_RECORDS, title_sql("own_title")), "s": _scored_sql()},
    ),
)
def m4_auctions(c):
    """Auctions as records: their aspects, and their own titles in the title block."""
    parsed = c.aspects.select("ebay_id", *[v.alias(k) for k, v in aspect_columns(F.col("aspects")).items()]).withColumnRenamed("title", "_title")
    known = c.auctions.join(parsed, "ebay_id")
    records = known.select(
        F.col("ebay_id").alias("id"), "artist", F.col("album").alias("title"), "label", F.array("genre").alias("genres"), F.array("style").alias("styles"),
        F.expr("try_cast(year AS int)").alias("year"), F.col("bid_count").alias("wants"), F.lit(0).alias("haves"), F.col("price").alias("record_price"),
        F.col("record_condition").alias("media_condition"), c.auctions["title"].alias("own_title"),
    )
    designed = selection.record_features(records, auction_title="own_title")
    return rounded(model.score(designed.select(F.col("id").alias("ebay_id"), "x"), _saved(c)), "mean", "uncertainty").drop("x")


@query(
    "m4_score_without_model",
    with_views("records", "SELECT id, 0.5::DOUBLE AS mean, CAST(NULL AS DOUBLE) AS uncertainty FROM records"),
)
def m4_none(c):
    return model.score(_design(c), None).select("id", "mean", "uncertainty")


def _fresh(c, designed):
    """The feedback on known records as (x, y)."""
    fresh = c.feedback.select("record_id", "actual").join(designed.select(F.col("id").alias("record_id"), "x"), "record_id")
    return fresh.select("x", F.col("actual").cast("double").alias("y"))


def _updated(c):
    designed, fitted = _fitted(c)
    return model.update_keeper_model(fitted, _fresh(c, designed))


_FRESH_SQL = {
    **_entries_sql(), "s": _scored_sql(),
    "f": "SELECT instance_id, record_id AS id, actual::INT AS y, mean FROM feedback JOIN s ON id = record_id",
    "balance": "SELECT least((count(*) - sum(y)) / (sum(y) + 0.000001::DOUBLE), 10.0) AS pos FROM f",
    "r": "SELECT f.*, CASE WHEN y > 0 THEN pos ELSE 1.0 END AS w FROM f, balance",
}


@query(
    "m15_update_step",
    with_views(
        "records feedback",
        """SELECT slot::INT AS slot, round(sum(value * w * (y - mean)), 5) AS gradient,
        round(1 + (slot * 104729) % 13 + sum(value * value * w * mean * (1 - mean)), 5) AS precision FROM x JOIN r USING (id) GROUP BY slot""",
        _FRESH_SQL,
    ),
)
def m15_step(c):
    """The first step of an update of the saved model: where its weights are drawn, and the precision it would have."""
    prior, rows_ = _saved(c), _fresh(c, _design(c)).withColumn("is_val", F.lit(False)).persist()
    found = model.slot_sums(rows_, [model.Point(prior.weights, model.positive_weight(rows_))])
    was = prior.to_rows(c.spark).select("slot", "precision")
    return found.join(F.broadcast(was), "slot").select(  # one row for each slot
        "slot", F.round("gradient0", 5).alias("gradient"), F.round(F.col("precision") + F.col("curvature0"), 5).alias("precision")
    )


@query(
    "a18_loss_of_saved_model",
    with_views(
        "records feedback",
        "SELECT round(avg(-w * (y * ln(mean) + (1 - y) * ln(1 - mean))), 6) AS average_loss, count(*) AS instances_processed FROM r",
        _FRESH_SQL,
    ),
)
def a18_saved(c):
    prior, rows_ = _saved(c), _fresh(c, _design(c)).withColumn("is_val", F.lit(False)).persist()
    found = model.slot_sums(rows_, [model.Point(prior.weights, model.positive_weight(rows_))]).filter("slot = 0")  # every row has this entry once
    return found.select(F.round(F.col("train_loss0") / F.col("n_train"), 6).alias("average_loss"), F.col("n_train").alias("instances_processed"))


@query("m15_update_model")
def m15(c):
    rows_ = [(i, float(w)) for i, w in enumerate(_updated(c).weights)]
    return c.spark.createDataFrame(rows_, "slot int, weight double")


@query("a18_update_losses")
def a18(c):
    history = _updated(c).history
    return c.spark.createDataFrame(
        [(h["round"], h["train_loss"], int(h["n_rows"])) for h in history], "round int, loss double, n_rows bigint"
    ).agg(F.avg("loss").alias("average_loss"), F.max("n_rows").alias("instances_processed"))


@query(
    "m15_instance_log",
    with_views(
        "feedback records",
        """SELECT instance_id, record_id, predicted_prob >= 0.5 AS predicted, predicted_prob, round(uncertainty, 6) AS uncertainty, actual,
        CASE WHEN (predicted_prob >= 0.5) = actual THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward
        FROM feedback WHERE record_id IN (SELECT id FROM records)""",
    ),
)
def m15_log(c):
    logged, _ = model.instance_log(c.feedback, c.records)
    return rounded(logged, "uncertainty")


@query("m17_latest_active", LATEST_SQL)
def m17(c):
    known = versions(c)
    newest = known.filter("is_active").orderBy(F.col("created_at").desc(), F.col("version").desc()).limit(1)
    older = known.join(newest.select("version"), "version", "left_anti").select(known.columns)
    return registry.latest_active(registry.register_version(older, newest)).select("version")


@query("m20_compare_models")
def m20(c):
    found = model.compare_models(_design(c).filter("evaluated"), "wanted", F.col("id"))
    return rounded(found, "accuracy", "precision", "recall", "f1", "mean_uncertainty").limit(3)


@query(
    "m20_metrics_of_saved_models",
    with_views(
        "records",
        """SELECT name, round((tp + tn)::DOUBLE / n, 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 6) AS precision,
        round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
        round(u, 6) AS mean_uncertainty FROM (
          SELECT name, count(*) AS n, count(*) FILTER (mean > 0.5 AND wanted) AS tp, count(*) FILTER (mean > 0.5 AND NOT wanted) AS fp,
            count(*) FILTER (mean <= 0.5 AND wanted) AS fn, count(*) FILTER (mean <= 0.5 AND NOT wanted) AS tn, avg(uncertainty) AS u
          FROM scored JOIN parts USING (id) WHERE part = 'test' GROUP BY name)""",
        {**_entries_sql(), "parts": _SPLIT, "scored": " UNION ALL ".join(f"SELECT 'model {n}' AS name, * FROM ({_scored_sql(n)})" for n in range(5))},
    ),
)
def m20_saved(c):
    designed = _design(c).filter("evaluated")
    rows_ = model.training_rows(designed, "wanted", F.col("id"), cuts=(0.6, 0.8), names=("train", "val", "test")).filter("split = 'test'")
    found = model.metrics_of(rows_, {f"model {n}": _ruled(n) for n in range(5)})
    return rounded(found, "accuracy", "precision", "recall", "f1", "mean_uncertainty")


# ---------------------------------------------------------------- funnels, snapshots


@query(
    "m18_pick_of_the_day",
    with_views(
        "listings records",
        f"""SELECT listing_id, record_id, score FROM (
          SELECT listing_id, record_id, score FROM (SELECT * FROM listings ORDER BY listed_at DESC, listing_id DESC LIMIT 500)
          JOIN (SELECT id AS record_id, {_GIVEN} AS score FROM records) USING (record_id) ORDER BY score DESC, listing_id LIMIT 50)
        ORDER BY {seeded_sql('listing_id', seed=20240110)}, listing_id LIMIT 1""",
    ),
)
def m18(c):
    scores = given_scores(c).select("record_id", F.col("model_score").alias("score"))
    return selection.pick_of_the_day(c.listings, scores, seed=20240110)


@query("m18_pick_of_the_day_scored")
def m18_scored(c):
    designed, fitted = _fitted(c)
    scores = model.score(designed.select(F.col("id").alias("record_id"), "x"), fitted)
    return selection.pick_of_the_day(c.listings, scores.select("record_id", F.col("mean").alias("score")), seed=20240110)


@query("m6_labelling_batch")
def m6_labelling(c):
    _, fitted = _fitted(c)
    return selection.labelling_batch(_unpriced(c), fitted, batch_number=10, seed=6)


@query(
    "m19_ranking_batches",
    with_views(
        "listings records",
        f"""SELECT listing_id, record_id, score, CAST(p AS INT) AS place, CAST(p // 10 AS INT) AS batch_index FROM (
          SELECT *, row_number() OVER (ORDER BY score DESC, listing_id) - 1 AS p, count(*) OVER () AS total FROM (
            SELECT listing_id, record_id, {_GIVEN} AS score FROM listings JOIN records ON id = record_id WHERE wanted
            ORDER BY {seeded_sql('listing_id', seed=12)}, listing_id LIMIT 400)) WHERE p < total // 10 * 10""",
    ),
)
def m19(c):
    scores = given_scores(c).select("record_id", F.col("model_score").alias("score"))
    pool = c.listings.select("listing_id", "record_id").join(scores, "record_id")
    return ranking.ranking_batches(pool, c.records, seed=12)


_CANDIDATES = """SELECT CAST(record_id AS VARCHAR) AS ebay_id, 'record ' || record_id AS title, max(predicted_prob) AS prediction
 FROM feedback GROUP BY record_id"""
_FUNNEL = {
    "first": _CANDIDATES,
    "one": "SELECT * FROM first ORDER BY prediction DESC, ebay_id LIMIT 500",
    "two": "SELECT * FROM one ORDER BY prediction DESC, ebay_id LIMIT 200",
}


def _funnel(c):
    cands = c.feedback.select(
        F.col("record_id").cast("string").alias("ebay_id"),
        F.concat(F.lit("record "), F.col("record_id").cast("string")).alias("title"),
        F.col("predicted_prob").alias("prediction"),
    )
    return auctions.recommend(cands, c.aspects)


@query(
    "m21_recommend",
    with_views("feedback metadata", "SELECT metadata.*, prediction, title FROM two JOIN metadata USING (ebay_id)", _FUNNEL),
)
def m21(c):
    return _funnel(c)[0]


@query(
    "m21_stage_counts",
    with_views(
        "feedback metadata",
        """SELECT (SELECT count(*) FROM first) AS total_listings, (SELECT count(*) FROM one) AS stage1_candidates,
        (SELECT count(*) FROM two JOIN metadata USING (ebay_id)) AS stage2_enriched""",
        _FUNNEL,
    ),
)
def m21_counts(c):
    return _funnel(c)[1]


@query(
    "m22_apply_labels",
    with_views(
        "records",
        """SELECT id, coalesce(said, wanted) AS wanted, evaluated OR said IS NOT NULL AS evaluated FROM records LEFT JOIN (
          SELECT l_partkey AS id, arg_max(l_returnflag = 'A', (l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS said
          FROM lineitem GROUP BY 1) USING (id)""",
    ),
)
def m22(c):
    labels = c.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("listing_id"),
        (F.col("l_returnflag") == "A").alias("label"),
        F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("pos"),
    )
    return rows.apply_record_labels(c.records, c.listings, labels).select("id", "wanted", "evaluated")


@query(
    "m23_mark_evaluated",
    with_views("records feedback", "SELECT id, evaluated OR id IN (SELECT record_id FROM feedback WHERE actual) AS evaluated FROM records"),
)
def m23(c):
    ids = c.feedback.filter("actual").select(F.col("record_id").alias("id"))
    return rows.mark_evaluated(c.records, ids).select("id", "evaluated")


_DELIVERY = """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS listing_id, s.name AS seller, l_quantity,
 CASE WHEN l_partkey % 19 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS discogs_id,
 CASE WHEN l_linenumber = 7 THEN '12.50' ELSE CAST(l_quantity AS VARCHAR) || ', USD' END AS record_price, l_returnflag AS media_condition,
 CASE WHEN l_partkey % 19 = 0 THEN 'missing discogs_id' WHEN l_linenumber = 7 THEN 'bad record_price' END AS reason
 FROM lineitem JOIN sellers s ON s.id = l_suppkey"""
_GOOD = {"d": _DELIVERY, "good": "SELECT * FROM d WHERE reason IS NULL"}


def _intake(c, keep_copies=True):
    sellers = c.sellers.select(F.col("id").alias("l_suppkey"), F.col("name").alias("seller"))
    lines = c.table("lineitem").join(sellers, "l_suppkey")
    delivery = lines.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("listing_id"), "seller",
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_partkey").cast("string")).alias("discogs_id"),
        F.when(F.col("l_linenumber") == 7, F.lit("12.50"))
        .otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit(", USD"))).alias("record_price"),
        F.col("l_returnflag").alias("media_condition"),
    )
    known_sellers = c.sellers.filter("currency <> 'BRL'").select(F.col("name").alias("seller"))
    known_records = c.records.filter("evaluated").select("discogs_id")
    known_listings = lines.filter("l_returnflag = 'R'").select("seller", F.col("l_partkey").cast("string").alias("discogs_id"))
    return intake.ingest(delivery, known_sellers, known_records, known_listings, keep_copies)


@query(
    "m24_ingest_report",
    with_views("sellers", "SELECT count(*) FILTER (reason IS NULL) AS processed, count(*) FILTER (reason IS NOT NULL) AS errors FROM d", _GOOD),
)
def m24(c):
    return _intake(c).report


@query(
    "m24_new_records",
    with_views(
        "sellers records",
        "SELECT discogs_id, min(listing_id) AS listing_id FROM good WHERE discogs_id NOT IN (SELECT discogs_id FROM records WHERE evaluated) GROUP BY 1",
        _GOOD,
    ),
)
def m24_records(c):
    return _intake(c).records


@query(
    "m24_new_sellers",
    with_views("sellers", "SELECT DISTINCT seller FROM good WHERE seller IN (SELECT name FROM sellers WHERE currency = 'BRL')", _GOOD),
)
def m24_sellers(c):
    return _intake(c).sellers


@query(
    "m24_new_listings",
    with_views(
        "sellers",
        """SELECT seller, discogs_id, min(listing_id) AS listing_id FROM good WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN sellers s ON s.id = l_suppkey
        WHERE l_returnflag = 'R' AND s.name = good.seller AND CAST(l_partkey AS VARCHAR) = good.discogs_id) GROUP BY 1, 2""",
        _GOOD,
    ),
)
def m24_listings(c):
    return _intake(c, keep_copies=False).listings.select("seller", "discogs_id", "listing_id")


@query(
    "m24_appended_listings",
    with_views("sellers", "SELECT listing_id, l_quantity AS price, 'USD' AS currency FROM good", _GOOD),
)
def m24_appended(c):
    return _intake(c).listings.select("listing_id", "price", "currency")


@query(
    "m25_split_prices",
    with_views(
        "sellers",
        """SELECT listing_id, CASE WHEN contains(record_price, ', ') THEN TRY_CAST(split_part(record_price, ', ', 1) AS DOUBLE) END AS price,
        CASE WHEN contains(record_price, ', ') THEN 'USD' END AS currency, NOT contains(record_price, ', ') AS failed FROM d""",
        _GOOD,
    ),
)
def m25(c):
    lines = c.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("listing_id"), "l_suppkey",
        F.when(F.col("l_linenumber") == 7, F.lit("12.50"))
        .otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit(", USD"))).alias("record_price"),
    )
    good, bad = intake.split_prices(lines.join(c.sellers.select(F.col("id").alias("l_suppkey")), "l_suppkey"))
    failed = bad.select("listing_id", F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("currency"), F.lit(True).alias("failed"))
    return good.select("listing_id", "price", "currency", F.lit(False).alias("failed")).unionByName(failed)


@query(
    "m26_metrics_summary",
    with_views(
        "records feedback batch_performance",
        f"""SELECT (SELECT count(*) FROM records) AS total_records, (SELECT count(*) FROM records WHERE evaluated) AS evaluated,
        (SELECT count(*) FROM records WHERE wanted) AS keepers, (SELECT count(*) FROM records WHERE evaluated AND NOT wanted) AS non_keepers,
        round((SELECT count(*) FILTER (wanted) * 100.0::DOUBLE / count(*) FILTER (evaluated) FROM records), 6) AS keeper_rate,
        round((SELECT sum(correct)::DOUBLE / sum(total) FROM (SELECT * FROM batch_performance ORDER BY batch_number DESC LIMIT 100)), 6) AS rolling_accuracy,
        round((SELECT avg(accuracy) FROM (SELECT * FROM batch_performance ORDER BY batch_number DESC LIMIT 10)), 6) AS recent_accuracy,
        (SELECT count(*) FROM batch_performance) AS total_batches, (SELECT count(*) FROM feedback) AS training_instances,
        ({LATEST_SQL}) AS model_version""",
    ),
)
def m26(c):
    summary = metrics.metrics_summary(c.records, c.feedback, c.batch_performance, versions(c))
    return rounded(summary, "keeper_rate", "rolling_accuracy", "recent_accuracy")


@query(
    "m27_save_chosen",
    with_views(
        "auctions metadata feedback",
        f"""SELECT a.ebay_id, a.title AS ebay_title, coalesce(price, '') AS price, coalesce(bid, price, '') AS current_bid, bid_count,
        CAST(epoch({_ENDS}) AS BIGINT) AS end_date, m.* EXCLUDE (ebay_id) FROM auctions a JOIN metadata m USING (ebay_id)
        WHERE ebay_id IN (SELECT CAST(record_id AS VARCHAR) FROM feedback WHERE actual) AND CAST(ebay_id AS BIGINT) % 4 <> 0""",
    ),
)
def m27(c):
    chosen = c.feedback.filter("actual").select(F.col("record_id").cast("string").alias("ebay_id"))
    saved = c.auctions.filter(F.col("ebay_id").cast("bigint") % 4 == 0).select("ebay_id")
    found = auctions.save_chosen(c.auctions, c.aspects, chosen, saved)
    return found.withColumn("end_date", F.unix_timestamp("end_date"))
