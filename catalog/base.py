"""Registry of queries, and the SQL twins of the catalogue views."""

from __future__ import annotations

from waxworks.functions.text import STOP_WORDS
from waxworks.sources.tables import CONDITIONS, RATES, Catalogue

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(catalogue) -> DataFrame`` under a name, with its SQL twin if there is one."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + " END"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_K = "CAST(props->>'k' AS INT)"


def tokens_sql(text: str) -> str:
    """Sorted distinct title words of a text expression."""
    words = rf"string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\s]', ' ', 'g'), '\s+')"
    return (
        f"list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 1 "
        f"AND NOT list_contains([{_STOPS}], w))))"
    )


def title_sql(text: str) -> str:
    return f"coalesce(array_to_string({tokens_sql(text)}, ' '), '')"


def mock_sql(prefix: str = "") -> str:
    p = prefix
    return title_sql(
        f"concat_ws(' ', nullif({p}artist, ''), nullif({p}title, ''), nullif({p}label, ''), "
        f"CAST(nullif({p}year, 0) AS VARCHAR))"
    )


def seeded_sql(*parts: str, seed) -> str:
    return f"md5(concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}, '{seed}'))"


def seeded_int_sql(*parts: str, seed) -> str:
    return f"CAST(('0x' || substr({seeded_sql(*parts, seed=seed)}, 1, 8)) AS BIGINT)"


def hash_sql(text: str, size: int) -> str:
    clean = f"trim(lower({text}))"
    return (
        f"CASE WHEN coalesce({clean}, '') = '' THEN 0 ELSE "
        f"CAST(('0x' || md5({clean}))::UHUGEINT % {size - 1} + 1 AS BIGINT) END"
    )


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "records": (
        """SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS discogs_id, p_brand AS artist, p_name AS title,
        CASE WHEN p_size % 2 = 0 THEN 'Vinyl, LP' ELSE 'CD' END AS format, p_brand AS label,
        [p_type] AS genres, string_split(p_name, ' ') AS styles, 1950 + p_size AS year,
        CASE p_partkey % 3 WHEN 0 THEN '<Price ' || (floor(p_retailprice * 2) / 100) || ' ''USD''>'
             WHEN 1 THEN (floor(p_retailprice * 2) / 100) || ', USD'
             ELSE CAST(floor(p_retailprice * 2) / 100 AS VARCHAR) END AS suggested_price,
        (p_partkey * 7919) % 500 AS wants, (p_partkey * 104729) % 400 AS haves,
        p_partkey % 3 <> 0 AS evaluated, p_partkey % 3 <> 0 AND p_partkey % 5 = 0 AS wanted
        FROM part""",
        (),
    ),
    "sellers": (
        "SELECT s_suppkey AS id, s_name AS name, "
        + _case("s_nationkey % 6", [(i, f"'{c}'") for i, c in enumerate(RATES)])
        + " AS currency FROM supplier",
        (),
    ),
    "listings": (
        """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS listing_id,
        l_suppkey AS seller_id, l_partkey AS record_id,
        (floor(l_extendedprice / l_quantity) / 100) || ', ' || s.currency AS record_price, """
        + _case("l_returnflag || l_linestatus", [(f"'{a}'", f"'{b}'") for a, b in CONDITIONS.items()])
        + """ AS media_condition, CAST(l_shipdate AS TIMESTAMP) AS listed_at
        FROM lineitem JOIN sellers s ON s.id = l_suppkey""",
        ("sellers",),
    ),
    "rates": (
        "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({r} AS DOUBLE))" for c, r in RATES.items()) + ") t(currency, rate)",
        (),
    ),
    "feedback": (
        f"""SELECT event_id AS instance_id, event_id // 4 AS record_id, CAST(ts AS TIMESTAMP) AS ts,
        {_K} / 100.0::DOUBLE AS predicted_prob, value / 500 AS uncertainty,
        event_type IN ('purchase', 'signup') AS actual FROM events""",
        (),
    ),
    "feedback_batches": (
        """SELECT *, CAST((row_number() OVER (ORDER BY ts, instance_id) - 1) // 20 AS BIGINT) AS batch_number
        FROM feedback""",
        ("feedback",),
    ),
    "batch_performance": (
        """SELECT batch_number, CAST(sum(CASE WHEN (predicted_prob > 0.5) = actual THEN 1 ELSE 0 END) AS BIGINT) AS correct,
        count(*) AS total,
        sum(CASE WHEN (predicted_prob > 0.5) = actual THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy
        FROM feedback_batches GROUP BY batch_number""",
        ("feedback_batches",),
    ),
    "auctions": (
        f"""SELECT CAST(event_id AS VARCHAR) AS ebay_id,
        concat_ws(' ', 'LP', event_type, CAST(user_id AS VARCHAR), props) AS title,
        CASE WHEN event_type <> 'error' THEN CAST(round(value, 2) AS VARCHAR) END AS price,
        CASE WHEN event_type = 'purchase' THEN CAST(round(value + 1, 2) AS VARCHAR) END AS bid,
        {_K} AS bid_count,
        CASE WHEN event_id % 50 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS end_date,
        CASE WHEN {_K} % 2 = 0 THEN 'AUCTION' ELSE 'FIXED_PRICE' END AS buying_option,
        CASE WHEN user_id % 4 = 0 THEN 'CA' ELSE 'US' END AS country,
        CASE WHEN user_id % 3 = 0 THEN '1000' ELSE '3000' END AS condition_id
        FROM events""",
        (),
    ),
    "titles": (
        "SELECT d.doc_id, d.text AS title, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)",
        (),
    ),
    "keeper_titles": ("SELECT doc_id, title FROM titles WHERE quality = 1", ("titles",)),
    "candidate_titles": ("SELECT doc_id, title FROM titles WHERE quality IS NULL", ("titles",)),
    "rankings": (
        f"""SELECT user_id || '-' || CAST((n - 1) // 10 AS BIGINT) AS session_id, (n - 1) % 10 AS pos, event_id AS item_id,
        embedding, price_diff, demand FROM (
          SELECT user_id, event_id, {_K} / 100.0::DOUBLE AS embedding, value / 500 AS price_diff,
          CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS demand,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""",
        (),
    ),
    "aspects": (
        """SELECT CAST(p_partkey AS VARCHAR) AS ebay_id, unnest([
          {'place': 1, 'name': 'Artist', 'value': p_brand},
          {'place': 2, 'name': CASE WHEN p_partkey % 2 = 0 THEN 'Release Title' ELSE 'Album' END, 'value': p_name},
          {'place': 3, 'name': 'Album', 'value': upper(p_name)},
          {'place': 4, 'name': CASE WHEN p_partkey % 2 = 0 THEN 'Record Label' ELSE 'Label' END,
           'value': CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END},
          {'place': 5, 'name': 'Label', 'value': 'fallback label'},
          {'place': 6, 'name': CASE WHEN p_partkey % 2 = 0 THEN 'Format' ELSE 'Record Size' END, 'value': 'LP'},
          {'place': 7, 'name': CASE WHEN p_partkey % 2 = 0 THEN 'Release Year' ELSE 'Year' END,
           'value': CAST(1950 + p_size AS VARCHAR)},
          {'place': 8, 'name': 'Genre', 'value': 'first genre'},
          {'place': 9, 'name': 'Genre', 'value': p_type},
          {'place': 10, 'name': 'Record Grading', 'value': CASE WHEN p_partkey % 2 = 0 THEN 'NM' ELSE 'VG+' END}
        ]) AS a FROM part""",
        (),
    ),
    "metadata": (
        """SELECT ebay_id,
        coalesce(arg_max(a.value, a.place) FILTER (a.name = 'Artist'), '') AS artist,
        coalesce(arg_min(a.value, a.place) FILTER (a.name IN ('Release Title', 'Album') AND a.value <> ''), '') AS album,
        coalesce(arg_min(a.value, a.place) FILTER (a.name IN ('Record Label', 'Label') AND a.value <> ''), '') AS label,
        coalesce(arg_min(a.value, a.place) FILTER (a.name IN ('Format', 'Record Size') AND a.value <> ''), '') AS format,
        coalesce(arg_min(a.value, a.place) FILTER (a.name IN ('Release Year', 'Year') AND a.value <> ''), '') AS year,
        coalesce(arg_max(a.value, a.place) FILTER (a.name = 'Record Grading'), '') AS record_condition,
        coalesce(arg_max(a.value, a.place) FILTER (a.name = 'Sleeve Grading'), '') AS sleeve_condition,
        coalesce(arg_max(a.value, a.place) FILTER (a.name = 'Genre'), '') AS genre,
        coalesce(arg_max(a.value, a.place) FILTER (a.name = 'Style'), '') AS style
        FROM aspects GROUP BY ebay_id""",
        ("aspects",),
    ),
}


def with_views(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named views, and what they rest on, as CTEs."""
    ordered: dict[str, str] = {}

    def add(name):
        text, needs = VIEWS[name]
        for n in needs:
            add(n)
        ordered.setdefault(name, text)

    for name in names.split():
        add(name)
    ordered.update(extra or {})
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ordered.items()) + "\n" + body
