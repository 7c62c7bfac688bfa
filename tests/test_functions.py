import hashlib
import math

import pytest
from pyspark.sql import functions as F

from waxworks.functions import money, numeric, payload, seeded, text, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def many(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_normalize_title(spark):
    titles = ["  The BEST of John Coltrane (LP, 12 inch) near mint!! ", "a b c", "", None, "Café Bleu bleu", " x99 y"]
    assert many(spark, text.normalize_title(F.col("v")), titles) == ["coltrane john", "", "", "", "bleu caf", "x99"]


def test_mock_title_skips_blank_fields(spark):
    cols = [F.col(c) for c in ("a", "t", "l", "y")]
    rows = [("Alice", "Ptah", "Impulse", 1970), ("", "Ptah", None, 0)]
    df = spark.createDataFrame(rows, "a string, t string, l string, y int")
    assert [r[0] for r in df.select(text.mock_title(*cols)).collect()] == ["1970 alice impulse ptah", "ptah"]


def test_parse_price(spark):
    prices = ["$12.50", "€9,99 EUR", "15.00, USD", "GBP 7", "free", "", None, "1,200.50"]
    assert many(spark, money.parse_price(F.col("v")), prices) == [12.5, 9.0, 15.0, 7.0, 0.0, 0.0, 0.0, 1.0]


def test_split_price_needs_two_parts(spark):
    texts = ["10.5, EUR", "10.5", "1, 2, 3", "x, USD", "", None, ", USD"]
    assert many(spark, money.price_amount(F.col("v")), texts) == [10.5, None, None, None, None, None, None]
    assert many(spark, money.price_currency(F.col("v")), texts) == ["EUR", None, None, "USD", None, None, "USD"]


def test_suggested_price_forms_and_grades(spark):
    rows = [
        ("<Price 149.5 'USD'>", "Very Good Plus (VG+)", 149.5), ("100, USD", "Near Mint (NM or M-)", 131.0),
        ("100", "Very Good (VG)", 69.0), ("100", "Good Plus (G+)", 38.0), ("100", "unknown", 100.0), ("n/a", "x", None),
        ("<Price x>", "x", None), ("100", None, 100.0),
    ]
    df = spark.createDataFrame(rows, "p string, c string, want double")
    for r in df.select("want", money.suggested_price(F.col("p"), F.col("c")).alias("got")).collect():
        assert r["got"] == (pytest.approx(r["want"]) if r["want"] is not None else None)


def test_display_price(spark):
    assert many(spark, money.display_price(F.col("v")), ["USD 12.5", "free", "", None]) == ["$12.50", "—", "—", "—"]


def test_hash_index_is_the_whole_md5(spark):
    words = ["Blue Note", "  blue note ", "ECM", "日本"]
    for size in (1000, 500, 100, 200):
        want = [int(hashlib.md5(w.strip().lower().encode()).hexdigest(), 16) % (size - 1) + 1 for w in words]
        assert many(spark, numeric.hash_index(F.col("v"), size), words) == want
    assert many(spark, numeric.hash_index(F.col("v"), 100), ["", "  ", None]) == [0, 0, 0]


def test_hash_slots_pad_with_zero(spark):
    slots = numeric.hash_slots(F.col("v"), 100)
    got = many(spark, F.array(*slots), [["a", "b", "c", "d"], ["a"], [], None, ["", "a"]], "array<string>")
    assert got[0][0] == got[1][0] == got[4][1] and got[1][1:] == [0, 0] and got[2] == got[3] == [0, 0, 0] and got[4][0] == 0


def test_scale_year(spark):
    column = numeric.scale_year(F.col("v"), F.lit(1960), F.lit(2000))
    assert many(spark, column, [1980, None, 1900, 2026, 1950, 2010, 2025], "int") == [0.5, 0.5, 0.5, 0.5, 0.0, 1.0, 1.0]
    assert many(spark, numeric.scale_year(F.col("v"), F.lit(1980), F.lit(1980)), [1980], "int") == [0.5]


def test_grades_take_the_first_that_occurs(spark):
    texts = ["NM", "VG+", "Very Good Plus (VG+)", "Near Mint (NM or M-)", "M", "poor", "", None, "sealed", "G+"]
    assert many(spark, numeric.grade_index(F.col("v")), texts) == [7, 3, 3, 7, 8, 1, 0, 0, 0, 3]
    assert many(spark, numeric.grade_index(F.col("v"), strict=True), texts) == [7, 6, 6, 7, 8, 1, 0, 0, 0, 4]


def test_demand_and_ratio(spark):
    df = spark.createDataFrame([(10, 5), (7, 0), (0, 3)], "w int, h int")
    got = df.select(numeric.demand(F.col("w"), F.col("h")).alias("d"), numeric.want_ratio(F.col("w"), F.col("h")).alias("r")).collect()
    assert [r["d"] for r in got] == [pytest.approx(2 * math.log(11)), 0.0, 0.0]
    assert [r["r"] for r in got] == [2.0, 7.0, 0.0]


def test_string_list(spark):
    texts = ['["Jazz","Soul"]', '"Jazz"', "Jazz", "", None, "[]", '["a", 1]', '"say \\"hi\\""']
    got = many(spark, payload.string_list(F.col("v")), texts)
    assert got == [["Jazz", "Soul"], ["Jazz"], [], [], [], [], [], ['say "hi"']]


def _aspects(spark, pairs):
    df = spark.createDataFrame([([{"name": n, "value": v} for n, v in pairs],)], "aspects array<struct<name: string, value: string>>")
    return df.select(*[v.alias(k) for k, v in payload.aspect_columns(F.col("aspects")).items()]).first().asDict()


def test_aspects_full_list(spark):
    got = _aspects(spark, [
        ("Artist", "John Coltrane"), ("Release Title", "A Love Supreme"), ("Record Label", "Impulse!"), ("Format", "LP"),
        ("Release Year", "1965"), ("Record Grading", "NM"), ("Sleeve Grading", "VG+"), ("Genre", "Jazz"), ("Style", "Spiritual Jazz"),
    ])
    assert got == {
        "artist": "John Coltrane", "album": "A Love Supreme", "label": "Impulse!", "format": "LP", "year": "1965",
        "record_condition": "NM", "sleeve_condition": "VG+", "genre": "Jazz", "style": "Spiritual Jazz",
    }


def test_aspects_alternative_names(spark):
    got = _aspects(spark, [("Album", "Blue Train"), ("Label", "Blue Note"), ("Year", "1957")])
    assert (got["album"], got["label"], got["year"], got["artist"]) == ("Blue Train", "Blue Note", "1957", "")
    got = _aspects(spark, [("Album", ""), ("Release Title", "First"), ("Album", "Second"), ("Genre", "a"), ("Genre", "b")])
    assert got["album"] == "First" and got["genre"] == "b"


def test_instant_and_version(spark):
    moments = many(spark, F.unix_timestamp(payload.instant(F.col("v"))), ["2024-01-02T03:04:05Z", "soon", None, "2024-01-02T03:04:05.250Z", "2024-01-02", "2024-01-02T05:04:05+02:00", "2024-13-02T03:04:05Z"])
    assert moments == [1704164645, None, None, 1704164645, None, 1704164645, None]
    stamp = payload.version_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert one(spark, stamp) == "v20240102_030405"


def test_seeded_draws(spark):
    df = spark.range(20000)
    u = df.select(seeded.seeded_uniform(F.col("id"), seed=1).alias("u"), seeded.seeded_normal(F.col("id"), seed=1).alias("z"))
    stats = u.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(stats[0] - 0.5) < 0.01 and 0 < stats[1] and stats[2] < 1 and abs(stats[3]) < 0.03 and abs(stats[4] - 1) < 0.02


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(*[vectors.distance(m)(F.col("a"), F.col("b")).alias(m) for m in ("euclidean", "cosine")]).collect()
    assert got[0]["euclidean"] == 5.0 and got[0]["cosine"] == 1.0 and got[1]["cosine"] == 1.0
    units = df.select(vectors.norm(vectors.unit(F.col("a"))).alias("n"), vectors.unit(F.col("b")).alias("z")).first()
    assert units["n"] == pytest.approx(1.0, abs=1e-5) and units["z"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.distance("manhattan")
