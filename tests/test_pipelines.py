import json

import pytest
from pyspark.sql import functions as F

from waxworks import session
from waxworks.operators import registry
from waxworks.plans import auctions, intake, ranking, selection
from waxworks.sources import landed, sinks, tables
from waxworks.streaming import feedback as fb


# ---------------------------------------------------------------- where data may be put


class _Session:
    """As much of a session as is asked for a folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})()


def test_scratch_uses_the_configured_folder():
    assert session.scratch_path(_Session("yarn", "hdfs://shared/ck/"), "x").startswith("hdfs://shared/ck/waxworks/x-")
    assert session.scratch_path(_Session("local[2]"), "x") != session.scratch_path(_Session("local[2]"), "x")
    with pytest.raises(RuntimeError):
        session.scratch_path(_Session("spark://host:7077"), "x")


# ---------------------------------------------------------------- sources and sinks


def test_scan_pushes_filter_and_columns(spark, folder):
    df = tables.load_table(spark, f"{folder}/part.parquet", ["p_partkey"], F.col("p_size") > 25)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,25)" in plan and "p_name" not in plan


def _page(offset, ids, total=5, limit=2):
    items = [{"itemId": i, "title": f"t{i}", "price": {"value": "1"}} for i in ids]
    return (json.dumps({"total": total, "limit": limit, "offset": offset, "itemSummaries": items}),)


def _items(spark, pages, **options):
    raw = spark.createDataFrame(pages, "value string")
    got = landed.flatten_pages(landed.parse_pages(raw), **options)
    return [r["i"] for r in got.orderBy("offset", "pos").select(F.col("item.itemId").alias("i")).collect()]


def test_pages_stop_at_the_first_empty_one(spark):
    pages = [_page(0, "ab"), _page(2, "bc"), _page(4, ""), _page(6, "z"), ("not json",)]
    assert _items(spark, pages) == ["a", "b", "c"]
    assert _items(spark, pages, cap=3) == ["a", "b"]


def test_pages_stop_at_the_total(spark):
    pages = [_page(0, "ab"), _page(2, "cd"), _page(4, "e"), _page(6, "f")]
    assert _items(spark, pages, stop_at_total=True) == list("abcde")
    assert _items(spark, pages) == list("abcdef")


def test_inventory_defaults_and_rejects(spark):
    full = {"release": {"id": 1, "artist": "A", "format": ["Vinyl", "LP"], "stats": {"community": {"in_wantlist": 5}}},
            "condition": "NM", "price": {"value": 9.5, "currency": "EUR"}, "seller": {"username": "s"}}
    rows = [(json.dumps(full),), (json.dumps({**full, "price": None}),), ("junk",)]
    flat, bad = landed.flatten_inventory(spark.createDataFrame(rows, "value string"))
    got = flat.first()
    assert (got["record_price"], got["title"], got["wants"], got["haves"], got["genres"], got["format"]) == ("9.5, EUR", "", 5, 0, [], "Vinyl LP")
    assert bad.count() == 2


def test_inventory_is_parsed_once(spark):
    raw = spark.range(9).select(F.concat(F.lit('{"release": {"id": '), F.col("id").cast("string"), F.lit("}}")).alias("value"))
    for side in landed.flatten_inventory(raw):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_csv_set_and_training_csv(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "hi", you'), ("2", 'say "hi", you'), ("3", "x")], "ebay_id string, title string")
    for part in ("a", "b"):
        sinks._csv(rows, f"{tmp_path}/buyitnow_{part}")
    both = landed.read_csv_set(spark, f"{tmp_path}/buyitnow_*", "ebay_id string, title string")
    assert both.count() == 6
    path = sinks.write_training_csv(rows, f"{tmp_path}/train")
    back = landed.read_csv_set(spark, path, "ebay_id string, title string")
    assert sorted(map(tuple, back.collect())) == [("1", 'say "hi", you'), ("3", "x")]
    assert sinks.write_csv_dated(rows, str(tmp_path), "2024-01-02").endswith("auctions_2024-01-02")


def test_name_and_object_lists(spark, tmp_path):
    (tmp_path / "n.json").write_text('["a",\n "b"]')
    (tmp_path / "o.json").write_text('[{"name": "a", "currency": "EUR"}]')
    assert sorted(r[0] for r in landed.read_name_list(spark, str(tmp_path / "n.json")).collect()) == ["a", "b"]
    assert landed.read_object_list(spark, str(tmp_path / "o.json"), "name string, currency string").first()["currency"] == "EUR"


def test_registry_keeps_one_active(spark):
    empty = spark.createDataFrame([], "version string, created_at timestamp, training_stats string, is_active boolean")
    assert registry.latest_active(empty).first()["version"] == "none"
    known = empty
    for second in (10, 20):
        entry = spark.range(1).select(*registry.new_version(F.timestamp_seconds(F.lit(second)), F.lit("{}")))
        known = registry.register_version(known, entry)
    assert known.filter("is_active").count() == 1
    assert registry.latest_active(known).first()["version"] == "v19700101_000020"


# ---------------------------------------------------------------- plans


def _delivery(spark):
    rows = [
        ("l1", "s1", "r1", "10, USD", "NM"), ("l2", "s1", "r1", "11, USD", "NM"), ("l3", "s2", "r2", "12", "NM"),
        ("l4", "s2", None, "12, USD", "NM"), ("l5", "s2", "r3", "12, USD", ""), ("l6", "s2", "r3", "12, USD", "VG"),
    ]
    return spark.createDataFrame(rows, "listing_id string, seller string, discogs_id string, record_price string, media_condition string")


def test_intake_modes(spark):
    sellers = spark.createDataFrame([("s1",)], "seller string")
    records = spark.createDataFrame([("r1",)], "discogs_id string")
    listings = spark.createDataFrame([("s2", "r3")], "seller string, discogs_id string")
    run = lambda copies: intake.ingest(_delivery(spark), sellers, records, listings, copies)
    got = run(True)
    assert got.report.first() == (3, 3)
    assert [r["seller"] for r in got.sellers.collect()] == ["s2"] and [r["discogs_id"] for r in got.records.collect()] == ["r3"]
    assert got.listings.count() == 3
    assert {r["listing_id"]: r["reason"] for r in got.rejects.collect()} == {
        "l3": "bad record_price", "l4": "missing discogs_id", "l5": "missing media_condition"}
    assert [r["listing_id"] for r in run(False).listings.collect()] == ["l1"]


def test_ranking_session_drops_the_remainder(spark):
    listings = spark.range(35).select(F.concat(F.lit("l"), "id").alias("listing_id"), (F.col("id") % 7).alias("record_id"), (F.col("id") / 35).alias("score"))
    records = spark.range(7).select("id", F.lit(True).alias("evaluated"), (F.col("id") > 0).alias("wanted"))
    got = ranking.ranking_batches(listings, records, n=28).collect()
    assert len(got) == 20 and max(r["batch_index"] for r in got) == 1
    scores = [r["score"] for r in sorted(got, key=lambda r: r["place"])]
    assert scores == sorted(scores, reverse=True)
    batches = ranking.ranking_batches(listings, records, n=28)
    assert ranking.next_batch(batches, 1).count() == 10 and ranking.next_batch(batches, 2).count() == 0


def test_recommendation_counts(spark):
    cands = spark.range(30).select(F.col("id").cast("string").alias("ebay_id"), F.lit("t").alias("title"), (F.col("id") / 30).alias("prediction"))
    aspects = spark.range(25).select(F.col("id").cast("string").alias("ebay_id"), F.expr("array(named_struct('name', 'Artist', 'value', 'x'))").alias("aspects"))
    rows, counts = auctions.recommend(cands, aspects, top=20, enriched=10)
    assert counts.first() == (30, 20, 5)
    assert [r["ebay_id"] for r in rows.collect()] == ["24", "23", "22", "21", "20"]


def test_pick_of_the_day_is_among_the_best(spark):
    listings = spark.range(100).select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("listing_id"), F.col("id").alias("record_id"), F.timestamp_seconds("id").alias("listed_at"))
    scores = spark.range(100).select(F.col("id").alias("record_id"), (-F.col("id")).cast("double").alias("score"))
    got = selection.pick_of_the_day(listings, scores, seed=1, latest=20, top=5).first()
    assert 80 <= got["record_id"] < 85


# ---------------------------------------------------------------- streams


def _feed_rows(spark, batches):
    rows = [("m", b, 3, b * 3 + i, i, 0.5 + i / 10, 0.1, i == 2) for b in batches for i in range(3)]
    return spark.createDataFrame(rows, fb.FEED)


def test_buffers_wait_and_survive_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    stream = lambda: spark.readStream.schema(fb.FEED).option("maxFilesPerTrigger", 1).parquet(src)
    _feed_rows(spark, [0, 1, 2, 7]).coalesce(1).write.mode("append").parquet(src)
    fb.run_buffered(stream(), out, state)
    assert not list((tmp_path / "out").glob("*.parquet")) or spark.read.parquet(out).count() == 0
    _feed_rows(spark, [4, 3]).coalesce(1).write.mode("append").parquet(src)
    fb.run_buffered(stream(), out, state)
    got = spark.read.parquet(out)
    assert got.count() == 15 and got.select("buffer").distinct().collect() == [(0,)]


def test_a_batch_in_three_parts_is_not_lost(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = _feed_rows(spark, range(5)).collect()
    for part in (rows[:13], rows[12:14], rows[3:5], rows[14:], rows[:1]):  # with repeats, the last after all
        spark.createDataFrame(part, fb.FEED).coalesce(1).write.mode("append").parquet(src)
        fb.run_buffered(spark.readStream.schema(fb.FEED).parquet(src), out, state)
    got = spark.read.parquet(out).collect()
    assert sorted(r["instance_id"] for r in got if not r["late"]) == list(range(15))
    assert [r["instance_id"] for r in got if r["late"]] == [0]


def test_split_prices_keeps_rejects_without_an_id(spark):
    listings = spark.createDataFrame([("a", "5.00, USD"), (None, "bad"), ("b", "bad"), (None, "1.00, EUR")], "listing_id string, record_price string")
    good, bad = intake.split_prices(listings)
    assert good.count() == 2 and sorted(str(r["listing_id"]) for r in bad.collect()) == ["None", "b"]


def test_streaming_accuracy_equals_batch(spark, tmp_path):
    from waxworks.operators.metrics import batch_performance

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    feed = _feed_rows(spark, range(6))
    feed.repartition(4).write.parquet(src)
    fb.run_batch_accuracy(spark.readStream.schema(fb.FEED).option("maxFilesPerTrigger", 1).parquet(src), out, state)
    got = fb.accuracy_so_far(spark.read.parquet(out)).orderBy("batch_number").collect()
    assert got == batch_performance(feed).orderBy("batch_number").collect()


def test_model_update_from_a_buffer(spark, folder):
    """A whole buffer updates the model and re-tunes the threshold."""
    pytest.importorskip("numpy")
    from waxworks.streaming.feedback import on_buffer

    from catalog.composites import _fitted
    from waxworks.sources.tables import Catalogue

    c = Catalogue(spark, folder)
    designed, fitted = _fitted(c)
    history = c.feedback
    got = on_buffer(fitted, history, designed.select(F.col("id").alias("record_id"), "x"), history)
    assert got.n_rows > 0 and 0 < got.threshold < 1 and (got.model.precision >= fitted.precision).all()
