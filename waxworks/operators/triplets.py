"""Anchor, positive, negative: mining and losses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxworks.functions.seeded import seeded_int, seeded_key
from waxworks.functions.vectors import distance
from waxworks.operators.joins import join_checked, replicated_if_small, spread
from waxworks.operators.ordering import group_rank, row_index
from waxworks.session import stable

PROFILE = ("genres", "styles", "label", "year")
MIN_HISTORY = 10
ID_RANGES = 1024  # into which the ids of the score at the cut are counted


def similarity(a: Column, b: Column) -> Column:
    """0 to 8 points for what two records share; both are structs of genres, styles, label, year."""

    def shared(field):
        return F.coalesce(F.arrays_overlap(a[field], b[field]), F.lit(False))

    close = (a["year"] != 0) & (b["year"] != 0) & (F.abs(a["year"] - b["year"]) <= 5)
    return (
        F.when(shared("genres"), 3).otherwise(0)
        + F.when(shared("styles"), 2).otherwise(0)
        + F.when(a["label"].eqNullSafe(b["label"]), 2).otherwise(0)
        + F.when(F.coalesce(close, F.lit(False)), 1).otherwise(0)
    )


def score_negatives(anchors: DataFrame, negatives: DataFrame) -> DataFrame:
    """Similarity of every negative to each anchor: (slot, id, score).

    ``anchors`` is (slot, anchor), a short list by construction: the slots of one mining run, a
    hundred in the reference. It is measured and then sent to the negatives, which are scored where
    they lie; what follows adds them up per score, so the scored rows are never shuffled. A list that
    is longer than the limit still gives the same rows, as a partitioned product. Negatives of a small
    table, which has few splits, are dealt to all cores first: the product is a hundred times as large.
    """
    candidates = spread(negatives.select("id", F.struct(*PROFILE).alias("_b")), "id")
    short = replicated_if_small(anchors.select("slot", F.col("anchor").alias("_a")))
    return candidates.crossJoin(short).select(
        "slot", "id", similarity(F.col("_a"), F.col("_b")).alias("score")
    )


def _pool_size(total: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(total / 5)).cast("bigint")


def _levels(scored: DataFrame, *extra: Column) -> DataFrame:
    """Per slot and score: how many, and how many score higher. At most nine rows per slot."""
    counted = scored.groupBy("slot", "score").agg(F.count("*").alias("n"), *extra)
    higher = Window.partitionBy("slot").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("slot")
    return counted.withColumns(
        {
            "above": F.coalesce(F.sum("n").over(higher), F.lit(0)),
            "pool": _pool_size(F.sum("n").over(whole)),
        }
    )


def hard_pool(scored: DataFrame) -> DataFrame:
    """The most similar fifth of the negatives of each slot, by (score, id).

    A histogram of the scores tells at which score the cut falls, and a count over ranges of ids in which
    range of that score. Rows above need no ranking at all; only the rows of that range are ranked by id,
    so the product is read three times, but never sorted or stored.
    """
    whole_ids = dict(scored.dtypes)["id"] in ("bigint", "int")
    cut = (
        _levels(scored, F.min("id").alias("lo"), F.max("id").alias("hi"))
        .filter((F.col("above") < F.col("pool")) & (F.col("above") + F.col("n") >= F.col("pool")))
        .select("slot", F.col("score").alias("_cut"), (F.col("pool") - F.col("above")).alias("_room"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    )
    share = (F.col("id") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1).cast("double") if whole_ids else F.lit(0.0)
    near = join_checked(scored, cut, ["slot"]).filter(F.col("score") >= F.col("_cut"))
    near = near.withColumn("_range", F.when(F.col("score") > F.col("_cut"), -1).otherwise(F.floor(share * ID_RANGES).cast("int")))
    so_far = Window.partitionBy("slot").orderBy("_range")  # at most ID_RANGES rows
    counts = near.filter("_range >= 0").groupBy("slot", "_range").agg(F.count("*").alias("_n"), F.first("_room").alias("_room"))
    last = counts.withColumn("_upto", F.sum("_n").over(so_far)).filter("_upto >= _room and _upto - _n < _room")
    last = last.select("slot", F.col("_range").alias("_last"), (F.col("_room") - F.col("_upto") + F.col("_n")).alias("_left"))
    placed = join_checked(near, last, ["slot"])
    sure = placed.filter(F.col("_range") < F.col("_last")).select("slot", "id", "score")
    edge = placed.filter(F.col("_range") == F.col("_last")).select("slot", "id", "score", "_left")
    ranked = group_rank(edge, ["slot"], F.col("id"), name="_r").filter(F.col("_r") <= F.col("_left"))
    return sure.unionByName(ranked.select("slot", "id", "score"))


def pick_hard(scored: DataFrame, seed) -> DataFrame:
    """One negative per slot, drawn from its most similar fifth: (slot, negative).

    Ties at the cut are broken at random, then one member of the pool is drawn. That equals drawing
    first whether the pick lies above the cut (above : pool), then a row of that side. Both need just
    a count and one seeded minimum per score. The least start of a key is a number, which is added up by hash; the
    least of whole keys, a text, would sort all scored rows. So a second pass reads the rows of that start only.
    """
    key = seeded_key(F.col("slot"), F.col("id"), seed=seed)
    start = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")
    higher = Window.partitionBy("slot").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = stable(_levels(scored, F.min(start).alias("_start")))
    few = join_checked(scored, levels.select("slot", "score", "_start"), ["slot", "score"]).filter(start == F.col("_start"))
    picks = few.groupBy("slot", "score").agg(F.min(F.struct(key.alias("k"), F.col("id").alias("id"))).alias("pick"))
    levels = levels.join(picks, ["slot", "score"]).withColumn("pick_above", F.min("pick").over(higher))
    edge = levels.filter((F.col("above") < F.col("pool")) & (F.col("above") + F.col("n") >= F.col("pool")))
    depth = seeded_int(F.col("slot"), "depth", seed=seed) % F.col("pool")
    chosen = F.when(depth < F.col("above"), F.col("pick_above")).otherwise(F.col("pick"))
    return edge.select("slot", chosen["id"].alias("negative"))


def _at_random(slots: DataFrame, items: DataFrame, place: Column, name: str) -> DataFrame:
    """Give each slot the item at a drawn position: an equi-join on position."""
    placed = row_index(items.select("id"), F.col("id"), name="_at").select("_at", F.col("id").alias(name))
    return slots.withColumn("_at", place).join(placed, "_at").drop("_at")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _modulo(value: Column, n: Column) -> Column:
    return value % F.nullif(n, F.lit(0))


def mine_triplets(keepers: DataFrame, negatives: DataFrame, n: int, seed, hard: bool = True) -> DataFrame:
    """``n`` triplets (slot, anchor, positive, negative) of ids.

    Anchor and positive are two different keepers; the negative is drawn from all negatives, or from
    the fifth most similar to the anchor. Frames have id, genres, styles, label, year.
    """
    spark = keepers.sparkSession
    slots = spark.range(n).select(F.col("id").cast("string").alias("slot")).crossJoin(_count(keepers, "_k"))
    first = _modulo(seeded_int(F.col("slot"), "anchor", seed=seed), F.col("_k"))
    step = _modulo(seeded_int(F.col("slot"), "positive", seed=seed), F.col("_k") - 1)
    drawn = slots.withColumns({"_first": first}).withColumn("_second", (F.col("_first") + 1 + step) % F.col("_k"))
    pairs = _at_random(drawn, keepers, F.col("_first"), "anchor")
    pairs = _at_random(pairs, keepers, F.col("_second"), "positive").select("slot", "anchor", "positive")
    if not hard:
        placed = pairs.crossJoin(_count(negatives, "_n"))
        place = _modulo(seeded_int(F.col("slot"), "negative", seed=seed), F.col("_n"))
        return _at_random(placed, negatives, place, "negative").select("slot", "anchor", "positive", "negative")
    profiles = keepers.select(F.col("id").alias("anchor"), F.struct(*PROFILE).alias("_p"))
    anchors = pairs.join(profiles, "anchor").select("slot", F.col("_p").alias("anchor"))
    return pairs.join(pick_hard(score_negatives(anchors, negatives), seed), "slot")


def mine_batch_triplets(
    batch: DataFrame, keepers: DataFrame, others: DataFrame, seed, per_keeper: int = 10, hard_ratio: float = 0.5
) -> DataFrame:
    """Triplets for the keepers of a labelled batch, against the labelled history.

    ``batch`` has kept (bool) besides the profile columns. The first part of each keeper's triplets
    gets a hard negative. No rows when the batch has no keeper or a side of the history is short.
    """
    sizes = _count(keepers, "_k").crossJoin(_count(others, "_n"))
    enough = (F.col("_k") >= MIN_HISTORY) & (F.col("_n") >= MIN_HISTORY)
    anchors = batch.filter("kept").select(F.col("id").alias("anchor"), F.struct(*PROFILE).alias("_p"))
    slots = (
        anchors.crossJoin(sizes.filter(enough))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_keeper - 1))))
        .withColumn("slot", F.concat_ws("-", "anchor", "i"))
    )
    place = _modulo(seeded_int(F.col("slot"), "positive", seed=seed), F.col("_k"))
    paired = _at_random(slots, keepers, place, "positive")
    is_hard = F.col("i") < F.lit(per_keeper * hard_ratio)
    hard = paired.filter(is_hard)
    wanted = hard.select("slot", F.col("_p").alias("anchor"))
    hard = hard.join(pick_hard(score_negatives(wanted, others), seed), "slot")
    place = _modulo(seeded_int(F.col("slot"), "negative", seed=seed), F.col("_n"))
    easy = _at_random(paired.filter(~is_hard), others, place, "negative")
    cols = ["slot", "anchor", "positive", "negative"]
    return hard.select(*cols).unionByName(easy.select(*cols))


def triplet_loss(a: Column, p: Column, n: Column, margin: float = 1.0, metric: str = "euclidean") -> Column:
    """Loss of one triplet; average it for the batch."""
    gap = distance(metric)
    return F.greatest(gap(a, p) - gap(a, n) + F.lit(margin), F.lit(0.0))


def batch_hard_triplets(df: DataFrame, margin: float = 1.0) -> DataFrame:
    """Farthest positive and nearest negative of every row within its training batch.

    ``df`` is (batch, vec_id, embedding, label). A batch is small by construction (what fits one
    training step), so each is one Arrow group; only one row per anchor comes back, never the pairs.
    Rows without a positive or a negative have a null loss.
    """

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy())
        labels = pdf["label"].to_numpy()
        n = len(pdf)
        near, far, total = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)
        for i in range(n):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            same, other = labels == labels[i], labels != labels[i]
            same[i] = False
            total[i] = d.sum()
            if same.any():
                far[i] = d[same].max()
            if other.any():
                near[i] = d[other].min()
        return pd.DataFrame(
            {
                "batch": pdf["batch"], "vec_id": pdf["vec_id"], "n_others": n - 1,
                "distance_sum": total, "hardest_positive": far, "hardest_negative": near,
                "loss": np.maximum(far - near + margin, 0.0),
            }
        )

    schema = (
        "batch bigint, vec_id bigint, n_others bigint, distance_sum double, "
        "hardest_positive double, hardest_negative double, loss double"
    )
    found = df.select("batch", "vec_id", "embedding", "label").groupBy("batch").applyInPandas(per_batch, schema)
    for name in ("hardest_positive", "hardest_negative", "loss"):
        found = found.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return found
