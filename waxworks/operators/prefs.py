"""Learning scoring weights from rankings of any length.

An item meets every other of its ranking, but no pair is made. Let p be an item's rank by position and r its
rank by score, of n. Contradicting pairs are those with p < p' and r < r'. An item is the better one of
``after`` of them and the worse one of ``before``, and (n - 1 - r) - after = p - before, both being the earlier
items of a higher score. So the sum of differences over all contradicting pairs is the sum of
x (after - before) = x (n - 1 - p - r), which needs the two ranks only. Their number, the sum of ``before``, is
counted as merge sort would: inside blocks of positions, then between blocks of ever larger nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waxworks.operators.joins import join_checked
from waxworks.operators.ordering import group_rank
from waxworks.operators.stock import DEFAULT_WEIGHTS
from waxworks.session import stable

AXES = tuple(DEFAULT_WEIGHTS)
STEP = 0.1
BLOCK = 16384  # items of a ranking that one task orders at once
FAN = 16  # blocks, or nodes, that a node joins


def usable_rankings(rankings: DataFrame) -> DataFrame:
    """Rankings of at least two items, all of them known; ``_n`` is their number.

    Rows without a session or a position belong to no ranking.
    """
    whole = F.lit(True)
    for axis in AXES:
        whole = whole & F.col(axis).isNotNull()
    placed = rankings.filter("session_id is not null and pos is not null")
    sizes = placed.groupBy("session_id").agg(F.count("*").alias("_n"), F.min(whole.cast("int")).alias("_known"))
    good = sizes.filter((F.col("_n") >= 2) & (F.col("_known") == 1))
    return join_checked(placed, good.select("session_id", "_n"), ["session_id"])


def _scored(rankings: DataFrame, weights: dict[str, float]) -> DataFrame:
    score = sum((F.lit(weights[a]) * F.col(a) for a in AXES[1:]), F.lit(weights[AXES[0]]) * F.col(AXES[0]))
    return rankings.withColumn("score", score)


def violations(rankings: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Pairs of a ranking whose scores contradict their order, with the difference on each axis.

    ``rankings`` is (session_id, pos, embedding, price_diff, demand). The result is the pairs themselves, so it
    may grow with the square of a ranking; :func:`tune_weights` does without them.
    """
    scored = _scored(rankings, weights).select("session_id", "pos", *AXES, "score")
    left, right = scored.alias("i"), scored.alias("j")
    against = (
        (F.col("i.session_id") == F.col("j.session_id"))
        & (F.col("i.pos") < F.col("j.pos"))
        & (F.col("i.score") < F.col("j.score"))
    )
    gaps = [(F.col(f"i.{a}") - F.col(f"j.{a}")).alias(a) for a in AXES]
    return left.join(right, against).select(
        F.col("i.session_id").alias("session_id"), F.col("i.pos").alias("better"), F.col("j.pos").alias("worse"), *gaps
    )


def earlier_and_less(values: np.ndarray) -> np.ndarray:
    """For each place of a permutation the number of earlier places with a smaller value.

    Places in order of value are dealt into halves, quarters and so on; in each node the left places seen so
    far count for a right one.
    """
    at = np.empty(len(values), np.int64)
    at[values] = np.arange(len(values))
    found = np.zeros(len(values), np.int64)
    for bit in reversed(range(max(len(values) - 1, 0).bit_length())):
        node = at >> (bit + 1)
        left = ((at >> bit) & 1) == 0
        seen = np.cumsum(left)
        first = np.searchsorted(node, node)
        right = ~left
        found[at[right]] += (seen - seen[first] + left[first])[right]
        at = at[np.argsort(at >> bit, kind="stable")]
    return found


def _count_block(group: pd.DataFrame) -> pd.DataFrame:
    """Contradicting pairs inside each ranking of a group, by its ranks."""
    codes, names = pd.factorize(group["session_id"])
    by_place = np.lexsort([group["_p"].to_numpy(), codes])
    # Rankings are in opposite orders in the two sorts, so that no pair of two rankings counts.
    by_score = np.lexsort([group["_r"].to_numpy(), -codes])
    rank = np.empty(len(group), np.int64)
    rank[by_score] = np.arange(len(group))
    found = np.zeros(len(names), np.int64)
    np.add.at(found, codes[by_place], earlier_and_less(rank[by_place]))
    return pd.DataFrame({"session_id": names, "found": found})


def _ranked(scored: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rankings of at most ``block`` items, and the longer ones, with 0-based ranks ``_p`` and ``_r``.

    Equal positions lie by falling score and equal scores by falling place, so that neither makes a pair.
    """
    by_place, by_score = (F.col("pos"), F.col("score").desc()), (F.col("score"), F.col("_p").desc())
    within = Window.partitionBy("session_id")
    short = scored.filter(F.col("_n") <= block).withColumn("_p", F.row_number().over(within.orderBy(*by_place)) - 1)
    short = short.withColumn("_r", F.row_number().over(within.orderBy(*by_score)) - 1)
    long = group_rank(scored.filter(F.col("_n") > block), ["session_id"], *by_place, name="_p")
    long = group_rank(long.withColumn("_p", F.col("_p") - 1), ["session_id"], *by_score, name="_r")
    return short, long.withColumn("_r", F.col("_r") - 1)


def _across_blocks(ranked: DataFrame, level: int, block: int, fan: int) -> DataFrame:
    """(session_id, found): contradicting pairs between the children of the nodes of a level.

    The rows of a node lie in buckets of ``block`` by rank of score; a row meets what lower buckets and lower
    rows of its own hold in earlier children. Only counts by bucket and child meet for a whole node.
    """
    span = block * fan**level
    nodes = ranked.select(
        "session_id", "_r",
        F.expr(f"_p div {span * fan}").alias("_node"), F.expr(f"cast((_p div {span}) % {fan} as int)").alias("_child"),
    )
    placed = group_rank(nodes, ["session_id", "_node"], F.col("_r"), name="_at")
    placed = placed.withColumn("_bucket", F.expr(f"(_at - 1) div {block}"))
    key = ["session_id", "_node", "_bucket"]
    counts = placed.groupBy(*key).agg(*[F.sum((F.col("_child") == c).cast("bigint")).alias(f"n{c}") for c in range(fan)])
    lower = Window.partitionBy("session_id", "_node").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.select(*key, *[F.coalesce(F.sum(f"n{c}").over(lower), F.lit(0)).alias(f"b{c}") for c in range(fan)])
    seen = Window.partitionBy(*key).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select(*key, "_child", *[F.sum((F.col("_child") == c).cast("bigint")).over(seen).alias(f"s{c}") for c in range(fan)])
    met = F.lit(0).cast("bigint")
    for c in range(fan - 1):
        met = met + F.when(F.col("_child") > c, F.col(f"b{c}") + F.col(f"s{c}")).otherwise(0)
    return join_checked(running, below, key).groupBy("session_id").agg(F.sum(met).alias("found"))


def ranking_sums(rankings: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(session_id, total_pairs, violations, and the sum of differences over them on each axis) of usable rankings.

    Equal positions and equal scores contradict nothing. A ranking of any length is split: it passes through
    tasks in blocks of ``block`` items. Rankings of up to that length are counted in bundles of about as many
    rows. An empty table gives an empty one.
    """
    scored = stable(_scored(usable_rankings(rankings), weights).select("session_id", "pos", "_n", *AXES, "score"))
    rows, longest = scored.agg(F.count("*"), F.max("_n")).first()
    short, long = _ranked(scored, block)
    ranked = short.withColumn("_block", F.lit(0).cast("bigint"))
    if rows and longest > block:
        long = stable(long)
        ranked = ranked.unionByName(long.withColumn("_block", F.expr(f"_p div {block}")))
    turn = F.col("_n") - 1 - F.col("_p") - F.col("_r")
    sums = ranked.groupBy("session_id").agg(
        F.expr("max(_n * (_n - 1) div 2)").alias("total_pairs"), *[F.sum(F.col(a) * turn).alias(a) for a in AXES]
    )
    bundles = max(1, -(-rows // block))
    dealt = ranked.select("session_id", "_p", "_r", "_block", F.pmod(F.xxhash64("session_id"), F.lit(bundles)).alias("_bundle"))
    name_type = scored.schema["session_id"].dataType.simpleString()
    found = dealt.groupBy("_bundle", "_block").applyInPandas(_count_block, f"session_id {name_type}, found bigint")
    level = 0
    while rows and longest > block * fan**level:
        found = found.unionByName(_across_blocks(long, level, block, fan))
        level += 1
    total = found.groupBy("session_id").agg(F.sum("found").alias("violations"))
    return sums.join(total, "session_id").select("session_id", "total_pairs", "violations", *AXES)


def tune_weights(rankings: DataFrame, weights: dict[str, float] = DEFAULT_WEIGHTS, step: float = STEP, overall: bool = False, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Weights after one step towards each ranking, or towards all of them together.

    A step adds the mean difference over contradicting pairs, cuts at zero and scales to sum 1.
    Without a contradiction the weights stay.
    """
    key = [] if overall else ["session_id"]
    joined = ranking_sums(rankings, weights, block, fan)
    if overall:
        joined = joined.agg(*[F.sum(c).alias(c) for c in ("total_pairs", "violations", *AXES)])
    found = F.coalesce("violations", F.lit(0))
    gap = {a: F.when(found > 0, F.col(a) / found).otherwise(0.0) for a in AXES}
    moved = {a: F.greatest(F.lit(weights[a]) + F.lit(step) * gap[a], F.lit(0.0)) for a in AXES}
    total = moved[AXES[0]] + moved[AXES[1]] + moved[AXES[2]]
    scaled = {
        a: F.when(found == 0, F.lit(weights[a])).otherwise(F.when(total > 0, moved[a] / total).otherwise(moved[a]))
        for a in AXES
    }
    return joined.select(*key, *[scaled[a].alias(f"w_{a}") for a in AXES], found.alias("violations"), "total_pairs")
