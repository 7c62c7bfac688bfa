"""Choosing what to show next from a mean and an uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxworks.functions.seeded import seeded_key, seeded_normal

# Share of exploring picks at the start and after 100 batches.
EXPLORE_START, EXPLORE_END, EXPLORE_BATCHES = 0.7, 0.3, 100


def exploration_rate(batch_number: Column) -> Column:
    """Exponential decay; it keeps falling after the last planned batch."""
    decay = math.log(EXPLORE_END / EXPLORE_START) / EXPLORE_BATCHES
    return F.lit(EXPLORE_START) * F.exp(F.lit(decay) * batch_number)


def optimistic(mean: Column, uncertainty: Column) -> Column:
    return mean + F.lit(2.0) * uncertainty


def predicted_flag(probability: Column, threshold: Column) -> Column:
    return probability >= threshold


def reward(flag: Column, actual: Column) -> Column:
    return F.when(flag == actual, F.lit(1.0)).otherwise(F.lit(-1.0))


def thompson_sample(mean: Column, uncertainty: Column, id_col: Column, seed, draws: int = 10) -> Column:
    """Mean of normal draws around the score, each cut to [0, 1]."""
    total = F.lit(0.0)
    for d in range(draws):
        noisy = mean + uncertainty * seeded_normal(id_col, d, seed=seed)
        total = total + F.least(F.greatest(noisy, F.lit(0.0)), F.lit(1.0))
    return total / F.lit(float(draws))


def thompson(df: DataFrame, seed, draws: int = 10) -> DataFrame:
    """Add ``sampled`` to rows of (id, mean, uncertainty)."""
    return df.withColumn(
        "sampled", thompson_sample(F.col("mean"), F.col("uncertainty"), F.col("id"), seed, draws)
    )


def select_batch(df: DataFrame, batch_number: int, size: int = 20, random_count: int = 3, seed=0) -> DataFrame:
    """The next batch from (id, mean, uncertainty): explorers, then best bets, then strangers.

    Explorers are the least certain rows; their number falls with the batch number. Best bets have
    the highest optimistic score and fill the rest of the bandit's share. A row picked twice keeps
    its earlier place. Strangers are drawn at random from all rows not picked. Each of the three is
    a top-k, so no more than a few rows per task ever leave the scan.
    """
    bandit_size = size - random_count
    rate = EXPLORE_START * math.exp(math.log(EXPLORE_END / EXPLORE_START) / EXPLORE_BATCHES * batch_number)
    n_explore = int(size * rate)
    n_exploit = max(bandit_size - n_explore, 0)
    key = F.col("id")
    ids = df.select("id", "mean", "uncertainty")

    def ranked(top: DataFrame, *order: Column) -> DataFrame:
        # at most ``size`` rows: numbering them needs no partitioning
        packed = top.agg(F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))).alias("a"))
        return packed.select(F.posexplode("a").alias("place", "o")).select("place", F.col(f"o.o{len(order) - 1}").alias("id"))

    unsure = ids.orderBy(F.col("uncertainty").desc(), key).limit(n_explore)
    score = optimistic(F.col("mean"), F.col("uncertainty"))
    best = ids.orderBy(score.desc(), key).limit(n_exploit)
    explore = ranked(unsure, -F.col("uncertainty"), key)
    exploit = ranked(best, -score, key).withColumn("place", F.col("place") + n_explore)
    merged = explore.unionByName(exploit).groupBy("id").agg(F.min("place").alias("place"))
    picked = merged.orderBy("place").limit(bandit_size).withColumn(
        "source", F.when(F.col("place") < n_explore, F.lit("explore")).otherwise(F.lit("exploit"))
    )
    # Only picked rows can drop out, so the first random_count + bandit_size are enough to draw from.
    pool = ids.select("id").orderBy(seeded_key(key, seed=seed), key).limit(random_count + bandit_size)
    strangers = pool.join(picked, "id", "left_anti").orderBy(seeded_key(key, seed=seed), key).limit(random_count)
    drawn = ranked(strangers, seeded_key(key, seed=seed), key).select(
        "id", (F.col("place") + size).alias("place"), F.lit("random").alias("source")
    )
    return picked.unionByName(drawn)
