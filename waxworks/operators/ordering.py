"""Order, position, sampling and top-k that hold up when one group or key is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxworks.functions.seeded import seeded_key
from waxworks.operators.joins import join_checked
from waxworks.session import stable

_LOW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in these bits


def row_index(df: DataFrame, *order: Column, name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of every row in a total order.

    A window without a partition would pull all rows into one task. Here Spark range-sorts the rows,
    each partition numbers its own, and the only thing gathered is one row count per partition.
    The sorted rows are checkpointed first: range bounds come from a sample, and a recomputed
    partition must keep the rows its numbers were given to.
    """
    placed = stable(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_slot"), _LOW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    # One row per partition of the sort, so the broadcast does not grow with the data.
    joined = placed.join(F.broadcast(starts), part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_start") + local).cast("bigint").alias(name))


def group_rank(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank inside each group, without gathering a group in one task.

    Position in the order (group, order) minus the position of the group's first row.
    """
    placed = row_index(df, *[F.col(c) for c in by], *order, name="_pos")
    firsts = placed.groupBy(*by).agg(F.min("_pos").alias("_first"))
    return join_checked(placed, firsts, by).select(
        *df.columns, (F.col("_pos") - F.col("_first") + 1).alias(name)
    )


def top_k_per_group(df: DataFrame, by: list[str], *order: Column, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group.

    Filtering a row_number by a literal lets Spark cut each group to ``k`` rows in every map task
    before the shuffle (WindowGroupLimit), so a hot group arrives as a few short runs.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def keep_first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in a total order (``dropDuplicates`` would keep any)."""
    return top_k_per_group(df, by, *order, k=1, name="_first").drop("_first")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed) -> DataFrame:
    """``n`` rows at random, the same ones for the same seed."""
    return df.orderBy(seeded_key(F.col(id_col), seed=seed), F.col(id_col)).limit(n)


def add_pages(df: DataFrame, *order: Column, size: int) -> DataFrame:
    """Page number, page count and neighbours for every row of an ordered list."""
    placed = row_index(df, *order)
    total = placed.agg(F.ceil(F.count("*") / F.lit(size)).cast("bigint").alias("total_pages"))
    page = F.floor(F.col("row_idx") / F.lit(size)).cast("bigint")
    paged = placed.crossJoin(total).withColumn("page", page)  # one-row right side
    return paged.withColumn("has_next", F.col("page") < F.col("total_pages") - 1).withColumn(
        "has_previous", F.col("page") > 0
    )


def split_by_position(df: DataFrame, *order: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> DataFrame:
    """Label rows by where they fall in an ascending order: cut points are whole rows of a share of n.

    Only the order keys are sorted. The key at each cut is looked up, and the rows, however wide, are
    compared with those few keys where they lie. Rows with equal keys go to the same part, and nulls,
    which come first, to the first.
    """
    keys = df.select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("_key"))
    placed = row_index(keys, F.col("_key"), name="_at")
    total = placed.agg(F.count("*").alias("_total"))
    at_cut = [(F.floor(F.col("_total") * F.lit(c)) == F.col("_at")) for c in cuts]
    found = placed.crossJoin(F.broadcast(total)).agg(  # one row
        *[F.min(F.when(hit, F.col("_key"))).alias(f"_cut{i}") for i, hit in enumerate(at_cut)]
    )
    tagged = df.crossJoin(F.broadcast(found))  # one row
    own = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    part = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[: len(cuts)]))):
        cut = F.col(f"_cut{i}")
        part = F.when(cut.isNull() | (own < cut), F.lit(name)).otherwise(part)
    return tagged.withColumn("split", part).drop(*[f"_cut{i}" for i in range(len(cuts))])
