"""Joining a large frame to one that is usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from waxworks.session import stable

REPLICATE_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table that has fewer splits than there are cores.

    A table of any size has more splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _bytes(df: DataFrame) -> Column:
    """About what a row takes in memory."""
    size = F.lit(16)
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif not isinstance(field.dataType, AtomicType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + 8
    return size


def replicated_if_small(side: DataFrame, limit: int = REPLICATE_BYTES) -> DataFrame:
    """``side``, computed once, measured, and marked for broadcast if its rows take at most ``limit`` bytes."""
    kept = stable(side)
    taken = kept.agg(F.coalesce(F.sum(_bytes(kept).cast("bigint")), F.lit(0))).first()[0]
    return F.broadcast(kept) if taken <= limit else kept


def join_checked(large: DataFrame, side: DataFrame, on: list[str], how: str = "inner", limit: int = REPLICATE_BYTES) -> DataFrame:
    """Join that moves ``side`` to ``large`` if it has at most ``limit`` bytes, and shuffles otherwise.

    The side is kept, so measuring it costs one pass over it. An adaptive plan would find out just as
    well, but only after it had shuffled the large frame.
    """
    return large.join(replicated_if_small(side, limit), on, how)
