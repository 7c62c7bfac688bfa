"""Stable shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from waxworks.llm.registry import query
from waxworks.operators.ordering import row_index

SHARDS = 40
ROW_BYTES = 16  # what a row takes besides its text


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. With one more shard a key stays, or moves to the new one."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    place = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        shard[moving] = place[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[moving] >> np.uint64(33)).astype(np.float64) + 1
        place[moving] = ((shard[moving] + 1) * (float(1 << 31) / step)).astype(np.int64)
        moving = moving[place[moving] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a column's value, from its text form; null counts as an empty text."""

    @pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64).view(np.uint64), shards))

    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return place(F.conv(digits, 16, 10).cast("bigint"))


def assign_shards(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is ``key``: key and number of shards alone decide, so equal texts under different keys
    spread, and ``grown_shard`` (with one shard more) differs from ``shard`` only where it is the new
    one. ``slot`` numbers the rows of a shard from 0 in order of key, size and checksum: rows are range-
    sorted over (shard, key), so no task holds a shard, and only one count per partition is gathered.

    Null keys go to one shard, that of an empty text; a null or empty text has size 16 and checksum 0;
    repeated rows go to the same shard and get slots of their own (equal rows are interchangeable, and a
    seeded draw splits a key that holds many of them); an empty table gives an empty one. Other columns
    don't matter and are left out.
    """
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(
        df[key].alias("_key"), (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(df[key], shards).alias("shard"), shard_of(df[key], shards + 1).alias("grown_shard"),
    ).withColumn("_draw", F.rand(7))
    order = [F.col(c) for c in ("shard", "_key", "size", "text_crc32", "_draw")]
    placed = row_index(rows, *order, name="_pos")
    firsts = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_pos") - F.col("_first")).alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write the rows of ``df`` below ``path``, one folder ``shard=N`` for each shard. A shard may have several files."""
    df.withColumn("shard", shard_of(df[key], shards)).write.partitionBy("shard").parquet(path)


@query("op7_jump_sharding")
def op7(spark, sf_dir):
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
