"""Packing of sequences into length buckets that waste least, and of buckets into batches of a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxworks.llm.registry import query
from waxworks.operators.ordering import row_index

#: Tokens of the longest sequence, of a batch with its padding, and of the step in which buckets may end.
LONGEST, BUDGET, STEP = 8192, 65_536, 8
BUCKETS = 16


def best_boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """The steps at which at most ``buckets`` buckets end, so that the padding of all is least.

    ``counts[u]`` sequences are u + 1 steps long; each is padded to the end of its bucket. Dynamic
    programming over ends: the best way to cover the first j lengths with one bucket more is the best over
    the place i where that bucket begins. Of equal ways the one with fewer buckets, then with later
    beginnings, is taken.
    """
    n = len(counts)
    used = np.flatnonzero(counts)
    if not len(used):
        return []
    n = int(used[-1]) + 1
    rows = np.concatenate([[0], np.cumsum(counts[:n])]).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    froms, totals = [], []
    for _ in range(min(buckets, n)):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * j
            at[j] = j - 1 - int(np.argmin(cost[::-1]))
            new[j] = cost[at[j]]
        froms.append(at)
        totals.append(new[n])
        best = new
    k = int(np.argmin(totals))
    ends, j = [], n
    for level in range(k, -1, -1):
        ends.append(j)
        j = int(froms[level][j])
    return ends[::-1]


def pack(df: DataFrame, tokens: Column | None = None, key: str = "doc_id", text: str = "text", longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS, step: int = STEP) -> DataFrame:
    """One row for each sequence: key, part, start, length, bucket, padded, batch and place.

    A row of more than ``longest`` tokens is cut into parts of that length and a rest, so nothing is left
    out. One histogram of all lengths, of a size that ``longest`` and ``step`` fix, reaches the driver;
    dynamic programming finds the bucket ends with least padding. In a bucket of ``padded`` tokens, in the
    order of a hash, each ``budget // padded`` sequences (one at least) form a batch; only the last batch
    of a bucket may be shorter. Sequences are numbered by a range sort, so no bucket meets in one task.

    Tokens are the UTF-8 bytes of the text unless ``tokens`` gives their number. A null or empty text is
    one sequence of no tokens in the first bucket; repeated rows and null keys are sequences of their own;
    an empty table gives an empty one. Other columns are left out.
    """
    size = tokens if tokens is not None else F.octet_length(F.coalesce(df[text].cast("string"), F.lit("")))
    rows = df.select(df[key].alias("_key"), F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).cast("bigint").alias("size"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / longest) - 1).cast("bigint")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    rows = rows.withColumn("start", F.col("part") * longest)
    rows = rows.withColumn("length", F.least(F.lit(longest).cast("bigint"), F.col("size") - F.col("start"))).drop("size")
    rows = rows.withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("length") / step)).cast("int"))
    counts = np.zeros(-(-longest // step), np.int64)
    for steps, n in rows.groupBy("steps").count().collect():  # one row for each step at most
        counts[steps - 1] = n
    ends = best_boundaries(counts, buckets)
    bucket = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        bucket = F.when(F.col("steps") <= ends[i], i).otherwise(bucket)
    padded = F.get(F.array(*[F.lit(e * step) for e in ends]) if ends else F.array(F.lit(0)), F.col("bucket"))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("padded", padded.cast("bigint")).drop("steps")
    rows = rows.withColumn("_draw", F.xxhash64(F.col("_key").cast("string"), "part")).withColumn("_tie", F.rand(11))
    placed = row_index(rows, *[F.col(c) for c in ("bucket", "_draw", "_key", "part", "length", "_tie")], name="_pos")
    firsts = placed.groupBy("bucket").agg(F.min("_pos").alias("_first"))
    at, full = F.col("_pos") - F.col("_first"), F.greatest(F.lit(1), F.floor(budget / F.col("padded"))).cast("bigint")
    return placed.join(F.broadcast(firsts), "bucket").select(  # one row per bucket
        F.col("_key").alias(key), "part", "start", "length", "bucket", "padded", F.floor(at / full).cast("bigint").alias("batch"), (at % full).alias("place"),
    )


def with_bytes(packed: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed rows with ``tokens`` (binary): the bytes of each sequence, when tokens are bytes and keys are unique."""
    texts = df.select(key, F.coalesce(df[text].cast("string"), F.lit("")).cast("binary").alias("_bytes"))
    cut = F.substring(F.col("_bytes"), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    return packed.join(texts, key).withColumn("tokens", cut).drop("_bytes")


@query("op6_length_buckets")
def op6(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
