"""Exact top-k search by refining histograms of all scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waxworks.llm.registry import query
from waxworks.session import stable

SCALE, K, BINS = 64, 20, 256
#: Rows of a block of vectors. A block of scores is the product; they bound memory only.
BLOCK, QUERY_BLOCK = 4096, 1024

_PACKED = "block long, n int, dim int, longest double, ids binary, vectors binary"


def _packer(rows: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []

        def block():
            nonlocal count
            dim = max(len(v) for _, v in held)
            matrix = np.zeros((len(held), dim))
            for i, (_, v) in enumerate(held):
                matrix[i, : len(v)] = v
            ids = np.array([i for i, _ in held], np.int64)
            longest = float(np.sqrt((matrix**2).sum(axis=1).max())) if dim else 0.0
            out = pa.RecordBatch.from_pylist(
                [{"block": (part << 32) + count, "n": len(held), "dim": dim, "longest": longest,
                  "ids": ids.tobytes(), "vectors": matrix.tobytes()}],
                pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("longest", pa.float64()),
                           ("ids", pa.binary()), ("vectors", pa.binary())]),
            )
            count += 1
            held.clear()
            return out

        for batch in batches:
            vectors = batch.column(1)
            flat = np.floor(np.asarray(vectors.flatten().cast(pa.float64()), np.float64) * SCALE)
            sizes = np.asarray(vectors.value_lengths().fill_null(0))
            ends = np.cumsum(sizes)
            for i, known in enumerate(batch.column(0).to_pylist()):
                vector = flat[ends[i] - sizes[i] : ends[i]]
                if known is not None and vectors[i].is_valid and np.isfinite(vector).all():
                    held.append((known, vector))
                    if len(held) == rows:
                        yield block()
        if held:
            yield block()

    return packed


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of a block of queries with a block of candidates; a query's own place holds -inf."""
    ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
    a = np.frombuffer(row["query_vectors"]).reshape(len(own), row["query_dim"])
    b = np.frombuffer(row["vectors"]).reshape(len(ids), row["dim"])
    dim = min(a.shape[1], b.shape[1])  # a shorter vector counts as if it ended in zeros
    a, b = a[:, :dim], b[:, :dim]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    if bound >= 2.0**53:
        raise OverflowError("scores may exceed 2**53")
    kind = np.float32 if bound < 2.0**24 else np.float64  # whole numbers, so both are exact
    scores = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    scores[own[:, None] == ids[None, :]] = -np.inf
    return scores, ids


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array(row["lows"], np.float64), np.array(row["widths"], np.float64), np.array(row["needs"], np.int64))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores inside each query's range, counted by bin."""
    for batch in batches:
        for row in batch.to_pylist():
            scores, _ = _scores(row)
            lows, widths, _ = _arrays(row)
            step = np.ceil(widths / BINS)
            at = np.floor((scores - lows[:, None]) / step[:, None])
            at[(scores < lows[:, None]) | (scores >= (lows + widths)[:, None])] = -1
            at += np.arange(len(lows))[:, None] * (BINS + 1) + 1  # bin -1 of each query comes first
            counts = np.bincount(at.astype(np.int64).ravel(), minlength=len(lows) * (BINS + 1)).reshape(-1, BINS + 1)[:, 1:]
            q, found = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), row["query_block"])), pa.array(q.astype(np.int32)), pa.array(found.astype(np.int32)), pa.array(counts[q, found])],
                names=["query_block", "q", "bin", "n"],
            )


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores above each query's kth value, and of those equal to it as many of the smallest ids as are needed."""
    for batch in batches:
        for row in batch.to_pylist():
            scores, ids = _scores(row)
            lows, _, needs = _arrays(row)
            order = np.argsort(ids, kind="stable")
            scores, ids = scores[:, order], ids[order]
            tied = scores == lows[:, None]
            take = (scores > lows[:, None]) | (tied & (np.cumsum(tied, axis=1) <= needs[:, None]))
            q, c = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), row["query_block"])), pa.array(q.astype(np.int32)), pa.array(np.frombuffer(row["query_ids"], np.int64)[q]), pa.array(ids[c]), pa.array(scores[q, c].astype(np.int64))],
                names=["query_block", "q", "query_id", "vec_id", "score"],
            )


def exact_topk(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with all rows but its own, ties to smaller ids.

    Vectors become whole numbers, floor(64 x). Blocks of queries meet blocks of candidates. Each pass
    scores everything and counts scores in 256 bins of each query's range; the bin in which its kth value
    falls is the next range, until that is one value wide. A last pass takes what lies above that value
    and the smallest ids at it, at most ``k`` rows of each block of candidates. Scores are never stored.

    Rows with a null id, a null vector, or null or non-finite components take no part. Vectors of
    different lengths are compared as if the shorter ended in zeros. Rows with an id equal to the query's
    count as its own; other repeated rows are candidates each, and an id in several query rows gets the
    results of each of them. Fewer than ``k`` candidates are all
    returned; no candidates or queries give no rows. Other columns are ignored. Scores from 2**53 on
    raise an error.
    """
    rows = df.select(df[key].cast("bigint").alias("id"), df[vector].cast("array<double>").alias("v"))
    asked = df.filter(is_query).select(df[key].cast("bigint").alias("id"), df[vector].cast("array<double>").alias("v"))
    candidates = stable(rows.mapInArrow(_packer(BLOCK), _PACKED))
    queries = stable(asked.mapInArrow(_packer(QUERY_BLOCK), _PACKED).select(
        F.col("block").alias("query_block"), F.col("n").alias("query_n"), F.col("dim").alias("query_dim"),
        F.col("longest").alias("query_longest"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"),
    ))
    bound = F.ceil(F.col("query_longest") * F.col("longest")) + 1  # Cauchy-Schwarz
    longest = candidates.agg(F.coalesce(F.max("longest"), F.lit(0.0)).alias("longest"))
    state = queries.crossJoin(F.broadcast(longest)).select(  # one row
        "query_block", F.explode(F.sequence(F.lit(0), F.col("query_n") - 1)).alias("q"),
        (-bound).cast("double").alias("low"), (2 * bound + 1).cast("double").alias("width"), F.lit(k).cast("bigint").alias("need"),
    )
    state = stable(state)

    def blocks():
        sent = state.groupBy("query_block").agg(F.sort_array(F.collect_list(F.struct("q", "low", "width", "need"))).alias("s"))
        arrays = [F.col(f"s.{a}").alias(b) for a, b in (("low", "lows"), ("width", "widths"), ("need", "needs"))]
        return candidates.crossJoin(queries.join(sent.select("query_block", *arrays), "query_block"))

    while (state.agg(F.max("width")).first()[0] or 1) > 1:
        counts = blocks().mapInArrow(_histograms, "query_block long, q int, bin int, n long")
        counts = counts.groupBy("query_block", "q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_block", "q").orderBy(F.desc("bin"))  # at most BINS rows each
        found = counts.withColumn("upto", F.sum("n").over(down)).join(state, ["query_block", "q"])
        found = found.filter("upto >= need and upto - n < need")
        step = F.ceil(F.col("width") / BINS).cast("double")
        found = found.select("query_block", "q", (F.col("low") + F.col("bin") * step).alias("low2"), step.alias("width2"), (F.col("need") - F.col("upto") + F.col("n")).alias("need2"))
        state = stable(state.join(found, ["query_block", "q"], "left").select(
            "query_block", "q",  # no bin reaches k: every candidate is wanted
            F.coalesce("low2", F.col("low") - 1).alias("low"), F.coalesce("width2", F.lit(1.0)).alias("width"), F.coalesce("need2", "need").alias("need"),
        ))
    best = blocks().mapInArrow(_chosen, "query_block long, q int, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_block", "q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH w AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_exact_topk", _SQL)
def op9(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(rows, F.col("vec_id") % 20 == 0)
