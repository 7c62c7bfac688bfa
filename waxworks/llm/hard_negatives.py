"""Hard-negative mining: Strassen products of integer tiles, merged into heaps of positives and of score windows."""

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

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a block. They bound a tile, and with it memory; no result depends on them.
BLOCK, ANCHOR_BLOCK = 4096, 512
LEAF = 16  # sides up to which Strassen's recursion pays no more
_HELD = 200_000  # entries of heaps that a task merges before it sends them on
_NONE = np.int64(-(1 << 63))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Exact product of int64 matrices by seven half-sized products; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    out = np.empty((2 * h, 2 * j), np.int64)
    c11, c12, c21, c22 = out[:h, :j], out[:h, j:], out[h:, :j], out[h:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


# ---------------------------------------------------------------- blocks


_PACKED = "block long, n int, dim int, longest double, ids binary, labels binary, vectors binary"
_FIELDS = [("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]


def _packer(rows: int):
    """Rows of a partition as matrices of ``rows`` lines, in order of their ids."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(tables):
            nonlocal count
            table = pa.Table.from_batches(tables).combine_chunks()
            ids = np.asarray(table.column("id"), np.int64)
            order = np.argsort(ids, kind="stable")
            vectors = table.column("v").combine_chunks()
            sizes = np.asarray(vectors.value_lengths())
            flat = np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE)
            if len(flat) and np.abs(flat).max() >= 2.0**62:
                raise OverflowError("a component is too large for exact scores")
            matrix = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
            row = np.repeat(np.arange(len(ids)), sizes)
            matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
            matrix = matrix[order]
            longest = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
            count += 1
            values = [(part << 32) + count, len(ids), matrix.shape[1], longest, ids[order].tobytes(), np.asarray(table.column("label"), np.int64)[order].tobytes(), matrix.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip((f for f, _ in _FIELDS), values))], pa.schema(_FIELDS))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, min(rows - size, batch.num_rows - at)))
                at, size = at + held[-1].num_rows, size + held[-1].num_rows
                if size == rows:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return packed


def _tile(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a block of anchors with a block of candidates, which candidates are the anchor's own, and which have its label."""
    ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["anchor_ids"], np.int64)
    a = np.frombuffer(row["anchor_vectors"], np.int64).reshape(len(own), row["anchor_dim"])
    b = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dim"])
    dim = min(a.shape[1], b.shape[1])  # a shorter vector counts as if it ended in zeros
    if row["longest"] * row["anchor_longest"] * 128 >= 2.0**63:
        raise OverflowError("scores may leave 64 bits")
    scores = strassen(a[:, :dim], np.ascontiguousarray(b[:, :dim].T)) if dim else np.zeros((len(own), len(ids)), np.int64)
    same = np.frombuffer(row["anchor_labels"], np.int64)[:, None] == np.frombuffer(row["labels"], np.int64)[None, :]
    return scores, own[:, None] == ids[None, :], same


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row; of equal ones those further left."""
    kept = np.where(allowed, scores, _NONE)
    if kept.shape[1] > k:  # what lies below each row's kth score goes; ties at it stay for now
        least = np.partition(kept, kept.shape[1] - k, axis=1)[:, -k]
        row, column = np.nonzero(allowed & (kept >= least[:, None]))
    else:
        row, column = np.nonzero(allowed)
    order = np.lexsort([column, -scores[row, column], row])
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


class _Heaps:
    """The ``k`` best (score, id) of each key, merged from tiles."""

    def __init__(self, k: int, names: tuple[str, ...]):
        self.k, self.names, self.parts, self.size = k, names, [], 0

    def add(self, *columns: np.ndarray):
        """Key columns, then score and id."""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > _HELD:
            self.merge()

    def merge(self):
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        keys, score, ids = columns[:-2], columns[-2], columns[-1]
        order = np.lexsort([ids, -score, *reversed(keys)])
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns[:-2]:
            new[1:] |= c[1:] != c[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        keep = np.arange(len(order)) - first < self.k
        self.parts = [tuple(c[keep] for c in columns)]
        self.size = int(keep.sum())

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.parts[0]], names=[*self.names, "score", "id"])
        self.parts, self.size = [], 0


def _positives(k: int):
    """Per anchor, the best candidates of its label that the task has seen."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = _Heaps(k, ("anchor_block", "place", "anchor_id"))
        for batch in batches:
            for row in batch.to_pylist():
                scores, own, same = _tile(row)
                r, c = _best(scores, same & ~own, k)
                asked = np.frombuffer(row["anchor_ids"], np.int64)
                heaps.add(np.full(len(r), row["anchor_block"]), r.astype(np.int64), asked[r], scores[r, c], np.frombuffer(row["ids"], np.int64)[c])
                if heaps.size > _HELD:  # no smaller when merged
                    yield from heaps.take()
        yield from heaps.take()

    return found


def _negatives(k: int, low: int, high: int):
    """Per anchor and window, the best candidates of other labels inside the window."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = _Heaps(k, ("anchor_block", "place", "of"))
        for batch in batches:
            for row in batch.to_pylist():
                places = np.array(row["places"], np.int64)
                if not len(places):
                    continue
                scores, _, same = _tile(row)
                ids, numbers, goals = np.frombuffer(row["ids"], np.int64), np.array(row["numbers"], np.int64), np.array(row["goals"], np.int64)
                # 50 p <= 100 s <= 95 p in whole numbers, without products that could leave 64 bits
                least, most = -((-low * goals.astype(object)) // 100), (high * goals.astype(object)) // 100
                least, most = least.astype(np.int64), most.astype(np.int64)
                for n in np.unique(numbers).tolist():
                    at = np.flatnonzero(numbers == n)
                    part, apart = scores[places[at]], ~same[places[at]]
                    r, c = _best(part, apart & (part >= least[at, None]) & (part <= most[at, None]), k)
                    heaps.add(np.full(len(r), row["anchor_block"]), places[at][r], np.full(len(r), n), part[r, c], ids[c])
                if heaps.size > _HELD:
                    yield from heaps.take()
        yield from heaps.take()

    return found


# ---------------------------------------------------------------- mining


def mine(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hardest negatives.

    Components become whole numbers, floor(256 x); a score is the integer inner product with the anchor,
    and higher scores come first, ties by smaller key. An anchor's positives are its ``positives`` best
    other rows of the same label; for each of them the ``negatives`` best rows of another label whose
    score lies between ``low`` and ``high`` hundredths of the positive's.

    Blocks of anchors meet blocks of all rows. Each tile is one product by Strassen's recursion on int64,
    exact by construction; heaps of each anchor's best are merged inside a task, and once more over
    tasks. The second pass does the same with a heap for each (anchor, positive) window. Scores never
    leave a task.

    Rows with a null key, label or vector, or with null or non-finite components, take no part. Rows
    with an anchor's key are not its partners; a key in several anchor rows mines for each of them, and
    repeated partner rows are partners each. Vectors of different lengths are compared as if the shorter
    ended in zeros. Fewer rows than asked for are all returned; no anchors, or no other rows, give no
    rows, and neither does a positive with a negative score, whose window is empty. Other columns have no
    effect. Scores that could leave 64 bits raise an error.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    plain = df.select(
        df[key].cast("bigint").alias("id"), df[label].cast("bigint").alias("label"), df[vector].cast("array<double>").alias("v"), is_anchor.alias("asked")
    )
    rows = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", finite))
    candidates = stable(rows.select("id", "label", "v").mapInArrow(_packer(BLOCK), _PACKED))
    anchors = rows.filter("asked").select("id", "label", "v").mapInArrow(_packer(ANCHOR_BLOCK), _PACKED)
    anchors = stable(anchors.select(*[F.col(c).alias(f"anchor_{c}") for c, _ in _FIELDS]))

    kinds = "anchor_block long, place long, {} long, score long, id long"
    found = candidates.crossJoin(anchors).mapInArrow(_positives(positives), kinds.format("anchor_id"))
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    pairs = found.withColumn("of", F.row_number().over(order("anchor_block", "place")).cast("bigint")).filter(F.col("of") <= positives)
    pairs = stable(pairs.select("anchor_block", "place", "of", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    sent = pairs.filter("positive_score >= 0").groupBy("anchor_block").agg(F.collect_list(F.struct("place", "of", "positive_score")).alias("w"))
    windows = [F.col(f"w.{a}").alias(b) for a, b in (("place", "places"), ("of", "numbers"), ("positive_score", "goals"))]
    asked = anchors.join(sent.select("anchor_block", *windows), "anchor_block")  # at most ANCHOR_BLOCK * positives windows each
    found = candidates.crossJoin(asked).mapInArrow(_negatives(negatives, low, high), kinds.format("of"))
    best = found.withColumn("rank", F.row_number().over(order("anchor_block", "place", "of"))).filter(F.col("rank") <= negatives)
    out = best.join(pairs, ["anchor_block", "place", "of"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""


@query("op11_hard_negatives", _SQL)
def op11(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine(rows, F.col("vec_id") % 50 == 0)
