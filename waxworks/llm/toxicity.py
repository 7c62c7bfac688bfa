"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.registry import query

#: Labelled rows of each label that the classifier is fitted on: those with the smallest hash of their key.
SAMPLE_ROWS = 2000
LENGTHS = (3, 4, 5, 6, 7)
FEATURES, ALPHA, PENALTY, STEPS = 4096, 1.0, 0.02, 200
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
_BUCKETS = 22

Model = dict


def _grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length, the hashes of all n-grams and the place of each. None crosses a row."""
    up, down = tb.scales(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(tb.BYTE[buf] * up[:-1], out=sums[1:])
    row_end = np.zeros(len(buf), np.int64)
    full = ends > starts
    row_end[starts[full]] = np.diff(np.concatenate([[0], ends[full]]))
    row_end = np.cumsum(row_end)
    for n in LENGTHS:
        size = max(0, len(buf) - n + 1)
        inside = np.flatnonzero(np.arange(n, n + size) <= row_end[:size])
        hashes = (sums[n : n + size] - sums[:size]) * down[:size]
        yield hashes[inside] * np.uint64(2 * n + 0x9E3779B97F4A7C15 | 1), inside


def _present(text: str) -> np.ndarray:
    """Hashes of the distinct n-grams of a text."""
    buf = np.frombuffer(text.encode(), np.uint8)
    out = [h for h, _ in _grams(buf, np.array([0]), np.array([len(buf)]))] if len(buf) else []
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _train(texts: list[str], toxic: np.ndarray) -> Model:
    """Hashes and weights of the chosen n-grams, and a constant."""
    grams = [_present(t) for t in texts]
    bucket = lambda h: (h >> np.uint64(64 - _BUCKETS)).astype(np.int64)
    counts = np.zeros((2, 1 << _BUCKETS), np.float32)
    for h, y in zip(grams, toxic.tolist()):
        counts[y, bucket(h)] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], np.float64)
    ratio = np.log((counts[1] + ALPHA) / (n[1] + 2 * ALPHA)) - np.log((counts[0] + ALPHA) / (n[0] + 2 * ALPHA))
    # Likelihood gain of knowing whether an n-gram of the bucket is present.
    seen = counts.sum(axis=0)
    gain = np.where(seen >= 5, np.abs(counts[1] / max(n[1], 1) - counts[0] / max(n[0], 1)) / np.sqrt(np.maximum(seen, 1)), 0)
    top = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = np.zeros(1 << _BUCKETS, bool)
    chosen[top[gain[top] > 0]] = True
    hashes = np.unique(np.concatenate([h[chosen[bucket(h)]] for h in grams])) if grams else np.empty(0, np.uint64)
    x = np.zeros((len(texts), len(hashes)), np.float32)
    for i, h in enumerate(grams):
        x[i, np.searchsorted(hashes, h[chosen[bucket(h)]])] = 1
    scale = ratio[bucket(hashes)].astype(np.float32)
    x *= scale
    weights, constant = _logistic(x, toxic)
    return {"hashes": hashes, "weights": (weights * scale).astype(np.float64), "constant": constant}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a logistic model with a quadratic penalty, by accelerated gradient descent."""
    n, d = x.shape
    each = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(np.float32)
    probe = np.ones(d, np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.T @ (each * (x @ probe))
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    rate = 1.0 / (0.25 * (norm + 1.0) + PENALTY)
    w, b, last, last_b = np.zeros(d, np.float32), 0.0, np.zeros(d, np.float32), 0.0
    for t in range(1, STEPS + 1):
        push = (t - 1) / (t + 2)
        v, c = w + push * (w - last), b + push * (b - last_b)
        error = each * (1 / (1 + np.exp(-(x @ v + c))) - y)
        last, last_b = w, b
        w, b = v - rate * (x.T @ error + PENALTY / n * v), c - rate * float(error.sum())
    return w, b


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the rows of ``df`` whose key has a label of 0 or 1 in ``labels``.

    At most ``SAMPLE_ROWS`` rows of each label are used; they are chosen among keys and labels alone, and
    only their texts leave the tasks that read them. N-grams of 3 to 7 bytes of the lower-cased text count
    once per text. The most telling ones are kept; the column of each is multiplied by its log-count
    ratio, and a logistic model is fitted on those. The model has a bounded size. Without rows of both
    labels every score is that of a coin.
    """
    known = labels.filter(labels[label].isin(0, 1)).select(labels[key].alias("key"), labels[label].cast("int").alias("y"))
    known = known.join(df.select(df[key].alias("key")), "key").withColumn("draw", F.xxhash64(F.col("key").cast("string"), F.lit("sample")))
    by = Window.partitionBy("y").orderBy("draw", "key")
    chosen = known.distinct().withColumn("n", F.row_number().over(by)).filter(F.col("n") <= SAMPLE_ROWS)
    texts = df.select(df[key].alias("key"), F.coalesce(F.lower(df[text]), F.lit("")).alias("text"))
    # Two times SAMPLE_ROWS keys; a key of several rows still gives no more rows than that.
    chosen = texts.join(F.broadcast(chosen.select("key", "y", "draw")), "key")
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("draw", "key", "text"))).filter(F.col("n") <= SAMPLE_ROWS)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "n"])
        if group["y"].nunique() < 2:
            return pd.DataFrame({"hashes": [], "weights": [], "constant": []})
        model = _train(group["text"].tolist(), group["y"].to_numpy())
        return pd.DataFrame({"hashes": [model["hashes"].tobytes()], "weights": [model["weights"].tobytes()], "constant": [model["constant"]]})

    out = chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fitted, "hashes binary, weights binary, constant double").collect()
    if not out:
        return {"hashes": np.empty(0, np.uint64), "weights": np.empty(0), "constant": 0.0}
    return {"hashes": np.frombuffer(bytes(out[0]["hashes"]), np.uint64), "weights": np.frombuffer(bytes(out[0]["weights"])), "constant": out[0]["constant"]}


def score_rows(model: Model, maybe: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of texts: each known n-gram that a text has adds its weight once."""
    found_at, found = [], []
    for hashes, places in _grams(buf, starts, ends):
        near = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        hashes, places = hashes[near], places[near]
        at = np.searchsorted(model["hashes"], hashes)
        same = model["hashes"][np.minimum(at, len(model["hashes"]) - 1)] == hashes
        found_at.append(places[same])
        found.append(at[same])
    places, feature = np.concatenate(found_at), np.concatenate(found)
    full = np.flatnonzero(ends > starts)
    row = full[np.searchsorted(ends[full], places, "right")]
    pair = np.unique(row * len(model["hashes"]) + feature)
    row, feature = np.divmod(pair, len(model["hashes"]))
    return np.bincount(row, model["weights"][feature], len(starts))


def toxicity(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to the rows of ``df``.

    Nothing but the text counts. Null and empty texts have no n-grams and get the model's constant as
    score; texts are read whole; repeated rows get equal scores; an empty table gives an empty one;
    columns named ``score`` or ``predicted`` are replaced, all others stay. One pass, no shuffle.
    """
    others = [c for c in df.columns if c not in ("score", "predicted")]
    source = df.select(*tb.numbered(df, others), F.lower(F.col(f"`{text}`")).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(model["hashes"] >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part, buf, starts, ends in tb.sliced(batch, "__text"):
                total = np.full(len(starts), float(model["constant"]))
                if len(model["hashes"]) and len(buf):
                    total += score_rows(model, maybe, buf, starts, ends)
                score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    part.columns[:-1] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*part.schema.names[:-1], "score", "predicted"]
                )

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema if f.name != "__text")
    return source.mapInArrow(scored, f"{kept}score double, predicted int").toDF(*others, "score", "predicted")


def _held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    known = labels.filter(~_held_out(F.col("doc_id")))
    return toxicity(docs.withColumn("held_out", _held_out(F.col("doc_id"))), fit(docs, known)).drop("text")
