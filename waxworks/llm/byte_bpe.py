"""Byte-level BPE: a perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.registry import query

#: Encoded pre-tokens that a worker keeps; when full it starts anew. It bounds memory only.
KEPT = 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file of lines with a token in base64 and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash over distinct byte strings, by displacement.

    Keys fall into buckets by one hash; for each bucket, the largest first, the first seed is taken that
    sends all its keys to free slots, and keys alone in a bucket take what is left. There are as many
    slots as keys. A lookup computes one slot and compares the bytes there.
    """

    def __init__(self, keys: list[bytes]):
        hashes = _hashes(keys)
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        size = np.bincount(bucket, minlength=self.buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.cumsum(size) - size
        self.seeds = np.zeros(self.buckets, np.int64)
        self.slots = np.full(n, -1, np.int64)
        for b in np.argsort(-size, kind="stable").tolist():
            of = order[first[b] : first[b] + size[b]]
            if len(of) < 2:
                break
            own, seed = hashes[of], 0
            while True:
                tried = np.arange(seed, seed + 32, dtype=np.int64)
                at = self._slot(own[None, :], tried[:, None])
                ranked = np.sort(at, axis=1)
                good = (self.slots[at] < 0).all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    break
                seed += 32
            self.seeds[b] = tried[good.argmax()]
            self.slots[at[good.argmax()]] = of
        lone = np.flatnonzero(size == 1)
        free = np.flatnonzero(self.slots < 0)
        self.seeds[lone] = -1 - free  # a lone key names its slot itself
        self.slots[free] = order[first[lone]]
        self.lengths = np.array([len(k) for k in keys])
        self.flat = np.frombuffer(b"".join(keys), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _slot(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        salted = hashes ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return np.where(seeds < 0, -1 - seeds, (tb.mix(salted) % np.uint64(self.n)).astype(np.int64))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key, or -1."""
        hashes = _hashes(keys)
        found = self.slots[self._slot(hashes, self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)])]
        lengths = np.array([len(k) for k in keys])
        same = np.flatnonzero(self.lengths[found] == lengths)
        flat, starts = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(lengths) - lengths
        size = lengths[same]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = flat[np.repeat(starts[same], size) + inside] != self.flat[np.repeat(self.starts[found[same]], size) + inside]
        wrong = np.bincount(np.repeat(same, size), differ, len(keys)) > 0
        out = np.full(len(keys), -1, np.int64)
        out[same] = found[same]
        out[wrong] = -1
        return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return tb.hash_ranges(np.frombuffer(b"".join(keys), np.uint8), starts, ends)


class Codec:
    """Encoder and decoder for one list of tokens by rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = PerfectHash(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: The rank that a pair of neighbours merges into.
        self.pairs = {
            (ranks[t[:i]] << 24) | ranks[t[i:]]: r
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: always the lowest rank first, the leftmost of equals.

        Pieces form a linked list over the bytes; a heap holds the merges that were possible when they
        were pushed, and those whose pieces have changed since are passed over.
        """
        get, single = self.pairs.get, self.single
        ids = [single[b] for b in word]
        n = len(ids)
        live = [get((a << 24) | b, -1) for a, b in zip(ids, ids[1:])]  # the merge that is possible here now
        heap = [(r << 32) | i for i, r in enumerate(live) if r >= 0]
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        live.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if live[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], live[i], live[j] = rank, -1, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank << 24) | ids[k], -1)) >= 0:
                    live[i] = r
                    push(heap, (r << 32) | i)
            h = before[i]
            if h >= 0:
                live[h] = r = get((ids[h] << 24) | rank, -1)
                if r >= 0:
                    push(heap, (r << 32) | h)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, as unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        if not raw:
            return []
        merge = self.merge
        return [array("I", (f,) if f >= 0 else merge(w)).tobytes() for f, w in zip(self.whole.find(raw).tolist(), raw)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts, keeping what it has encoded lately."""

    def __init__(self, codec: Codec, pattern: str):
        self.codec, self.split = codec, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.split(text) for text in texts]
        seen = set().union(*split)
        new = list(seen.difference(self.known))
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(seen)
        self.known.update(zip(new, self.codec.encode_words(new)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in split]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder for a worker process; the pre-tokens that it knows serve later tasks too."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value, pattern)
    return _ENCODERS[shared.id]


class _Shared:
    """The codec, sent to the executors once; its size is that of the vocabulary."""

    def __init__(self, spark, codec: Codec):
        self._held = spark.sparkContext.broadcast(codec)
        self.id = id(self._held)

    @property
    def value(self) -> Codec:
        return self._held.value


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>) to the rows of ``df``, replacing a column of that name.

    ``path`` names a rank file and ``pattern`` the expression whose matches are encoded one by one, each
    as a whole text; there are no special tokens, so their strings are ordinary text. A pre-token that is
    itself in the vocabulary is found by a minimal perfect hash; any other is merged by a heap. Null and
    empty texts have no ids; texts of any length are read whole; repeated rows get equal ids; an empty
    table gives an empty one. One pass, no shuffle.
    """
    others = [c for c in df.columns if c != "ids"]
    source = df.select(*[F.col(f"`{c}`") for c in others], df[text].cast("string").alias("__text"))
    shared = _Shared(df.sparkSession, Codec(read_ranks(path)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            for part, *_ in tb.sliced(batch, "__text"):
                ids = encoder.encode([x or "" for x in part.column("__text").to_pylist()])
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in others] + [pa.ListArray.from_arrays(pa.array(sizes), flat)], names=[*others, "ids"]
                )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "__text")
    return source.mapInArrow(encoded, f"{kept}ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) to the rows of ``df`` in place of the ids. Null or empty ids: no bytes."""
    others = [c for c in df.columns if c not in ("decoded", ids)]
    source = df.select(*[F.col(f"`{c}`") for c in others], df[ids].alias("__ids"))
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(token, x or [])) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in others] + [pa.array(texts, pa.binary())], names=[*others, "decoded"]
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "__ids")
    return source.mapInArrow(decoded, f"{kept}decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, and decoded from those ids again.

    Rows as for ``encode``; ids and bytes don't leave the task. The digest of ids is over unsigned
    32-bit little-endian integers.
    """
    source = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    shared = _Shared(df.sparkSession, Codec(read_ranks(path)))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            for part, *_ in tb.sliced(batch):
                ids = encoder.encode([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([sha(x.astype("<u4")) for x in ids], pa.string()),
                     pa.array([sha(encoder.codec.decode(x)) for x in ids], pa.string())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = source.mapInArrow(digests, f"key {source.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
