"""Jaccard self-join of word n-grams by parity sketches and a pigeonhole argument."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.components import components, joined
from waxworks.llm.registry import query
from waxworks.operators.joins import join_checked
from waxworks.session import stable

N = 5
#: Documents whose n-grams tell which are frequent. That only orders blocks; no result depends on it.
SAMPLE_DOCS, FREQUENT_FROM, FREQUENT_MOST = 4096, 3, 200_000
SKETCH_BITS = 2048
_WIDE_FROM = 64  # from this size on a block may hold several n-grams
_FEW = 128  # up to so many documents of a key are paired at once, more are compared in tiles of
_TILE = 1024
#: Shares of the open keys, by hash, after each of which components are joined anew: the first keys of a
#: large group of near copies unite it, so that the others need no pairs.
_ROUNDS = (0, 4, 64)
_SKETCHED = 1024  # rows whose sketches are counted at once
_FLUSH = 1_000_000  # keys that a task gathers before it sends them on, and pairs before it drops repeated ones

_PAIR = "a long, b long, ca long, cb long"  # two rows and their components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def similar(a, b, both):
    """Whether sets of sizes ``a`` and ``b`` with ``both`` common members have a similarity of 0.75 or more."""
    return 100 * both >= 75 * (a + b - both)


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the distinct n-grams of each row, in order of row, then hash."""
    buf = _LOWER[buf]
    ws, we, row = tb.words(buf, starts, ends)
    hashes = tb.hash_ranges(buf, ws, we)
    size = max(0, len(hashes) - N + 1)
    rolled = np.zeros(size, np.uint64)
    for i in range(N):
        rolled = rolled * np.uint64(0xA0761D6478BD642F) + hashes[i : i + size]
    inside = np.flatnonzero(row[:size] == row[N - 1 :]) if size else np.empty(0, np.int64)
    grams, of = tb.mix(rolled[inside]), row[inside]
    count = np.bincount(row, minlength=len(starts))
    short = np.flatnonzero((count > 0) & (count < N))  # the whole sequence is the only member
    first = np.searchsorted(row, short)
    whole = np.array([tb.mix(np.array([hash(tuple(hashes[f : f + count[r]].tolist())) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] for f, r in zip(first, short)], np.uint64)
    grams, of = np.concatenate([grams, whole]), np.concatenate([of, short])
    order = np.lexsort([grams, of])
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new]


def most_different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of similar sets of these sizes."""
    return (a + b) // 7


def block_keys(grams: np.ndarray, row: np.ndarray, rows: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and row of each, of which any two similar rows share at least one.

    Rows of sizes s to 2s form a band. Its n-grams are dealt into blocks by hash, 0.8 s of them (1.25 s
    below 256; one for each n-gram below 64), and a block's value is the XOR of its n-grams. Sets that differ in d members differ
    in d blocks at most. So of two similar rows neither has more than D = (a + b) / 7 blocks that the
    other has not, and in any order on blocks and their values the first common one is among the first
    D + 1 of both: those are the keys. Blocks of frequent n-grams only come last, large blocks first. A row
    near the lower end of its band has keys of the band below too.
    """
    size = np.bincount(row, minlength=rows)
    band = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), -1)
    at = np.minimum(np.searchsorted(frequent, grams), max(len(frequent) - 1, 0))
    rare = (frequent[at] != grams) if len(frequent) else np.ones(len(grams), bool)
    out_keys, out_rows = [], []
    for below in (0, 1):
        low = np.int64(1) << np.maximum(band - below, 0)  # s
        use = (band >= below) & ((below == 0) | (3 * size < 4 * (low << 1)))
        most = np.minimum(4 * size // 3, 2 * low - 1) if below == 0 else 2 * low - 1
        wanted = most_different(size, most) + 1
        take = use[row]
        g, r, s = grams[take], row[take], low[row[take]]
        blocks = np.where(s >= 4 * _WIDE_FROM, 4 * s // 5, 5 * s // 4).astype(np.uint64)
        place = np.where(s >= _WIDE_FROM, ((g >> np.uint64(32)) * blocks) >> np.uint64(32), g)
        order = np.lexsort([place, r])
        g, r, place, rr = g[order], r[order], place[order], rare[take][order]
        new = np.ones(len(g), bool)
        new[1:] = (place[1:] != place[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        value = np.bitwise_xor.reduceat(tb.mix(g + np.uint64(0x51ED270B)), first)
        count = np.diff(np.append(first, len(g)))
        plain = np.add.reduceat(rr.astype(np.int64), first) == 0
        r = r[first]
        salt = tb.mix((place[first] + np.uint64(1)) * np.uint64(64) + (band[r] - below).astype(np.uint64))
        key = tb.mix(value ^ salt)
        order = np.lexsort([key, -count, plain, r])
        key, r = key[order], r[order]
        begin = np.searchsorted(r, np.arange(rows))
        held = np.bincount(r, minlength=rows)
        if (use & (held < wanted)).any():
            # D + 1 lies nine deviations or more below the expected number of blocks in use.
            raise RuntimeError("a row has too few blocks")
        rank = np.arange(len(r)) - begin[r]
        chosen = rank < wanted[r]
        out_keys.append(key[chosen])
        out_rows.append(r[chosen])
    if not out_keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out_keys), np.concatenate(out_rows)


def sketches(grams: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Parity of each row's number of n-grams on each bit, packed. The Hamming distance of two rows' sketches
    never exceeds the symmetric difference of their sets."""
    out = np.zeros((rows, SKETCH_BITS // 8), np.uint8)
    bit = (grams >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    for low in range(0, rows, _SKETCHED):
        high = min(low + _SKETCHED, rows)
        i, j = np.searchsorted(row, [low, high])
        odd = np.bincount((row[i:j] - low) * SKETCH_BITS + bit[i:j], minlength=(high - low) * SKETCH_BITS) & 1
        out[low:high] = np.packbits(odd.astype(bool)).reshape(high - low, -1)
    return out


def sketch(grams: np.ndarray) -> bytes:
    """The sketch of one set."""
    return sketches(grams, np.zeros(len(grams), np.int64), 1).tobytes()


# ---------------------------------------------------------------- tasks


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other and end at these bytes."""
    offsets = np.concatenate([np.zeros(1, np.int32), ends.astype(np.int32)])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_SCANNED = "id long, n long, s1 long, s2 long, mark long, keys binary, sketch binary"


def _scanner(shared):
    """The only pass over all texts: size of each row's set, two sums over its members that tell sets apart, one
    mark made of these, block keys and sketch."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, starts, ends in tb.sliced(batch):
                rows = len(starts)
                grams, row = shingles(buf, starts, ends)
                first = np.searchsorted(row, np.arange(rows))
                size = np.bincount(row, minlength=rows)
                sums = []
                for salt in (0x2545F491, 0x9E3779B9):
                    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append(run[first + size] - run[first])
                mark = tb.mix(sums[0] ^ tb.mix(sums[1] + tb.mix(size.astype(np.uint64))))
                keys, of = block_keys(grams, row, rows, shared.value)
                order = np.argsort(of, kind="stable")
                key_ends = 8 * np.searchsorted(of[order], np.arange(1, rows + 1))
                bits = sketches(grams, row, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size), *(pa.array(x.view(np.int64)) for x in (*sums, mark)),
                     _binaries(keys[order], key_ends), _binaries(bits, np.arange(1, rows + 1) * bits.shape[1])],
                    names=["id", "n", "s1", "s2", "mark", "keys", "sketch"],
                )

    return scanned


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, starts, ends in tb.sliced(batch):
            grams, _ = shingles(buf, starts, ends)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])


_SENT = "bucket int, keys binary, places binary, ids binary, lefts binary, rights binary"


def _sender(buckets: int):
    """Keys of all sets under their marks, packed by bucket. Sets of one task that share a key are tied to the
    least of them here; equal sets have one mark and are sent once for each task."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, marks in _gathered(batches):
            yield from _dealt(*_stars(keys, marks), buckets)

    return sent


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a column of packed keys, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]):
    keys, marks, total, seen = [], [], 0, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, first = np.unique(batch.column("mark").to_numpy(), return_index=True)
        fresh = ~np.isin(own, seen)
        own, first = own[fresh], first[fresh]
        seen = np.concatenate([seen, own])
        key, count = _unpacked(batch.column("keys").take(pa.array(first)))
        keys.append(key)
        marks.append(np.repeat(own, count))
        total += len(key)
        if total > _FLUSH:
            yield np.concatenate(keys), np.concatenate(marks)
            keys, marks, total, seen = [], [], 0, np.empty(0, np.int64)
    if total:
        yield np.concatenate(keys), np.concatenate(marks)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key with the least of its ids, and a pair (least id, id) for each other id."""
    order = np.lexsort([ids, keys])
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    lead = np.repeat(ids[first], np.diff(np.append(first, len(keys))))
    other = np.flatnonzero(ids != lead)
    pairs = np.unique(np.stack([lead[other], ids[other]], axis=1), axis=0)
    return keys[first], ids[first], pairs[:, 0], pairs[:, 1]


def _dealt(keys: np.ndarray, ids: np.ndarray, lefts: np.ndarray, rights: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SENT``. Keys are in order; pairs go where their left side falls."""
    known, places = np.unique(ids, return_inverse=True)
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    to = (tb.mix(lefts.astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))  # keys are in order
    order = np.argsort(to, kind="stable")
    lefts, rights, pair_edges = lefts[order], rights[order], np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
    small = np.uint16 if len(known) < 1 << 16 else np.uint32
    for b in range(buckets):
        k = slice(edges[b], edges[b + 1])
        p = slice(pair_edges[b], pair_edges[b + 1])
        if k.stop > k.start or p.stop > p.start:
            used, local = np.unique(places[k], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys[k], local.astype(small), known[used], lefts[p], rights[p]))],
                names=["bucket", "keys", "places", "ids", "lefts", "rights"],
            )


def _received(batches: Iterator[pa.RecordBatch]):
    """Keys, ids and pairs of each bucket of a partition."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.frombuffer(row["keys"], np.uint64)
            kind = np.uint16 if len(row["places"]) == 2 * len(keys) else np.uint32
            ids = np.frombuffer(row["ids"], np.int64)[np.frombuffer(row["places"], kind)]
            held.setdefault(row["bucket"], []).append((keys, ids, np.frombuffer(row["lefts"], np.int64), np.frombuffer(row["rights"], np.int64)))
    for parts in held.values():
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, ids, lefts, rights in _received(batches):
        _, _, a, b = _stars(keys, ids)
        pairs = np.unique(np.stack([np.concatenate([a, lefts]), np.concatenate([b, rights])], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([press(x.as_buffer()) for x in raw], pa.binary())], names=["id", "text"])


def _members(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    return shingles(buf, np.array([0]), np.array([len(buf)]))[0]


def _pairs_of(batch: pa.RecordBatch, keep: pa.Array) -> pa.RecordBatch:
    return batch.select(["a", "b", "ca", "cb"]).filter(keep)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts are similar."""
    expand = zstandard.ZstdDecompressor().decompress
    last, known = None, np.empty(0, np.uint64)
    for batch in batches:
        good = []
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b")):
            if a != last:
                last, known = a, _members(expand(x.as_buffer()))
            other = _members(expand(y.as_buffer()))
            both = len(np.intersect1d(known, other, assume_unique=True))
            good.append(bool(both) and similar(len(known), len(other), both))
        yield _pairs_of(batch, pa.array(good, pa.bool_()))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of a partition's rows with the same key, in different components, of sizes that allow a link."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    key, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "id", "component", "n"))
    order = np.lexsort([ids, key])
    key, ids, comp, n = key[order], ids[order], comp[order], n[order]
    found, total, apart = [np.empty((0, 4), np.int64)], 0, 1
    while True:
        same = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(same):
            break
        other = same + apart
        fits = (comp[same] != comp[other]) & (75 * np.maximum(n[same], n[other]) <= 100 * np.minimum(n[same], n[other]))
        x, y = same[fits], other[fits]
        found.append(np.stack([ids[x], ids[y], comp[x], comp[y]], axis=1))
        total += len(found[-1])
        if total > _FLUSH:
            found = [np.unique(np.concatenate(found), axis=0)]
            total = len(found[0])
        apart += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], names=["a", "b", "ca", "cb"])


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches don't rule a link out."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            near = np.bitwise_count(a ^ b).sum(axis=1) <= most_different(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            yield _pairs_of(batch, pa.array(near))


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a tile in different components whose sketches and sizes don't rule a link out."""
    i, j = group["i"].iloc[0], group["j"].iloc[0]
    bits = np.stack([np.frombuffer(bytes(s), np.uint64) for s in group["sketch"]])
    ids, n, comp, chunk = (group[c].to_numpy() for c in ("id", "n", "component", "chunk"))
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]  # places
    for x in left:
        y = right[(comp[right] != comp[x]) & ((i != j) | (ids[right] > ids[x]))]
        y = y[75 * np.maximum(n[y], n[x]) <= 100 * np.minimum(n[y], n[x])]
        apart = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1)
        y = y[apart <= most_different(n[y], n[x])]
        a.append(np.full(len(y), x))
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    return pd.DataFrame({"a": ids[a], "b": ids[b], "ca": comp[a], "cb": comp[b]})


# ---------------------------------------------------------------- join


def _bucket_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The components of the similar ones of the pairs. Compressed texts travel; each pair is checked on its own, so
    no group gathers."""
    text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ca", "cb", "text_a", "text_b")
    return both.mapInArrow(_verified, _PAIR).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _by_sketch(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose sketches don't rule a link out."""
    side = lambda c: marks.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.select("a", "b", "ca", "cb").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ca", "cb", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_allowed, _PAIR)


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id of every row: the least key that links of similarity 0.75 reach.

    One pass over the texts gives for each row the size of its set, the keys of its blocks (``block_keys``) and
    its sketch. Equal sets form a class, a node of the graph. Keys propose pairs of classes: each class that
    shares a key with others is paired with one of them only. Pairs that sizes and the Hamming distance of the
    sketches allow are verified on whole sets. Where members of a key are then still in different components,
    all pairs between those components that sizes and sketches allow are verified too, in tiles of bounded size
    and in two rounds over the keys, each with the components that the one before it left. So no link
    between different sets is lost, and no group is expanded into all its pairs. Keys travel in packed
    arrays, one for each task and bucket.

    Null and empty texts and texts of white space have no n-grams: size 0, linked with nothing, their own
    component. Rows with a null key get a null component and link nothing. Rows with equal keys are one
    node: their sets all count for it. A very long text is read whole. An empty table gives an empty one.
    Other columns are left out. N-grams are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    rows = df.select(df[key].cast("bigint").alias("id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    share = SAMPLE_DOCS / max(1, rows.count())
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    frequent = drawn.mapInArrow(_sampled, "gram long").groupBy("gram").count().filter(F.col("count") >= FREQUENT_FROM)
    frequent = frequent.orderBy(F.desc("count"), "gram").limit(FREQUENT_MOST).select("gram").toPandas()["gram"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(np.sort(frequent.view(np.uint64)))  # at most FREQUENT_MOST

    buckets = _bucket_count(df)
    scanned = stable(rows.mapInArrow(_scanner(shared), _SCANNED).withColumn("row", F.monotonically_increasing_id()))
    usable = scanned.filter("n > 0 and id is not null")
    same = ["n", "s1", "s2"]
    classes = usable.groupBy(*same).agg(F.min("row").alias("node"), F.min("id").alias("head"), F.min("mark").alias("mark"))
    classes = stable(classes)

    sent = usable.select("mark", "keys").mapInArrow(_sender(buckets), _SENT).repartitionById(buckets, "bucket")
    found = sent.mapInArrow(_paired, "a long, b long").distinct().withColumnsRenamed({"a": "mark_a", "b": "mark_b"})
    side = lambda c: classes.select(F.col("mark").alias(f"mark_{c}"), F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    found = found.join(side("a"), "mark_a").join(side("b"), "mark_b")
    fits = 100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b")
    pairs = stable(found.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), fits.alias("fits")))
    wanted = stable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    marks = join_checked(usable.select(F.col("row").alias("node"), "n", "keys", "sketch"), wanted, ["node"]).withColumnRenamed("node", "id")
    marks = stable(marks)
    heads = classes.join(wanted, "node").select("node", F.col("head").alias("id"))
    texts = join_checked(rows.filter("id is not null").mapInArrow(_compressed, "id long, text binary"), heads, ["id"])
    texts = stable(texts.select("node", "text"))

    # Rows with equal keys are one node.
    owned = usable.select("id", *same).join(classes.select(*same, "node"), same).select("id", "node")
    one_node = owned.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    one_node = owned.join(one_node.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    reached = components(_verify(_by_sketch(pairs.filter("fits"), marks), texts).union(one_node))
    known = wanted.withColumnRenamed("node", "id").join(reached, "id", "full")
    comps = stable(known.select("id", F.coalesce("component", "id").alias("component")))

    # Keys whose members are in different components even so.
    members = _open_keys(marks, comps, buckets)
    part = F.pmod(F.xxhash64("key"), F.lit(_ROUNDS[-1]))
    for low, high in zip(_ROUNDS, _ROUNDS[1:]):
        more = _across(members.filter((part >= low) & (part < high)), marks, comps)
        if more is not None:
            comps = joined(comps, _verify(more, texts))
    named = classes.join(comps, classes["node"] == comps["id"], "left").select(*same, "head", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("head").alias("least"))
    of_class = named.join(least, "component").select(*same, "least")
    out = scanned.select("id", *same).join(of_class, same, "left")
    # Only sets with members and a key have a class of their own.
    linked = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("least")).otherwise(F.col("id"))
    shown = F.col("id").alias(key), F.col("n").alias("n_shingles"), linked.alias("component_id")
    return out.select(*shown)


def _keyed(column: str, buckets: int = 0):
    """Key, ``column`` and size of every row of packed keys; with ``buckets`` key and ``column``, packed by bucket."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            keys, count = _unpacked(batch.column("keys"))
            marks = np.repeat(batch.column(column).to_numpy(), count)
            if buckets and len(keys):
                pairs = np.unique(np.rec.fromarrays([keys, marks]))
                yield from _dealt(np.ascontiguousarray(pairs.f0), np.ascontiguousarray(pairs.f1), none, none, buckets)
            elif not buckets:
                sizes = np.repeat(batch.column("n").to_numpy(), count)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), marks, sizes)], names=["key", column, "n"])

    return keyed


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of several components."""
    for keys, comps, _, _ in _received(batches):
        order = np.lexsort([comps, keys])
        keys, comps = keys[order], comps[order]
        mixed = np.unique(keys[1:][(keys[1:] == keys[:-1]) & (comps[1:] != comps[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64))], names=["key"])


def _open_keys(marks: DataFrame, comps: DataFrame, buckets: int) -> DataFrame:
    """Key, id and size of the members of keys with several components."""
    mixed = marks.select("id", "keys").join(comps, "id").mapInArrow(_keyed("component", buckets), _SENT)
    mixed = mixed.repartitionById(buckets, "bucket").mapInArrow(_crossed, "key long")
    return stable(join_checked(marks.select("id", "n", "keys").mapInArrow(_keyed("id"), "key long, id long, n long"), mixed, ["key"]))


def _across(members: DataFrame, marks: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Pairs across components that share a key and that sizes and sketches allow. None: no key has several."""
    rows = members.join(comps, "id")
    counts = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    rows = stable(rows.join(counts.filter("lo < hi"), "key").select("key", "id", "n", "component", "members"))
    most = rows.agg(F.max("members")).first()[0]
    if most is None:
        return None
    pairs = rows.filter(F.col("members") <= _FEW).select("key", "id", "component", "n").repartition("key").mapInArrow(_few, _PAIR).distinct()
    pairs = _by_sketch(pairs, marks)
    if most <= _FEW:
        return pairs
    many = rows.filter(F.col("members") > _FEW).withColumn("chunks", F.ceil(F.col("members") / _TILE).cast("int"))
    many = many.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = many.select("key", "id", "n", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    tiles = many.join(marks.select("id", "sketch"), "id").groupBy("key", "i", "j").applyInPandas(_tile, _PAIR)
    return stable(pairs.union(tiles).distinct())


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the least key, null keys last.

    Every row is judged by its own text, also where its key is null or that of another row; of rows with
    the least key of a group one stays. Rows without n-grams stay. Where whole numbers that are all
    different and not null are the keys, they name the rows; otherwise the rows get a number first, which
    is written once beside them.
    """
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        unclear = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).filter("k is null or n > 1")
        if unclear.isEmpty():
            heads = jaccard_components(df, key, text).filter(F.col("component_id") == F.col(key)).select(F.col(key).alias("_kept"))
            return df.join(heads, df[key] == heads["_kept"], "left_semi")
    row = "_row"
    while row in df.columns:
        row += "_"
    marked = stable(df.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard_components(marked, row, text).select(F.col(row).alias("r"), F.col("component_id").alias("c"))
    keys = marked.select(F.col(row).alias("r"), F.col(key).alias("k"))
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "r"))
    heads = groups.join(keys, "r").groupBy("c").agg(first.alias("first")).select(F.col("first.r").alias("_kept"))
    return marked.join(heads, marked[row] == heads["_kept"], "left_semi").drop(row)


@query("op5_jaccard_join")
def op5(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
