"""Removal of repeated byte strings by sorting suffixes in range-partitioned buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.registry import query
from waxworks.session import stable

#: Bytes of a repeated string, and of the leading token of a suffix that stands for the windows around it.
WINDOW, GRAM = 200, 40
#: Windows of a run in the second round; in the third each stands alone.
NARROW = 8
_PLACES = WINDOW - GRAM + 1
_PIECE = 4 << 20  # longer texts are read in overlapping pieces; bounds memory only
_LOW = np.uint64((1 << 24) - 1)
_START = (1 << 32) - 1
_SMALL = 2048  # segments below this are sorted at once

_SUFFIX = "t1 long, t2 long, d long, h long, loc long"
_FOUND = "kind int, d long, h long, loc long, edge binary"
SPAN, OPEN, FIRST, LAST = 0, 1, 2, 3


# ---------------------------------------------------------------- suffixes of a text


def _pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, offset in the row, start and end of pieces of at most ``_PIECE`` window starts, in groups of bounded size."""
    rows, offs, los, his = [], [], [], []
    size = 0
    for row, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
        for off in range(0, max(1, hi - lo - WINDOW + 1), _PIECE):
            end = min(hi, lo + off + _PIECE + WINDOW - 1)
            if size and size + end - lo - off > _PIECE:
                yield np.array(rows), np.array(offs), np.array(los), np.array(his)
                rows, offs, los, his, size = [], [], [], [], 0
            rows.append(row)
            offs.append(off)
            los.append(lo + off)
            his.append(end)
            size += end - lo - off
    if rows:
        yield np.array(rows), np.array(offs), np.array(los), np.array(his)


def suffixes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Leading tokens, row, first window, number of windows and place (from the first window) of each chosen suffix.

    Every window of 200 bytes chooses one place: of its 40-byte grams the one with the least hash, the
    rightmost of equals. Equal windows choose alike, so windows can only be equal if the grams they chose
    are. A suffix starts at a chosen gram and stands for the run of windows that chose it; its tokens are
    the hash of the gram and that of all bytes of those windows.
    """
    up, down = tb.scales(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(tb.BYTE[buf] * up[:-1], out=sums[1:])
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 4)
    gram = (sums[GRAM:] - sums[:-GRAM]) * down[: len(buf) - GRAM + 1]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    least = (gram & ~_LOW) | (_LOW - np.arange(len(gram), dtype=np.uint64))
    width = 1
    while 2 * width <= _PLACES:  # minima of 1, 2, 4, ... places, then of all
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _PLACES - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    chosen = (_LOW - (least & _LOW)).astype(np.int64)  # of each window start
    valid = np.zeros(n + 1, np.int64)
    long = ends - starts >= WINDOW
    np.add.at(valid, starts[long], 1)
    np.subtract.at(valid, ends[long] - WINDOW + 1, 1)
    window = np.flatnonzero(np.cumsum(valid)[:n])
    if not len(window):
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 4)
    at = chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    lo, place = window[first], at[first]
    hi = lo + count - 1
    whole = (sums[hi + WINDOW] - sums[lo]) * down[lo]
    t2 = tb.mix(whole + tb.mix(((place - lo) * 1024 + count).astype(np.uint64)))
    full = np.flatnonzero(long)
    row = full[np.searchsorted(starts[full], lo, "right") - 1]
    return gram[place], t2, row, lo, count, place - lo


def narrower(buf: np.ndarray, starts: np.ndarray, counts: np.ndarray, offs: np.ndarray, width: int):
    """Tokens, first window, number of windows and place of the runs of at most ``width`` windows of each run.

    Runs are cut at fixed distances from the chosen place, so that equal windows fall into runs that
    correspond. The first token is the hash of the bytes that all windows of a run could have in common,
    the second that of all bytes of its windows; for single windows, the hashes of their halves.
    """
    up, down = tb.scales(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(tb.BYTE[buf] * up[:-1], out=sums[1:])
    token = lambda a, b: tb.mix((sums[b] - sums[a]) * down[a])
    least, most = (offs - counts + 1) // width, offs // width
    n = most - least + 1
    of = np.repeat(np.arange(len(n)), n)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[of]
    place = starts[of] + offs[of]
    first = np.maximum(starts[of], place - part * width - width + 1)
    last = np.minimum(starts[of] + counts[of] - 1, place - part * width)
    off, count = place - first, last - first + 1
    if width == 1:
        return token(first, first + WINDOW // 2), token(first + WINDOW // 2, first + WINDOW), first, count, off
    common = place - part * width
    t1 = tb.mix(token(common, common - width + 1 + WINDOW) + part.astype(np.uint64))
    t2 = tb.mix(token(first, last + WINDOW) + tb.mix((off * 1024 + count).astype(np.uint64)))
    return t1, t2, first, count, off


# ---------------------------------------------------------------- buckets


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: multikey quicksort.

    A segment is split by a pivot into smaller, equal and larger tokens; the equal part goes on with the
    next token. Small segments are sorted at once.
    """
    order = np.arange(len(tokens[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        part = order[lo:hi]
        if hi - lo <= _SMALL:
            if hi - lo > 1:
                order[lo:hi] = part[np.lexsort([t[part] for t in tokens[depth:][::-1]])]
            continue
        keys = tokens[depth][part]
        pivot = np.sort(keys[:: max(1, len(keys) // 255)])[127]
        less, same = keys < pivot, keys == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[~less & ~same]])
        stack.append((lo, a, depth))
        stack.append((b, hi, depth))
        if depth + 1 < len(tokens):
            stack.append((a, b, depth + 1))
    return order


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket and compare neighbours.

    SPAN: both tokens are those of another suffix. OPEN: the first token is, the second isn't; or the
    suffix stands next to one with another second token, so that it speaks for its own. FIRST and LAST:
    the ends of the bucket, to be compared with those of the buckets beside it.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    t1, t2, d, h, loc = (table.column(c).to_numpy() for c in ("t1", "t2", "d", "h", "loc"))
    del held, table
    order = multikey_order([t1, t2, d, h, loc])
    t1, t2, d, h, loc = t1[order], t2[order], d[order], h[order], loc[order]
    same1, same2 = t1[1:] == t1[:-1], (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1])
    whole, turn = np.zeros(len(t1), bool), np.zeros(len(t1), bool)
    whole[1:] |= same2
    whole[:-1] |= same2
    turn[1:] |= same1 & ~same2
    turn[:-1] |= same1 & ~same2
    bucket = TaskContext.get().partitionId()
    edge = {k: np.array([bucket, t1[i], t2[i]], np.int64).tobytes() for k, i in ((FIRST, 0), (LAST, len(t1) - 1))}
    for kind, rows in ((SPAN, np.flatnonzero(whole)), (OPEN, np.flatnonzero(turn)), (FIRST, np.array([0])), (LAST, np.array([len(t1) - 1]))):
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), kind, np.int32)), pa.array(d[rows]), pa.array(h[rows]), pa.array(loc[rows]), pa.array([edge.get(kind)] * len(rows), pa.binary())],
                names=["kind", "d", "h", "loc", "edge"],
            )


def repeated(rows: DataFrame) -> DataFrame:
    """Which suffixes have their tokens in common with another: kind, d, h and loc.

    Spark samples splitters over the leading tokens and deals the suffixes out by range, so that a token
    that very many share spreads over several buckets. Every bucket is sorted on its own. Of each bucket
    only the two ends reach the driver, to be compared with the ends of the next.
    """
    found = stable(rows.repartitionByRange("t1", "t2", "d", "h", "loc").mapInArrow(_bucket, _FOUND))
    ends = []
    for r in found.filter(F.col("kind") >= FIRST).collect():  # two rows a bucket
        bucket, t1, t2 = np.frombuffer(bytes(r["edge"]), np.int64).tolist()
        ends.append((bucket, r["kind"], t1, t2, r["d"], r["h"], r["loc"]))
    ends.sort()
    more = []
    for a, b in zip(ends, ends[1:]):
        if a[0] != b[0] and a[2] == b[2]:
            kind = SPAN if a[3] == b[3] else OPEN
            more += [(kind, *x[4:]) for x in (a, b)]
    found = found.filter(F.col("kind") < FIRST).select("kind", "d", "h", "loc")
    return found.union(found.sparkSession.createDataFrame(more, "kind int, d long, h long, loc long")) if more else found


# ---------------------------------------------------------------- documents


def _packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """The row's key and the hash of its text, which tell texts apart also under one key; equal rows share both."""
    return df.select(
        F.coalesce(F.xxhash64(df[key].cast("string")) if dict(df.dtypes)[key] not in ("bigint", "int") else df[key].cast("bigint"), F.lit(-(1 << 62))).alias("d"),
        F.xxhash64(df[text]).alias("h"), F.coalesce(df[text], F.lit("")).alias("text"), *[df[c].alias(f"c{i}") for i, c in enumerate(df.columns) if c != text],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, starts, ends in tb.sliced(batch):
            d, h = part.column("d").to_numpy(), part.column("h").to_numpy()
            for rows, offs, los, his in _pieces(starts, ends):
                base = int(los[0])
                t1, t2, row, lo, count, off = suffixes(buf[base : int(his.max())], los - base, his - base)
                if len(t1):
                    start = lo + base - los[row] + offs[row]
                    loc = (count << 40) | (off << 32) | start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(d[rows[row]]), pa.array(h[rows[row]]), pa.array(loc)],
                        names=["t1", "t2", "d", "h", "loc"],
                    )


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        raw = batch.column(at).cast(pa.binary())
        yield batch.set_column(at, "text", pa.array([press(x.as_buffer()) for x in raw], pa.binary()))


def _narrowed(width: int):
    """Suffixes of the narrower runs of the open ones of each text."""

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for d, h, text, locs in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), batch.column("locs")):
                buf = np.frombuffer(expand(text.as_buffer()), np.uint8)
                locs = locs.values.to_numpy()
                locs = locs[np.argsort(locs & _START)]
                starts, counts, offs = locs & _START, (locs >> 40) & 0xFF, (locs >> 32) & 0xFF
                i = 0
                while i < len(locs):
                    j = min(i + 1000, int(np.searchsorted(starts, starts[i] + _PIECE)))
                    base, end = int(starts[i]), int((starts[i:j] + counts[i:j]).max()) - 1 + WINDOW
                    t1, t2, first, count, off = narrower(buf[base:end], starts[i:j] - base, counts[i:j], offs[i:j], width)
                    loc = (count << 40) | (off << 32) | (first + base)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(np.full(len(loc), d)), pa.array(np.full(len(loc), h)), pa.array(loc)],
                        names=["t1", "t2", "d", "h", "loc"],
                    )
                    i = j

    return narrowed


def _merged(locs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the windows cover."""
    starts = locs & _START
    ends = starts + ((locs >> 40) & 0xFF) - 1 + WINDOW
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(ends)) - 1]


def _whole(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without the code points of which they have a part only."""
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    runs = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        if b > a:
            runs.append((a, b))
    runs = np.array(runs, np.int64).reshape(-1, 2)
    return runs[:, 0], runs[:, 1]


def _cutter(names: list[str], form: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, locs in zip(batch.column("text"), batch.column("locs")):
                raw = expand(text.as_buffer())
                starts, ends = _merged(locs.values.to_numpy()) if locs.is_valid else (np.empty(0, np.int64),) * 2
                if form == "text":
                    starts, ends = _whole(raw, starts, ends)
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(list(zip(starts.tolist(), ends.tolist())))
                kept.append(hashlib.sha256(rest).hexdigest() if form == "digest" else rest)
            kind = pa.binary() if form == "bytes" else pa.string()
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rows = [[{"start": a, "end": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(rows, pairs), pa.array(kept, pa.binary()).cast(kind) if form == "text" else pa.array(kept, kind)],
                names=[*names, "n_bytes", "n_removed", "spans", "kept"],
            )

    return cut


def suffix_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", form: str = "bytes") -> DataFrame:
    """Replace ``text`` by n_bytes, n_removed, spans (start, end in bytes) and kept (the bytes that are left).

    Every byte that lies in a 200-byte string which also starts anywhere else, in the same text or in
    another, is removed; strings are judged on the input. In the form ``digest`` kept is the hex sha256 of
    those bytes, in the form ``text`` a string: code points that would lose a part of their bytes stay.

    Texts become suffixes at content-chosen places (``suffixes``), which are range-partitioned by their
    leading tokens, sorted in buckets and compared across boundaries. Where neighbours agree in all
    windows that they stand for, those are removed; where they agree in the leading token only, at the
    ends of repeated passages, their windows become suffixes of eight windows each in a second round, and
    where those differ, of one window in a third. Tokens are 64-bit hashes, two of which must agree.

    Null and empty texts, and those under 200 bytes, keep all they have; very long texts are read in
    overlapping pieces; repeated rows are copies of each other, so all their windows go; null keys are
    one more key; texts that share a key are told apart by their 64-bit hash; an empty table gives an empty one; columns named as the new ones are replaced.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    keep = {f"c{i}": c for i, c in enumerate(df.columns) if c != text and (c == key or c not in new)}
    rows = _packed(df, key, text)
    first = repeated(rows.select("d", "h", "text").mapInArrow(_scan, _SUFFIX))
    packed = rows.select("d", "h", "text", *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name != "text")
    fields = f"d long, h long, text binary{''.join(f', {x}' for x in kept.split(', ')[2:])}"
    place = lambda found: found.groupBy("d", "h").agg(F.collect_set("loc").alias("locs"))
    texts = packed.select("d", "h", "text").mapInArrow(_compressed, "d long, h long, text binary")
    found, rounds = first, [first]
    for width in (NARROW, 1):
        opened = place(found.filter(F.col("kind") == OPEN))
        found = repeated(texts.join(opened, ["d", "h"]).mapInArrow(_narrowed(width), _SUFFIX))
        rounds.append(found)
    spans = place(reduce(DataFrame.union, rounds).filter(F.col("kind") == SPAN))
    whole = packed.select("d", "h", "text", *keep).mapInArrow(_compressed, fields)
    out = whole.join(spans, ["d", "h"], "left")
    tail = "n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept " + ("binary" if form == "bytes" else "string")
    head = ", ".join(f"`{n}` {packed.schema[n].dataType.simpleString()}" for n in keep)
    out = out.mapInArrow(_cutter(list(keep), form), f"{head}, {tail}" if head else tail)
    return out.select(*[F.col(n).alias(c) for n, c in keep.items()], *new)


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """A documents table with the repeated strings cut out of its texts, and their number of characters."""
    out = suffix_dedup(df, key, text, "text").withColumn(text, F.col("kept")).withColumn(chars, F.length("kept").cast("bigint"))
    return out.select(*df.columns)


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = suffix_dedup(docs, form="digest")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.col("kept").alias("kept_sha256"))
