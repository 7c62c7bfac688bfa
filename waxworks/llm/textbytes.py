"""Numpy views of Arrow text columns: bytes, words, lines and 64-bit hashes of any byte range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once. It bounds memory only; no result depends on it.
SLICE_BYTES = 2 << 20
_BLOCK = _LONG = 1 << 18  # ranges that start so near are hashed together; a longer one by blake2b, in constant memory
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number, and of its inverse, modulo 2**64."""
    global _table
    up, down = _table
    if len(up) < n:
        up, down = _powers(-(-n // _STEP) * _STEP)
        if n <= SLICE_BYTES + _STEP:  # those of a longer text go with it
            _table = up, down
    return up[:n], down[:n]


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_STEP = 1 << 18
_table: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers, out=powers))
    return out[0], out[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts and ends. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    starts, ends = ends[:-1], ends[1:].copy()
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return buf, starts, ends


def numbered(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns ``names`` under c0, c1, ...: Arrow functions don't take every name, and none may clash with a helper."""
    return [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]


def ddl(df: DataFrame) -> str:
    """The columns of ``df``, all named by ``numbered`` or a helper, as a schema for Arrow functions."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row stands alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def sliced(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch, each with the bytes of its texts and each row's start and end in them."""
    if not batch.num_rows:
        return
    buf, starts, ends = column_bytes(batch.column(text))
    for i, j in slices(ends - starts, limit):
        lo, hi = int(starts[i]), int(max(ends[i:j].max(), starts[i]))
        yield batch.slice(i, j - i), buf[lo:hi], starts[i:j] - lo, ends[i:j] - lo


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, a function of its bytes alone. Ranges are in order of their start."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + _BLOCK, "left"))
        j = max(j, i + 1)
        long = np.flatnonzero(ends[i:j] - starts[i:j] > _LONG) + i  # by its own length, whatever stands beside it
        for k in long.tolist():
            digest = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
            out[k] = np.frombuffer(digest, np.uint64)[0]
        rest = np.setdiff1d(np.arange(i, j), long) if len(long) else np.arange(i, j)
        if len(rest):
            s, e = starts[rest], ends[rest]
            lo, hi = int(s[0]), int(e.max())
            up, down = scales(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(BYTE[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
            out[rest] = mix((sums[e - lo] - sums[s - lo]) * down[s - lo] + (e - s).astype(np.uint64) * BYTE[7])
        i = j
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than space and 09 to 0D; words don't cross rows."""
    return _runs(~_SPACE[buf], starts, ends)


def lines(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each non-empty line."""
    return _runs(buf != 0x0A, starts, ends)


def _runs(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        full = ends > starts
        before[starts[full]] = False
        after[ends[full] - 1] = False
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.repeat(np.arange(len(starts)), counts_in(first, starts, ends))


def counts_in(places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the ordered places lie in each range."""
    return np.searchsorted(places, ends, "left") - np.searchsorted(places, starts, "left")


def code_points(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, with one more entry for the end."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out
