"""Near copies by MinHash bands, sequential Bayesian verification of signatures, and exact sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.components import components
from waxworks.llm.registry import query
from waxworks.operators.joins import join_checked
from waxworks.session import stable

N = 4  # words of a shingle
PERCENT = 80
#: 32 bands of 4 values: two sets of similarity 0.8 share none with a probability of 5e-8.
BANDS, BAND_ROWS = 32, 4
VALUES = BANDS * BAND_ROWS
#: Values compared up to each test, and the posterior probability of a link below which a pair is dropped.
STEPS, MISS = (16, 32, 64, 128), 1e-9
_TILE = 512  # members of a band that one task compares with as many others at a time
_SLICE = 1 << 20  # bytes of text that are shingled at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCALES = tb.mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = tb.mix(np.arange(VALUES + 1, 2 * VALUES + 1, dtype=np.uint64))


def similar(a, b, both):
    """Whether sets of sizes ``a`` and ``b`` with ``both`` common members have a similarity of 0.8 or more."""
    return 100 * both >= PERCENT * (a + b - both)


@lru_cache(maxsize=None)
def least_matches(seen: int, miss: float = MISS) -> int:
    """The fewest of ``seen`` equal values with which a link stays possible.

    With a uniform prior on the similarity, ``m`` of ``n`` equal values leave the posterior
    Beta(m + 1, n - m + 1). The probability that it is 0.8 or more is that of at most m successes in
    n + 1 draws of 0.8, a finite sum.
    """
    at, total = PERCENT / 100, 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * at**m * (1 - at) ** (seen + 1 - m)
        if total >= miss:
            return m
    return seen


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, rows in order and sorted inside, and each row's number of them."""
    buf = _LOWER[buf]
    ws, we, row = tb.words(buf, starts, ends)
    hashes = tb.hash_ranges(buf, ws, we)
    counts = np.bincount(row, minlength=len(starts))
    size = max(0, len(hashes) - N + 1)
    rolled = np.zeros(size, np.uint64)
    for i in range(N):
        rolled = rolled * np.uint64(0xA0761D6478BD642F) + hashes[i : i + size]
    rolled = tb.mix(rolled)
    first = np.concatenate([[0], np.cumsum(counts)])
    sets = []
    for i, n in enumerate(counts.tolist()):
        a = int(first[i])
        if n >= N:
            own = np.sort(rolled[a : a + n - N + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sets.append(own[new])
        elif n:  # the whole sequence is the only member
            whole = np.uint64(n)
            for h in hashes[a : a + n]:
                whole = tb.mix(np.array([whole ^ h]))[0]
            sets.append(np.array([whole]))
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def signatures(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of each of ``VALUES`` hash functions over every row's members; rows without members are left out."""
    sizes = sizes[sizes > 0]
    out = np.empty((len(sizes), VALUES), np.uint32)
    if len(sizes):
        first = np.cumsum(sizes) - sizes
        hashed = np.empty_like(members)
        for i in range(VALUES):
            np.multiply(members, _SCALES[i], out=hashed)
            np.add(hashed, _SHIFTS[i], out=hashed)
            out[:, i] = np.minimum.reduceat(hashed, first) >> np.uint64(32)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = np.ascontiguousarray(values).view(np.uint64).reshape(len(values), BANDS, BAND_ROWS // 2)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for i in range(parts.shape[2]):
        key = tb.mix(key ^ parts[:, :, i])
    return key


def _sums(members: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two sums over each row's members, which tell sets apart."""
    last = np.cumsum(sizes)
    out = []
    for salt in (0x2545F491, 0x9E3779B9):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(members ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((run[last] - run[last - sizes]).view(np.int64))
    return out


# ---------------------------------------------------------------- tasks


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, starts, ends in tb.sliced(batch, limit=_SLICE):
            members, sizes = shingles(buf, starts, ends)
            values = np.empty((len(sizes), VALUES), np.uint32)
            values[sizes > 0] = signatures(members, sizes)
            packed = pa.array([v.tobytes() if n else None for v, n in zip(values, sizes.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), *map(pa.array, _sums(members, sizes)), packed], names=["id", "n", "s1", "s2", "values"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), VALUES)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            keys = band_keys(_matrix(part.column("values")))
            ids = np.repeat(np.asarray(part.column("c"), np.int64), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int8), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(ids)], names=["key", "band", "c"])


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``y`` may be linked with ``x`` (one row, or one for each), a batch of values after the other."""
    left, matches, before = np.arange(len(y)), np.zeros(len(y), np.int64), 0
    for upto in STEPS:
        own = x[left, before:upto] if x.ndim == 2 else x[before:upto]
        matches = matches + (own == y[left, before:upto]).sum(axis=1)
        stay = matches >= least_matches(upto)
        left, matches, before = left[stay], matches[stay], upto
    return left


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar at all."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the signatures don't rule out."""
    for batch in batches:
        if batch.num_rows:
            fits = np.flatnonzero(_fits(np.asarray(batch.column("n_a"), np.int64), np.asarray(batch.column("n_b"), np.int64)))
            batch = batch.take(pa.array(fits))
            keep = pa.array(_possible(_matrix(batch.column("values_a")), _matrix(batch.column("values_b"))))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, starts, ends in tb.sliced(batch, limit=_SLICE):
            members, sizes = shingles(buf, starts, ends)
            last = np.cumsum(sizes)
            packed = pa.array([members[a:b].tobytes() for a, b in zip((last - sizes).tolist(), last.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sizes), *map(pa.array, _sums(members, sizes)), packed], names=["n", "s1", "s2", "members"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("members_a"), batch.column("members_b")):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            good.append(bool(similar(len(a), len(b), int((b[at] == a).sum()))))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([np.asarray(batch.column(k), np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            mark = tuple(marks[i].tolist())
            if held and mark != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = mark
    if held:
        yield pa.Table.from_batches(held)


def _tile(table: pa.Table):
    """Classes, sizes, components and the two sides of a tile."""
    ids, n, comp, chunk = (np.asarray(table.column(c), np.int64) for c in ("c", "n", "component", "chunk"))
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    return ids, n, comp, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of tiles that may be linked with a member of another component whose first common band this is."""
    for table in _groups(batches, ("key", "i", "j")):
        ids, n, comp, left, right = _tile(table)
        values, band = _matrix(table.column("values").combine_chunks()), table.column("band")[0].as_py()
        taken = np.zeros(len(ids), bool)
        for x in left:
            y = right[(comp[right] != comp[x]) & _fits(n[right], n[x])]
            y = y[_possible(values[x], values[y])]
            if len(y):
                bands = (values[y] == values[x]).reshape(len(y), BANDS, BAND_ROWS).all(axis=2)
                y = y[bands.argmax(axis=1) == band]
                taken[x] |= len(y) > 0
                taken[y] = True
        if taken.any():
            yield from table.drop_columns(["values", "band"]).filter(pa.array(taken)).combine_chunks().to_batches()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a tile by whole sets, as many as join its components: no more than it has members.

    An index from members of sets to the tile's right side counts what a set shares with all of them.
    """
    for table in _groups(batches, ("key", "i", "j")):
        ids, n, comp, left, right = _tile(table)
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in table.column("members")]
        a, b = [], []
        if len(left) and len(right):
            hashes = np.concatenate([sets[r] for r in right])
            owners = np.repeat(right, [len(sets[r]) for r in right])
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            _, root = np.unique(comp, return_inverse=True)
            for x in left:
                y = right[(root[right] != root[x]) & _fits(n[right], n[x])]
                if not len(y):
                    continue
                lo, hi = np.searchsorted(hashes, sets[x], "left"), np.searchsorted(hashes, sets[x], "right")
                many = hi - lo
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both = np.bincount(owners[at], minlength=len(ids))[y]
                for z in y[similar(n[x], n[y], both)]:
                    if root[z] != root[x]:
                        a.append(ids[x])
                        b.append(ids[z])
                        root[root == root[z]] = root[x]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


# ---------------------------------------------------------------- join


def _sided(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(F.col("c").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


class _Texts:
    """The exact sets of classes, read from the table for those that some pair needs."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes

    def sets(self, wanted: DataFrame) -> DataFrame:
        """c and members of the classes ``wanted``."""
        wanted = stable(self.classes.select("c", "id", "n", "s1", "s2").join(wanted.select("c").distinct(), "c"))
        texts = join_checked(self.rows, wanted.select("id").distinct(), ["id"])
        sets = texts.mapInArrow(_sets, "n long, s1 long, s2 long, members binary").join(wanted.drop("id"), ["n", "s1", "s2"])
        return stable(sets.select("c", "members").dropDuplicates(["c"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, by their whole sets."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("c")))
        both = pairs.join(_sided(sets, "b", "members"), "b").join(_sided(sets, "a", "members"), "a")
        return both.select("a", "b", "members_a", "members_b").mapInArrow(_linked, "a long, b long")


def _reached(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Class and component of every class."""
    found = components(links).withColumnRenamed("id", "c")
    return stable(classes.select("c").join(found, "c", "left").select("c", F.coalesce("component", "c").alias("component")))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id and kept of every row; kept is true for the least key of a component.

    Documents are linked where their sets of 4-word shingles have a similarity of 0.8 or more. Equal
    sets form a class first. Each class has 128 MinHash values in 32 bands; classes that share a band are
    candidates. In each band every member is compared with the least one only, so a group of copies makes
    as many pairs as it has members; where members are then still in different components, all pairs
    between those components are compared too, in tiles, each pair in the first band that it shares. Sets
    go only to tiles with possible pairs, which are confirmed there; a tile gives no more links than join
    its components.

    A candidate pair is verified in steps: after 16, 32, 64 and 128 values it is dropped if the posterior
    probability of a similarity of 0.8 is below ``MISS``. Survivors are confirmed on whole sets of 64-bit
    hashes, so no link is wrong. A link of similarity 0.8 is missed with a probability of about 5e-8 (no
    common band), less for a higher one.

    Null and empty texts and texts of white space have no shingles: size 0, linked with nothing, their own
    component, kept. Rows with a null key get a null component, link nothing and are kept. Rows with equal
    keys are one node: their sets all count for it. A very long text is read whole. An empty table gives
    an empty one. Other columns are left out.
    """
    rows = df.select(df[key].cast("bigint").alias("id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    info = stable(rows.mapInArrow(_signed, "id long, n long, s1 long, s2 long, values binary"))
    usable = info.filter("n > 0 and id is not null")
    classes = usable.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.max("values").alias("values"))  # equal sets, equal values
    classes = stable(classes.withColumn("c", F.monotonically_increasing_id()))
    exact = _Texts(rows.filter("id is not null"), classes)

    entries = classes.select("c", "values").mapInArrow(_banded, "key long, band tinyint, c long")
    least = entries.groupBy("key").agg(F.min("c").alias("center"), F.count("*").alias("members")).filter("members > 1")
    shared = stable(entries.join(least, "key").select("key", "band", "c", "center").filter("c <> center"))
    proposed = shared.select(F.col("center").alias("a"), F.col("c").alias("b")).distinct()
    likely = proposed.join(_sided(classes, "b", "n", "values"), "b").join(_sided(classes, "a", "n", "values"), "a")
    likely = stable(likely.select("a", "b", "n_a", "n_b", "values_a", "values_b").mapInArrow(_plausible, "a long, b long"))

    own = stable(usable.select("id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "c"), ["n", "s1", "s2"]).select("id", "c").distinct())
    several = own.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("most")).filter("a < most")
    one_node = own.join(several, "id").select("a", F.col("c").alias("b")).filter("a <> b")  # equal keys
    links = stable(exact.links(likely).union(one_node))
    comps = _reached(links, classes)
    members = shared.select("key", "band", "c").join(comps, "c")
    still = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi")
    chunks = F.ceil(F.col("members") / _TILE).cast("int")
    tiles = members.join(still.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("key", "band", "c", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    together = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    tiles = tiles.join(classes.select("c", "n", "values"), "c")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema if f.name not in ("values", "band"))
    tiles = stable(together(tiles).mapInArrow(_open, kind))
    if not tiles.isEmpty():
        more = together(tiles.join(exact.sets(tiles), "c")).mapInArrow(_confirmed, "a long, b long")
        comps = _reached(stable(links.union(more)), classes)

    nodes = own.join(comps, "c")
    first = nodes.groupBy("component").agg(F.min("id").alias("first"))
    found = nodes.join(first, "component").groupBy("id").agg(F.min("first").alias("first"))
    out = info.select("id", "n").join(found, "id", "left").withColumn("component_id", F.coalesce("first", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query("op12_minhash_dedup")
def op12(spark, sf_dir):
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
