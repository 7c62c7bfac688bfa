"""Repair of the turn structure of conversations by a run-length min-plus dynamic programme."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.llm.registry import query
from waxworks.operators.joins import join_checked
from waxworks.session import stable

#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space, and the ends that a whole text has.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"

FAULTS = ("blank", "duplicate", "truncated")
_LEADS = 64  # characters of role and text by which rows of one turn are dealt over partitions

# States: nothing yet, after the system, after a user, after an assistant. Roles: system, user, assistant, other.
_INF = 1 << 40
_KEEPS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})  # by state: role -> next state
_NEXT = (2, 2, 3, 2)  # where a user or an assistant, whichever may come, leads
_ROLE = ("user", "user", "assistant", "user")
#: Cost to go after the last row: insertions that end in an assistant, nothing where nothing stands.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbol of a row that has to go; the others are 1 + 2 * role + truncated.
MUST_GO = 0


def _times(a, b):
    """Min-plus product."""
    return tuple(tuple(min(x + y for x, y in zip(row, column)) for column in zip(*b)) for row in a)


def _apply(a, v):
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


_NOTHING = tuple(tuple(0 if i == j else _INF for j in range(4)) for i in range(4))


def _insertions():
    one = [[_INF] * 4 for _ in range(4)]
    for s in range(4):
        one[s][s] = 0
        one[s][_NEXT[s]] = INSERT
    return _times(one, one)  # two lead from every state to every other that can be reached


@lru_cache(maxsize=None)
def power(symbol: int, k: int):
    """Min-plus transition of a run of 2**k equal symbols: any insertions before each row, and its edit."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    edit = [[_INF] * 4 for _ in range(4)]
    for s in range(4):
        edit[s][s] = DELETE
        if symbol != MUST_GO:
            role, worse = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
            edit[s][_NEXT[s]] = min(edit[s][_NEXT[s]], REROLE + worse)
            if role in _KEEPS[s]:
                edit[s][_KEEPS[s][role]] = min(edit[s][_KEEPS[s][role]], worse)
    return _times(_insertions(), edit)


def _before(symbol: int, count: int, after):
    """Cost to go before a run, from that after it: one cached power for each binary digit of its length."""
    k = 0
    while count:
        if count & 1:
            after = _apply(power(symbol, k), after)
        count >>= 1
        k += 1
    return after


def matrix(runs):
    """The min-plus transition of all runs in order."""
    out = _NOTHING
    for symbol, count in runs:
        k = 0
        while count:
            if count & 1:
                out = _times(out, power(symbol, k))
            count >>= 1
            k += 1
    return out


def _edit(symbol: int, state: int, here, after):
    """The least of the cheapest ways through one row: its edits, and the state after it."""
    made = ""
    while True:
        if DELETE + after[state] == here[state]:
            return made + "D", state
        if INSERT + here[_NEXT[state]] == here[state]:
            made, state = made + "I", _NEXT[state]
            continue
        role, worse = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        to = _KEEPS[state].get(role)
        if to is not None and worse + after[to] == here[state]:
            return made + "K", to
        return made + "R", _NEXT[state]


def _unrolled(symbol: int, count: int, state: int, after, out: list) -> int:
    """Edits of the rows of a run. A long run is halved, so that few costs are held at a time."""
    if count > 32:
        half = count // 2
        state = _unrolled(symbol, half, state, _before(symbol, count - half, after), out)
        return _unrolled(symbol, count - half, state, after, out)
    costs = [after]
    for _ in range(count):
        costs.append(_apply(power(symbol, 0), costs[-1]))
    for left in range(count, 0, -1):
        edits, state = _edit(symbol, state, costs[left], costs[left - 1])
        out.append(edits)
    return state


def unroll(runs, state: int = 0, after=END):
    """Edits of each row of the runs, and the state they end in, for the cheapest way; ties go to the least in ASCII.

    A row's edits are any insertions before it and its own letter. What comes after the runs counts by
    ``after``, the cost to go from each state.
    """
    costs = [after]
    for symbol, count in reversed(runs):
        costs.append(_before(symbol, count, costs[-1]))
    out: list = []
    for i, (symbol, count) in enumerate(runs):
        state = _unrolled(symbol, count, state, costs[len(runs) - 1 - i], out)
    return out, state


@lru_cache(maxsize=1 << 16)
def _whole(runs: tuple):
    """Edits of a whole conversation, kept for others of the same runs, and the insertions at its end."""
    edits, state = unroll(runs)
    return tuple(edits), _closing(state)


def _closing(state: int) -> str:
    return "I" * (END[state] // INSERT)


# ---------------------------------------------------------------- tasks


def _runs(symbols: np.ndarray, copies: np.ndarray) -> tuple:
    """(symbol, count) of equal consecutive rows; copies of a row after its first have to go."""
    pairs = np.stack([symbols, np.full_like(symbols, MUST_GO)], 1).ravel()
    counts = np.stack([np.ones_like(copies), copies - 1], 1).ravel()
    pairs, counts = pairs[counts > 0], counts[counts > 0]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return tuple(zip(pairs[first].tolist(), np.add.reduceat(counts, first).tolist()))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each conversation in a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.asarray(batch.column("conv").dictionary_encode(null_encoding="encode").indices)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            part = batch.slice(i, j - i)
            if held and not held[-1].column("conv")[-1:].equals(part.column("conv")[:1]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _symbols(table: pa.Table) -> tuple:
    return _runs(np.asarray(table.column("symbol"), np.int64), np.asarray(table.column("copies"), np.int64))


_EDGE = "pid int, opens boolean, last_initial string, cost array<bigint>, runs binary"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition and runs of a partition's first and last conversation, which may go on in its neighbours."""
    pid, before = TaskContext.get().partitionId(), None
    for n, table in enumerate(_segments(batches)):
        if n == 0:
            yield _edge(pid, table, True)
        before = table if n else None
    if before is not None:
        yield _edge(pid, before, False)


def _edge(pid: int, table: pa.Table, opens: bool) -> pa.RecordBatch:
    runs = _symbols(table)
    row = {
        "conv": table.column("conv")[0].as_py(), "pid": pid, "opens": opens, "last_initial": table.column("initial")[-1].as_py(),
        "cost": [c for line in matrix(runs) for c in line], "runs": np.array(runs, np.int64).tobytes(),
    }
    kinds = [("conv", table.schema.field("conv").type), ("pid", pa.int32()), ("opens", pa.bool_()), ("last_initial", pa.string()), ("cost", pa.list_(pa.int64())), ("runs", pa.binary())]
    return pa.RecordBatch.from_pylist([row], pa.schema(kinds))


def _exits(shared):
    """For each state in which a segment may begin, the state in which its cheapest edits end."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = shared.value.get((row["pid"], row["opens"]))
                if known:
                    runs = [tuple(x) for x in np.frombuffer(row["runs"], np.int64).reshape(-1, 2).tolist()]
                    ends = [unroll(runs, s, known["after"])[1] for s in range(4)]
                    yield pa.RecordBatch.from_pylist([{"pid": row["pid"], "opens": row["opens"], "ends": ends}], pa.schema([("pid", pa.int32()), ("opens", pa.bool_()), ("ends", pa.list_(pa.int32()))]))

    return exits


_EDITS = "pid int, n long, edit string, times long, turn long, role string, text string, fault string, copies long, illegal long, cost long"


def _repaired(shared):
    """Edits of every conversation's rows in a partition, in order."""

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n, opens = TaskContext.get().partitionId(), 0, True
        kinds = [(c, k) for c, k in zip((x.split()[0] for x in _EDITS.split(", ")), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
        held, size = [], 0
        for table in _segments(batches):
            conv = table.column("conv").combine_chunks()
            known = shared.value.get((pid, opens), {})  # a later one is meant for the last conversation only
            rows = _edited(table, known if known and conv[0].as_py() == known["conv"] else {}, pid, n)
            n, opens = n + len(rows), False
            out = pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
            held.append(out.add_column(0, pa.field("conv", conv.type), conv[:1].take(pa.array([0] * len(rows)))))
            size += len(rows)
            if size > 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return repaired


def _edited(table: pa.Table, known: dict, pid: int, n: int) -> list[dict]:
    runs, state = _symbols(table), known.get("state", 0)
    if known:
        edits, left = unroll(runs, state, known["after"])
        closing = "" if known["goes_on"] else _closing(left)
    else:
        edits, closing = _whole(runs)
    out: list[dict] = []

    def add(edit, role, text, cost, **more):
        out.append({"pid": pid, "n": n + len(out), "edit": edit, "times": 1, "role": role, "text": text, "copies": 0, "illegal": 0, "cost": cost} | more)

    def insert(state):
        add("I", _ROLE[state], "", INSERT)
        return _NEXT[state]

    at, last = 0, known.get("initial")
    for row in table.select(["turn", "role", "text", "initial", "fault", "symbol", "copies"]).to_pylist():
        edit = edits[at]
        for _ in edit[:-1]:
            state = insert(state)
        wrong = int(last is not None and last + row["initial"] not in ("su", "ua", "au"))
        mark = {"turn": row["turn"], "fault": row["fault"], "copies": 1, "illegal": wrong}
        worse = TRUNCATED if row["fault"] == "truncated" else 0
        if edit[-1] == "D":
            add("D", row["role"], None, DELETE, **mark)
        elif edit[-1] == "R":
            add("R", _ROLE[state], row["text"], REROLE + worse, **mark)
            state = _NEXT[state]
        else:
            add("K", row["role"], row["text"], worse, **mark)
            state = _KEEPS[state]["sua".index(row["initial"])]
        more = row["copies"] - 1
        if more:  # equal rows follow; each of them goes
            again = "blank" if row["fault"] == "blank" else "duplicate"
            add("D", row["role"], None, DELETE * more, turn=row["turn"], fault=again, copies=more, times=more, illegal=more)
        at += row["copies"]
        last = row["initial"]
    for _ in closing:
        state = insert(state)
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of the repaired lines of each conversation of a sorted partition, as a stream."""
    conv, audit, digest, any_line = None, [], hashlib.sha256(), False
    schema = None

    def done():
        return pa.RecordBatch.from_pylist([{"conv": conv[0].as_py(), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        schema = pa.schema([("conv", batch.schema.field("conv").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        convs = batch.column("conv")
        codes = np.asarray(convs.dictionary_encode(null_encoding="encode").indices)
        starts = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else []
        for i, (edit, times, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("edit", "times", "role", "text")))):
            if starts[i] and (conv is None or not conv.equals(convs[i : i + 1])):
                if conv is not None:
                    yield done()
                conv, audit, digest, any_line = convs[i : i + 1], [], hashlib.sha256(), False
            audit.append(edit * times)
            if edit != "D":
                digest.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                any_line = True
    if conv is not None:
        yield done()


# ---------------------------------------------------------------- jobs


def _named(df: DataFrame, name: str):
    return df[f"`{name}`"]


def faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each different row once: conv, turn, role, text, copies, initial of the role, fault and symbol.

    The fault is that of the first copy: blank (no character but white space), duplicate (role and text
    stand at an earlier turn of the conversation), truncated (the last character is none of ``.!?``) or
    null. Null roles and texts count as one space.
    """
    rows = df.select(
        _named(df, conv).alias("conv"), _named(df, turn).cast("bigint").alias("turn"),
        *[F.coalesce(_named(df, c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = stable(rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("mark", mark))
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")  # null turns come first
    again = rows.groupBy("conv", "mark").agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    keys = [F.col("conv").isNull().alias("no_conv"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("known"), "mark"]
    again = again.select(*keys, "first")
    rows = join_checked(rows.select("*", *keys[:2]), again, ["no_conv", "known", "mark"], "left")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(bare == "", "blank").when(F.col("first").isNotNull() & (place != F.col("first")), "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated")
    )
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), MUST_GO).otherwise(1 + 2 * kind + (F.coalesce(F.col("fault") == "truncated", F.lit(False))).cast("int"))
    rows = rows.withColumn("fault", fault).withColumns({"initial": initial, "symbol": symbol})
    return rows.select("conv", "turn", "role", "text", "copies", "initial", "fault", F.col("symbol").cast("int").alias("symbol"))


def _context(spark, edges: DataFrame) -> dict:
    """What the parts of conversations that lie in several partitions have to know of the others.

    Two small rows of each partition come to the driver: its first and its last conversation.
    """
    found = edges.select("pid", "opens", "conv", "last_initial", "cost").orderBy("pid", F.desc("opens")).collect()
    chains: list[list] = []
    for row in found:
        if chains and chains[-1][-1]["pid"] != row["pid"] and chains[-1][-1]["conv"] == row["conv"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    known: dict = {}
    for chain in (c for c in chains if len(c) > 1):
        after = END
        for i in range(len(chain) - 1, -1, -1):
            row = chain[i]
            known[row["pid"], row["opens"]] = {"conv": row["conv"], "after": after, "goes_on": i < len(chain) - 1, "initial": chain[i - 1]["last_initial"] if i else None, "state": 0}
            cost = [tuple(row["cost"][4 * k : 4 * k + 4]) for k in range(4)]
            after = _apply(cost, after)
    if known:
        shared = spark.sparkContext.broadcast(known)
        ends = {(r["pid"], r["opens"]): r["ends"] for r in edges.mapInArrow(_exits(shared), "pid int, opens boolean, ends array<int>").collect()}
        for chain in (c for c in chains if len(c) > 1):
            state = 0
            for row in chain:
                known[row["pid"], row["opens"]]["state"] = state
                state = ends[row["pid"], row["opens"]][state]
    return known


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits that make each conversation's roles ``(s?(ua)+)?``, one row for each edit, in order.

    Columns: conv, pid and n (the order), edit (K keep, R rerole, D delete, I insert), times (of equal
    deletions in a row), turn, role and text after the edit (text null where deleted), fault (blank,
    duplicate, truncated or null) of ``copies`` rows, illegal (how many of them follow a row whose role
    they must not follow) and cost. Among equally cheap edits the least letters in ASCII win.

    Rows go by turn, nulls first, then by role and text; equal rows stand beside each other. They are
    dealt by ranges of that order, so a conversation of any length lies in as many partitions as it
    fills. Equal consecutive symbols (role and fault) are one run, whose min-plus transition comes from
    cached binary powers; the parts of a conversation in different partitions meet as one 4 x 4 matrix
    each (two for a partition), and each part unrolls its own choices. A task holds at most the part of
    one conversation that lies in its partition.

    Null roles and texts count as one space (so they are blank), null turns come first, a null
    conversation is one of its own. Very long texts are read whole. An empty table gives no rows; other
    columns have no effect.
    """
    spark = df.sparkSession
    known = faults(df, conv, turn, role, text)
    lead = F.left("role", F.lit(_LEADS))
    ranges = [F.col("conv"), F.col("turn"), lead, F.when(F.length("role") < _LEADS, F.left("text", F.lit(_LEADS))).otherwise("")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stable(known.repartitionByRange(parts, *ranges).sortWithinPartitions("conv", "turn", "role", "text"))
    kind = placed.schema["conv"].dataType.simpleString()
    edges = stable(placed.select("conv", "initial", "symbol", "copies").mapInArrow(_edges, f"conv {kind}, {_EDGE}"))
    shared = spark.sparkContext.broadcast(_context(spark, edges))
    return stable(placed.mapInArrow(_repaired(shared), f"conv {kind}, {_EDITS}"))


def report(edits: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal and cost of every conversation of ``repair``.

    Gaps are the numbers missing between the least and the largest turn; null turns don't count.
    """
    total = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0)).cast("bigint").alias
    by_turn = edits.groupBy("conv", "turn").agg(
        *[total("copies", F.col("fault") == f)(f) for f in FAULTS], total("illegal")("illegal"), total("cost")("cost")
    )
    gap = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return by_turn.groupBy("conv").agg(F.coalesce(gap, F.lit(0)).cast("bigint").alias("gaps"), *[F.sum(c).cast("bigint").alias(c) for c in (*FAULTS, "illegal", "cost")])


def digests(edits: DataFrame) -> DataFrame:
    """conv, audit (letters of its edits in order) and SHA-256 of its repaired lines ``role:text``.

    The lines of a conversation pass through one task as a stream, as their one hash needs.
    """
    kind = edits.schema["conv"].dataType.simpleString()
    placed = edits.select("conv", "pid", "n", "edit", "times", "role", "text").repartition("conv").sortWithinPartitions("conv", "pid", "n")
    return placed.mapInArrow(_joined, f"conv {kind}, audit string, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space."""
    said = {c: F.coalesce(df[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    hit = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = df.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), hit.alias("hit")).filter("hit <> 0")
    again = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


_CRC = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

_SQL = rf"""
WITH RECURSIVE {_CRC}, src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hit AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM src, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, LATERAL (SELECT unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END))) WHERE h <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM placed
), ins(state, letters, price, lines, mid) AS (VALUES
  (0, '', 0, '', 0), (0, 'I', 5, 'user:' || chr(10), 2), (0, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10), 3),
  (1, '', 0, '', 1), (1, 'I', 5, 'user:' || chr(10), 2), (1, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10), 3),
  (2, '', 0, '', 2), (2, 'I', 5, 'assistant:' || chr(10), 3), (3, '', 0, '', 3), (3, 'I', 5, 'user:' || chr(10), 2)
), edits(mid, letter, needs, price, role, state) AS (VALUES
  (0, 'D', NULL, 2, NULL, 0), (1, 'D', NULL, 2, NULL, 1), (2, 'D', NULL, 2, NULL, 2), (3, 'D', NULL, 2, NULL, 3),
  (0, 'K', 's', 0, NULL, 1), (0, 'K', 'u', 0, NULL, 2), (1, 'K', 'u', 0, NULL, 2), (2, 'K', 'a', 0, NULL, 3), (3, 'K', 'u', 0, NULL, 2),
  (0, 'R', NULL, 1, 'user', 2), (1, 'R', NULL, 1, 'user', 2), (2, 'R', NULL, 1, 'assistant', 3), (3, 'R', NULL, 1, 'user', 2)
), path AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS body FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, min(cost), arg_min(audit, {{'c': cost, 'a': audit}}), arg_min(body, {{'c': cost, 'a': audit}}) FROM (
    SELECT p.conv_id, f.pos, e.state, p.cost + i.price + e.price + CASE WHEN f.fault = 't' AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost,
      p.audit || i.letters || e.letter AS audit,
      p.body || i.lines || CASE WHEN e.letter = 'D' THEN '' ELSE coalesce(e.role, f.role) || ':' || f.text || chr(10) END AS body
    FROM path p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN ins i ON i.state = p.state
    JOIN edits e ON e.mid = i.mid AND (e.needs IS NULL OR e.needs = f.r) AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd'))
  ) GROUP BY conv_id, pos, state
), ended AS (
  SELECT p.conv_id, min(p.cost + i.price) AS cost, arg_min(p.audit || i.letters, {{'c': p.cost + i.price, 'a': p.audit || i.letters}}) AS audit,
    arg_min(p.body || i.lines, {{'c': p.cost + i.price, 'a': p.audit || i.letters}}) AS body
  FROM path p JOIN ins i ON i.state = p.state AND i.mid IN (0, 3)
  WHERE p.pos = (SELECT count(*) FROM faulty f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY p.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || r NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.cost::BIGINT AS cost, audit,
  sha256(CASE WHEN body = '' THEN '' ELSE left(body, length(body) - 1) END) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def repaired_conversations(damaged: DataFrame, known: DataFrame) -> DataFrame:
    """The report and digests of every conversation of ``known`` (conv_id); those without rows get zeros and empty texts."""
    edits = repair(damaged)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    counts = report(edits).withColumnRenamed("conv", "c1")
    texts = digests(edits).withColumnRenamed("conv", "c2")
    out = known.join(counts, same("conv_id", "c1"), "left").join(texts, same("conv_id", "c2"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op13_chat_repair", _SQL)
def op13(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_conversations(damage(rows), rows.select("conv_id").distinct())
