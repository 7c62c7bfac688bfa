import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest

from waxworks.llm import chat_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if hit:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def marks(rows):
    """Fault of each row, in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) over all edits, one row after the other, with the repaired lines."""
    steps = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = []

        def add(cost, letter, line, rest):
            found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            worse = 5 * (faults[i] == "truncated")
            add(2, "D", (), best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                step = steps[state]
                add(1 + worse, "R", (f"{names[step]}:{text}",), best(i + 1, to[step], 0))
                if role[:1] == "s" and state == 0:
                    add(worse, "K", (f"{role}:{text}",), best(i + 1, 1, 0))
                if role[:1] == step:
                    add(worse, "K", (f"{role}:{text}",), best(i + 1, to[step], 0))
        if inserted < 3:
            step = steps[state]
            add(5, "I", (f"{names[step]}:",), best(i, to[step], inserted + 1))
        return min(found) if found else (10**9, "", ())

    return best(0, 0, 0)


def brute(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=key)
        faults = marks(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, lines = cheapest(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in cr.FAULTS], illegal, cost, audit, digest)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, symbol int, conv string")
    out = cr.repaired_conversations(cr.damage(df), df.select("conv_id").distinct())
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def conversation(rnd, conv, length):
    texts = ["Yes.", "No!", "well", "so", "Why? \n", "", " \t", None, "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(conv, t if rnd.random() < 0.95 else None, roles[t % 2] if rnd.random() < 0.7 else rnd.choice(roles), f"{t}." if rnd.random() < 0.6 else rnd.choice(texts)) for t in range(length)]


def test_same_as_brute_force(spark):
    rnd = random.Random(3)
    rows = [r for conv in range(120) for r in conversation(rnd, conv, rnd.randrange(1, 9))]
    rows += conversation(rnd, None, 7) + rows[:5]  # a null key and repeated rows
    assert run(spark, rows) == brute(rows)


def test_a_conversation_over_many_partitions(spark):
    rnd = random.Random(5)
    rows = conversation(rnd, 7, 400) + [r for conv in (3, 9, 11) for r in conversation(rnd, conv, 5)]
    rows += [(7, 401, "user", "again") for _ in range(60)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(8))
def test_runs_and_powers_give_the_same_edits(seed):
    rnd = random.Random(seed)
    runs = [(rnd.randrange(9), rnd.choice([1, 1, 2, 3, 40])) for _ in range(rnd.randrange(1, 7))]
    runs = [(s, sum(n for _, n in g)) for s, g in groupby(runs, key=lambda r: r[0])]
    flat = [s for s, n in runs for _ in range(n)]
    after = cr.END
    costs = [after]
    for symbol in reversed(flat):
        costs.append(cr._apply(cr.power(symbol, 0), costs[-1]))
    assert cr._apply(cr.matrix(runs), cr.END) == costs[-1]
    plain, state = [], 0
    for i, symbol in enumerate(flat):
        edits, state = cr._edit(symbol, state, costs[len(flat) - i], costs[len(flat) - i - 1])
        plain.append(edits)
    assert cr.unroll(runs) == (plain, state)
    cut = len(runs) // 2  # two parts, as in two partitions
    middle = cr._apply(cr.matrix(runs[cut:]), cr.END)
    first, state = cr.unroll(runs[:cut], 0, middle)
    assert first + cr.unroll(runs[cut:], state)[0] == plain


def test_odd_tables(spark):
    assert run(spark, []) == {}
    long = "word " * 200_000 + "end."
    rows = [(1, None, "user", long), (1, None, "assistant", long), (2, 5, None, None), (2, 5, None, None), (None, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_edits_keep_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "No end"), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = [(r["edit"], r["role"], r["text"], r["cost"], r["fault"]) for r in cr.repair(df).orderBy("pid", "n").collect()]
    assert got == [("K", "user", "Hi.", 0, None), ("D", "user", None, 2, "truncated"), ("K", "assistant", "Yes.", 0, None)]
