import random
import re
from collections import Counter

import numpy as np

from waxworks.llm import quality_rules as qr
from waxworks.llm import textbytes as tb


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = set()
        for i in range(len(words) - n + 1):
            if grams[tuple(words[i : i + n])] > 1:
                hit.update(range(i, i + n))
        return hit

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, own))
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeat = len(covered(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    share = lambda x: x / max(1, chars)
    kept = not failed and share(dup_chars) <= qr.LINE_LIMIT
    kept = kept and all(share(sum(len(words[i]) for i in covered(n))) <= limit for n, limit in qr.NGRAM_LIMITS.items())
    return len(words), chars, symbols, dup, repeat, failed, kept


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdé#") for _ in range(rnd.randrange(1, 6)))
    out = []
    for _ in range(120):
        vocabulary = [word() for _ in range(rnd.choice([5, 40, 3000]))]
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))) for _ in range(rnd.randrange(1, 12))]
        out.append(rnd.choice(["\n", " \n", "\r\n", "\t"]).join(lines + rnd.choices(lines, k=rnd.randrange(3))))
    return out + ["", None, " \n\t ", "a", "a b c a b c", "x\n" * 70, "  lead\n  lead", "\x0b\x0c", "é " * 60, "w" * 100_000]


def test_same_as_brute_force(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = {r["doc_id"]: tuple(r)[1:] for r in qr.quality_rules(df).select(*names).collect()}
    assert [got[i] for i in range(len(given))] == [brute(t) for t in given]


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", 3, "t"), (1, None, 4, None), (1, None, 4, None)], "doc_id long, text string, n_words int, kept string")
    got = qr.quality_rules(df)
    assert [(r["n_words"], r["kept"]) for r in got.collect()] == [(2, False), (0, False), (0, False)] and len(set(got.columns)) == len(got.columns)
    assert qr.quality_rules(df.filter("false")).collect() == [] and qr.keep_good(df).columns == df.columns


def test_long_lines_have_one_hash():
    rng = np.random.default_rng(4)
    for size in (1_500_000, 1 << 20, (1 << 20) + 1, 3_000_000):
        long = rng.integers(97, 123, size).astype(np.uint8).tobytes()
        for gap in (0, 100_000, 1_900_000):
            raw = b"short line\n" * (gap // 11) + long + b"\n" + long + b"\n" + b"end\n" + long
            buf = np.frombuffer(raw, np.uint8)
            starts, ends, _ = tb.lines(buf, np.array([0]), np.array([len(buf)]))
            hashes = tb.hash_ranges(buf, starts, ends)[ends - starts == size]
            assert len(hashes) == 3 and len(set(hashes.tolist())) == 1
