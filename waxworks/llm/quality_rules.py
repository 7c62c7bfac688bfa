"""Repetition coverage and base rules of quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.registry import query

#: Share of a text's word characters that may lie inside repeated n-grams of so many words.
NGRAM_LIMITS = {5: 0.35, 8: 0.30, 12: 0.25}
#: Share of a text's word characters that may lie in lines that repeat an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    + ", ".join(f"coverage_{n} double" for n in NGRAM_LIMITS)
    + ", line_coverage double, symbol_ratio double, kept boolean"
)
_FIELDS = [x.strip().split() for x in SCHEMA.split(",")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its row has twice or more."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    size = len(hashes) - n + 1
    if size <= 0:
        return covered[:-1].astype(bool)
    rolled = row[:size].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(n):  # windows of words, by a polynomial in the hashes of the words
        rolled = rolled * np.uint64(0xA0761D6478BD642F) + hashes[i : i + size]
    rolled = tb.mix(rolled)
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    order = at[np.argsort(rolled[at], kind="stable")]
    same = rolled[order[1:]] == rolled[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    covered[hit] += 1  # windows start once at most
    np.subtract.at(covered, hit + n, 1)
    return np.cumsum(covered)[:-1] > 0


def _earlier(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of their row."""
    key = tb.mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def measure(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of ``SCHEMA`` for the rows whose texts lie in ``buf``."""
    rows = len(starts)
    total = lambda row, weight=None: np.bincount(row, weight, rows)
    ws, we, row = tb.words(buf, starts, ends)
    points = tb.code_points(buf)
    chars = (points[we] - points[ws]).astype(np.float64)
    hashes = tb.hash_ranges(buf, ws, we)
    n_words, word_chars = total(row), total(row, chars)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    ls, le, line_row = tb.lines(buf, starts, ends)
    full = tb.counts_in(ws, ls, le) > 0
    ls, le, line_row = ls[full], le[full], line_row[full]
    again = _earlier(tb.hash_ranges(buf, ls, le), line_row)
    before = np.concatenate([[0.0], np.cumsum(chars)])
    line_chars = before[np.searchsorted(ws, le)] - before[np.searchsorted(ws, ls)]
    repeat = total(row, _repeated(hashes, row, 3).astype(np.float64))
    share = lambda x: x / np.maximum(word_chars, 1)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[ends] - symbols[starts],
        "n_dup_lines": total(line_row, again.astype(np.float64)), "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words),
        "line_coverage": share(total(line_row, again * line_chars)),
    }
    out["symbol_ratio"] = out["n_symbols"] / np.maximum(n_words, 1)
    good = ~out["base_failed"] & (out["line_coverage"] <= LINE_LIMIT)
    for n, limit in NGRAM_LIMITS.items():
        out[f"coverage_{n}"] = share(total(row, _repeated(hashes, row, n) * chars))
        good &= out[f"coverage_{n}"] <= limit
    return out | {"kept": good}


def _measured(text: str):
    """Every row with its measures; the text is the column of that name and travels once."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, starts, ends in tb.sliced(batch, text):
                got = measure(buf, starts, ends)
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array(got[n].astype(_ARROW[t].to_pandas_dtype())) for n, t in _FIELDS],
                    names=part.schema.names + [n for n, _ in _FIELDS],
                )

    return measured


def _kept(text: str):
    """The rows that are kept, as they came."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, starts, ends in tb.sliced(batch, text):
                yield part.filter(pa.array(measure(buf, starts, ends)["kept"]))

    return kept


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Measure every text; columns of ``SCHEMA`` replace columns of the same names, all others stay.

    Rolling hashes of runs of 5, 8 and 12 words tell which characters of a text lie inside n-grams that
    the text has more than once, and hashes of lines which lie in repeated lines. A text is kept unless
    the base rules fail it (under 50 words, or over half of them in repeated 3-word windows) or one of
    these shares is above its limit. The share of symbols to words is reported only.

    Null and empty texts have no words, so they fail; a text is read whole, whatever its length; repeated
    rows get equal results; an empty table gives an empty one. One pass, no shuffle, no state.
    """
    names = {n for n, _ in _FIELDS}
    others = [c for c in df.columns if c not in names]
    source = df.select(*tb.numbered(df, others), *([] if text in others else [F.col(f"`{text}`").alias("_text")]))
    at = f"c{others.index(text)}" if text in others else "_text"
    measured = source.mapInArrow(_measured(at), f"{tb.ddl(source)}, {SCHEMA}").drop("_text")
    return measured.toDF(*others, *[n for n, _ in _FIELDS])


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that ``quality_rules`` keeps, with the columns of ``df``, whatever their names.

    Each row is judged by its own text: nulls, empty texts and repeated rows as there; an empty table gives
    an empty one.
    """
    source = df.select(*tb.numbered(df, df.columns))
    good = source.mapInArrow(_kept(f"c{df.columns.index(text)}"), tb.ddl(source))
    return good.toDF(*df.columns)


@query("op10_quality_rules")
def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")
