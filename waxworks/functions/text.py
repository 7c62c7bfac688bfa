"""Title clean-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a listing title.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "this", "but", "or", "records", "record",
    "vinyl", "lp", "album", "rare", "grail", "import", "promo", "pressing",
    "press", "reissue", "original", "og", "limited", "edition", "sealed", "new",
    "read", "plz", "please", "look", "mint", "nm", "near", "vg", "ex",
    "excellent", "good", "fair", "poor", "better", "best", "condition",
    "grade", "graded", "12", "7", "10", "45", "inch", "albums",
)


def title_words(text: Column) -> Column:
    """Distinct lower-case words of a title, in order of appearance, without stop words and single letters."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.array_except(words, stops), lambda w: F.length(w) > 1)


_BYTES_AT_ONCE = 1 << 22
_LETTERS = np.array([ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else 0 for b in range(256)], np.uint8)  # small letters and digits by byte
_FOREIGN = (("\u0130", "i\u0307"), ("\u212a", "k"))  # the other letters whose small form has one of a-z


def cut_titles(titles: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """The words of :func:`title_words` for Arrow arrays of titles, without an expression per row, a few MB at a time.

    Each piece is (first row, row from there on of each word, words); words come in order and may repeat in a title.
    """
    raw = titles.cast(pa.large_binary()).fill_null(b"")
    for letter, small in _FOREIGN:
        if pc.any(pc.match_substring(raw, letter.encode())).as_py():
            raw = pc.replace_substring(raw, letter.encode(), small.encode())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    stops, low = pa.array(STOP_WORDS), 0
    while low < len(raw):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + _BYTES_AT_ONCE, "right")) - 1)
        high = min(high, len(raw))
        text, bounds = _LETTERS[data[ends[low] : ends[high]]], ends[low : high + 1] - ends[low]
        inside = text != 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = bounds[:-1][bounds[:-1] < len(text)]
        start[first] = inside[first]
        where = np.flatnonzero(start)
        offsets = np.append(np.cumsum(inside, dtype=np.int64)[where] - 1, inside.sum()).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])])
        row = np.repeat(np.arange(high - low), np.diff(np.searchsorted(where, bounds)))
        kept = (np.diff(offsets) > 1) & ~np.asarray(pc.is_in(words, value_set=stops))
        yield low, row[kept], words.filter(pa.array(kept))
        low = high


def title_tokens(text: Column) -> Column:
    """The words of :func:`title_words`, sorted."""
    return F.sort_array(title_words(text))


def normalize_title(text: Column) -> Column:
    """The tokens of :func:`title_tokens` as one string; a missing title gives an empty one."""
    return F.coalesce(F.array_join(title_tokens(text), " "), F.lit(""))


def raw_title(artist: Column, title: Column, label: Column, year: Column) -> Column:
    """Record fields in the order a seller would type them; empty fields and year 0 are left out."""
    filled = [F.nullif(c, F.lit("")) for c in (artist, title, label)]
    return F.concat_ws(" ", *filled, F.nullif(year, F.lit(0)).cast("string"))


def mock_title(artist: Column, title: Column, label: Column, year: Column) -> Column:
    """Normalized title made from a catalogue record."""
    return normalize_title(raw_title(artist, title, label, year))
