"""Loosely typed fields of landed payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output column -> aspect names that may hold it. Where there are two names the first
# non-empty value counts; where there is one, the last value does.
ASPECTS = {
    "artist": ("Artist",),
    "album": ("Release Title", "Album"),
    "label": ("Record Label", "Label"),
    "format": ("Format", "Record Size"),
    "year": ("Release Year", "Year"),
    "record_condition": ("Record Grading",),
    "sleeve_condition": ("Sleeve Grading",),
    "genre": ("Genre",),
    "style": ("Style",),
}


def _holds(names: tuple[str, ...], non_empty: bool):
    def test(entry: Column) -> Column:
        named = entry["name"].isin(*names)
        return named & (F.coalesce(entry["value"], F.lit("")) != "") if non_empty else named

    return test


def aspect_columns(aspects: Column) -> dict[str, Column]:
    """Nine flat columns from a list of (name, value) structs; absent ones are empty."""
    out = {}
    for column, names in ASPECTS.items():
        shared = len(names) > 1
        hits = F.filter(aspects, _holds(names, non_empty=shared))
        pick = F.try_element_at(hits, F.lit(1 if shared else -1))
        out[column] = F.coalesce(pick["value"], F.lit(""))
    return out


_QUOTED = r'"(?:[^"\\]|\\.)*"'


def string_list(text: Column) -> Column:
    """A JSON list of strings; a bare JSON string becomes a list of one, anything else an empty list.

    A list with other elements than strings counts as junk; a null in it is an empty string.
    """
    element = rf"(?:{_QUOTED}|null)"
    is_list = text.rlike(rf"^\s*\[\s*(?:{element}(?:\s*,\s*{element})*\s*)?\]\s*$")
    is_string = text.rlike(rf"^\s*{_QUOTED}\s*$")
    json = F.when(is_list, text).when(is_string, F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.transform(F.from_json(json, "array<string>"), lambda e: F.coalesce(e, F.lit("")))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def primitive(value: Column, kind: str) -> Column:
    """Text form of a loosely typed value: JSON for lists and maps, plain text for the rest."""
    return F.to_json(value) if kind in ("array", "map", "struct") else value.cast("string")


_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def instant(text: Column) -> Column:
    """RFC 3339 time with its zone, null when it does not parse."""
    return F.try_to_timestamp(F.when(text.rlike(_RFC3339), text))


def version_stamp(moment: Column) -> Column:
    return F.date_format(moment, "'v'yyyyMMdd_HHmmss")


def nested_or_flat(nested: Column, flat: Column) -> Column:
    return F.coalesce(nested, flat)


def current_bid(bid: Column, price: Column) -> Column:
    """The bid if there is one, else the price, else nothing."""
    return F.coalesce(bid, price, F.lit(""))
