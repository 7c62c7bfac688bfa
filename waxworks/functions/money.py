"""Prices: text forms, currencies, list price by grade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a grade is worth relative to VG+.
GRADE_FACTORS = {
    "Near Mint (NM or M-)": 1.31,
    "Very Good Plus (VG+)": 1.0,
    "Very Good (VG)": 0.69,
    "Good Plus (G+)": 0.38,
}


def parse_price(text: Column) -> Column:
    """Number before the first comma once currency marks are gone; 0 when there is none."""
    bare = text
    for mark in ("$", "€", "£", "USD", "EUR", "GBP"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    number = F.trim(F.split_part(bare, F.lit(","), F.lit(1)))
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def _two_parts(text: Column) -> Column:
    first, last = F.substring_index(text, ", ", 1), F.substring_index(text, ", ", -1)
    return F.length(first) + F.length(last) + 2 == F.length(text)


def price_amount(text: Column) -> Column:
    """Amount of a ``"<num>, <CCY>"`` text; null unless it has exactly these two parts."""
    first = F.substring_index(text, ", ", 1)
    return F.when(_two_parts(text), first.try_cast("double"))


def price_currency(text: Column) -> Column:
    """Currency of a ``"<num>, <CCY>"`` text; null unless it has exactly these two parts."""
    return F.when(_two_parts(text), F.substring_index(text, ", ", -1))


def suggested_price(text: Column, condition: Column) -> Column:
    """Catalogue price for a grade, from any of the three text forms; null when unreadable."""
    tagged = F.regexp_extract(text, r"<Price ([0-9.]+)", 1)
    base = (
        F.when(text.contains("<Price"), tagged.try_cast("double"))
        .when(text.contains(", "), F.substring_index(text, ", ", 1).try_cast("double"))
        .otherwise(text.try_cast("double"))
    )
    factors = F.create_map(*[F.lit(x) for pair in GRADE_FACTORS.items() for x in pair])
    return base * F.coalesce(F.try_element_at(factors, condition), F.lit(1.0))


def to_usd(amount: Column, rate: Column) -> Column:
    return F.try_divide(amount, rate)


def to_units(amount: Column, per: int) -> Column:
    """Whole units of a non-negative amount, cut off and not rounded."""
    return F.floor(amount * F.lit(per)).cast("bigint")


def display_price(text: Column) -> Column:
    """Two decimals for the screen, or a dash."""
    number = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
    shown = F.format_string("$%.2f", number)
    return F.when(number.isNull(), F.lit("—")).otherwise(shown)


def price_edge(listed: Column, usd: Column) -> Column:
    """How far a listing is below the catalogue price; 0 when above it or when that is unknown."""
    return F.greatest(F.lit(0.0), F.coalesce(listed, F.lit(0.0)) - usd)
