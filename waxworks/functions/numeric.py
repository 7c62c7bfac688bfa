"""Feature arithmetic on single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the hashed vocabularies.
VOCABULARY = {"artist": 1000, "label": 500, "genre": 100, "style": 200}

# Grades from worst to best, and their short forms.
GRADES = (
    "Poor", "Fair", "Good", "Good Plus",
    "Very Good", "Very Good Plus", "Near Mint", "Mint",
)
GRADE_SHORT = {
    "P": "Poor", "F": "Fair", "G": "Good", "G+": "Good Plus",
    "VG": "Very Good", "VG+": "Very Good Plus", "NM": "Near Mint", "M": "Mint",
}


def hash_index(text: Column, size: int) -> Column:
    """Slot 1..size-1 of a text in a hashed vocabulary, 0 for blank.

    The slot is the 128-bit md5 modulo size-1. The hex digest is folded at most fifteen digits at a
    time, so that every step fits in a bigint.
    """
    clean = F.trim(F.lower(text))
    modulus = size - 1

    def fold(digest: Column) -> Column:
        rest = F.lit(0).cast("bigint")
        for start, n in ((1, 15), (16, 15), (31, 2)):
            chunk = F.conv(F.substring(digest, start, n), 16, 10).cast("bigint")
            rest = (rest * F.lit(16**n % modulus) + chunk) % F.lit(modulus)
        return rest + 1

    # Through a one-element list the digest is computed once and not once per step.
    slot = F.get(F.transform(F.array(F.md5(clean)), fold), F.lit(0))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(slot)


def hash_slots(items: Column, size: int, n: int = 3) -> list[Column]:
    """Hashed slots of the first ``n`` entries of a list, 0 where there is none."""
    return [F.coalesce(hash_index(F.get(items, F.lit(i)), size), F.lit(0)) for i in range(n)]


def want_ratio(wants: Column, haves: Column) -> Column:
    return F.when(haves > 0, F.try_divide(wants, haves)).otherwise(wants.cast("double"))


def demand(wants: Column, haves: Column) -> Column:
    """Wants per copy, weighted by the log of wants; 0 when nobody has a copy."""
    return F.when(haves == 0, F.lit(0.0)).otherwise(F.try_divide(wants, haves) * F.log(wants + 1))


def scale_year(year: Column, low: Column, high: Column) -> Column:
    """Year on [0, 1] between two bounds; 0.5 when unknown, implausible or without range."""
    span = high - low
    inside = F.try_divide(F.least(F.greatest(year, low), high) - low, span)
    usable = year.isNotNull() & (year > 1900) & (year <= 2025) & (span != 0)
    return F.when(usable, inside).otherwise(F.lit(0.5))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to the fitted range, not clamped; 0 for a constant column."""
    return F.coalesce(F.try_divide(value - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))


def grade_index(condition: Column, strict: bool = False) -> Column:
    """1-based place of a condition in GRADES, 0 when it names none.

    The first grade that occurs anywhere in the text wins, so ``Very Good Plus`` counts as
    ``Good``. With ``strict`` the longest grade that occurs wins.
    """
    text = F.replace(F.replace(F.trim(condition), F.lit("("), F.lit("")), F.lit(")"), F.lit(""))
    short = F.create_map(*[F.lit(x) for pair in GRADE_SHORT.items() for x in pair])
    full = F.lower(F.coalesce(F.try_element_at(short, text), text))
    order = sorted(GRADES, key=len, reverse=True) if strict else GRADES

    def first_named(name_text: Column) -> Column:
        found = F.when(name_text.isNull(), 0)
        for name in order:
            found = found.when(F.contains(name_text, F.lit(name.lower())), GRADES.index(name) + 1)
        return found.otherwise(0)

    # Through a one-element list the cleaned text is computed once and not once per branch.
    return F.get(F.transform(F.array(full), first_named), F.lit(0))


def grade_one_hot(place: Column) -> list[Column]:
    """Eight 0/1 columns from a place given by :func:`grade_index`."""
    return [(place == i + 1).cast("double") for i in range(len(GRADES))]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bounded_variance(log_var: Column) -> Column:
    """Variance of a head that predicts its logarithm: clamped, and never zero."""
    return F.exp(F.least(F.greatest(log_var, F.lit(-10.0)), F.lit(2.0))) + F.lit(1e-6)
