"""Chance that repeats: every draw is an md5 of the row's id and a seed.

The reference draws without a seed. An md5 key gives the same draw on every run, on every
partitioning and in any engine that has md5, so results can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_U32 = 2.0**32


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def seeded_key(*parts, seed) -> Column:
    """Hex key that orders rows at random for one seed."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts], F.lit(str(seed))))


def seeded_int(*parts, seed) -> Column:
    """Whole number in [0, 2^32)."""
    return F.conv(F.substring(seeded_key(*parts, seed=seed), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(*parts, seed) -> Column:
    """Number strictly inside (0, 1)."""
    return (seeded_int(*parts, seed=seed) + F.lit(0.5)) / F.lit(_U32)


def seeded_normal(*parts, seed) -> Column:
    """Standard normal draw, from two uniforms (Box and Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(seeded_uniform(*parts, "u", seed=seed)))
    return radius * F.cos(F.lit(6.283185307179586) * seeded_uniform(*parts, "v", seed=seed))
