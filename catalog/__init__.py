"""Named queries over the tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("thresholds", "scalars", "relational", "files", "aggregates", "composites", "streams")


def load():
    """All queries and their SQL."""
    from catalog import base

    for name in MODULES:
        import_module(f"catalog.{name}")
    return base.QUERIES, base.ORACLE
