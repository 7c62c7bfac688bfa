"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.session import stable

_REPLICATED = 1 << 19  # up to so many edges their nodes' least neighbours go to every task


def stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """Each node of the edges ``a``, ``b`` that isn't the least of its component as ``a``, with that least node as
    ``b``; and about how many edges there were.

    Large stars hang a node's larger neighbours on its least neighbour, small stars hang its smaller ones
    there; in a few rounds each component is a star around its least node. Rows stay distributed, as many
    as there are edges; nulls and loops have no effect; no edges give no rows.
    """
    edges = stable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = edges.count()
    small = F.broadcast if size <= _REPLICATED else lambda df: df
    while size:
        ends = F.array(F.struct("a", "b", F.lit(1).alias("low")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("low")))
        nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("a")
        # A node below which there is one, and none above it, or the other way round, stands in a star.
        if nodes.agg(F.sum("low").alias("lows"), F.min("low").alias("least")).filter("lows > 1 or lows = 1 and least = 0").isEmpty():
            break
        least = nodes.agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "b")
        large = edges.join(small(least), "b").select("a", F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        edges = stable(large.join(small(least), "a").select(F.explode(pairs).alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
    return edges, size


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every node of the edges ``a``, ``b``; see ``stars``."""
    edges, _ = stars(edges)
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def joined(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` of ``known`` when ``edges`` between its components join these."""
    moved, size = stars(edges)
    if not size:
        return known
    moved = moved.select(F.col("a").alias("component"), F.col("b").alias("least"))
    both = known.join(F.broadcast(moved) if size <= _REPLICATED else moved, "component", "left")
    return stable(both.select("id", F.coalesce("least", "component").alias("component")))
