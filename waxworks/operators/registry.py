"""Versions of models and vocabularies: append-only, the newest active row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxworks.functions.payload import version_stamp


def new_version(moment: Column, stats: Column) -> list[Column]:
    """Columns of a registry row for a model made at ``moment``."""
    return [
        version_stamp(moment).alias("version"), moment.alias("created_at"),
        stats.alias("training_stats"), F.lit(True).alias("is_active"),
    ]


def register_version(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """Registry with ``entry`` as its one active row.

    Nothing is updated in place: the newest row being the active one is what deactivates the rest.
    """
    return registry.withColumn("is_active", F.lit(False)).unionByName(entry)


def latest_active(registry: DataFrame) -> DataFrame:
    """Version and time of the newest active row."""
    newest = F.max_by("version", F.struct("created_at", "version"))
    return registry.filter("is_active").agg(
        F.coalesce(newest, F.lit("none")).alias("version"), F.max("created_at").alias("created_at")
    )


def update_counts(batches: DataFrame) -> DataFrame:
    """Batches each version has learnt from, counted and not incremented."""
    return batches.groupBy("version").agg(F.countDistinct("batch_number").alias("batch_count"))
