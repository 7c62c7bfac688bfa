"""Writers. Each leaves a folder of part files; none gathers rows in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxworks.operators.ordering import keep_first


def _csv(df: DataFrame, path: str) -> str:
    # quotes inside a field are doubled, as every CSV reader expects
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_csv_dated(df: DataFrame, folder: str, as_of: str, stem: str = "auctions") -> str:
    """CSV with a header in a folder named by date."""
    return _csv(df, f"{folder}/{stem}_{as_of}")


def write_results(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_training_csv(listings: DataFrame, path: str) -> str:
    """Listings with one row per title: the first by id."""
    return _csv(keep_first(listings, ["title"], F.col("ebay_id")), path)


def save_version(weights: DataFrame, registry_entry: DataFrame, folder: str, version: str) -> str:
    """A model's table under its version, then the registry row that makes it the active one."""
    path = f"{folder}/version={version}"
    weights.write.mode("overwrite").parquet(path)
    registry_entry.write.mode("append").parquet(f"{folder}_registry")
    return path
