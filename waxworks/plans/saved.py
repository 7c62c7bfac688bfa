"""Saved vocabularies and models: written under a version, read back by the newest active one.

A version is a folder of Parquet. The log beside it holds one entry for each version, with the version
that is active after it; an entry is put only where none is, so writers that overlap can't both win.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waxworks.functions.text import raw_title, title_words
from waxworks.operators.model import KeeperModel
from waxworks.operators.registry import new_version
from waxworks.operators.tfidf import fit_tfidf, usable
from waxworks.session import stable
from waxworks.sources.commits import CommitLog

VOCABULARY_SIZE = 10_000


def keeper_documents(records: DataFrame) -> DataFrame:
    """(id, tokens) of the titles that keepers among the records would have."""
    title = raw_title(*[F.col(n) for n in ("artist", "title", "label", "year")])
    kept = records.filter(F.col("evaluated") & F.col("wanted"))
    return kept.select("id", usable(title_words(title)).alias("tokens"))


def _save(table: DataFrame, stats: Column, folder: str, moment: Column) -> str:
    """Writes the table, then commits it; the newest by its time is active, whatever the order of the commits.

    A writer that finds its number taken reads the newer state and tries the next. A table whose writer
    died before its commit is in no entry, so no reader sees it.
    """
    spark = table.sparkSession
    made = spark.range(1).select(*new_version(moment, stats)).withColumn("at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()
    path = f"{folder}/version={made['version']}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    own = {"version": made["version"], "created_at": made["at"], "training_stats": made["training_stats"], "path": path}
    log = CommitLog(spark, f"{folder}_log")
    while True:
        n, state = log.state()
        rank = lambda e: (e["created_at"], e["version"])
        active = own if state is None or rank(own) >= rank(state["active"]) else state["active"]
        if log.commit(n + 1, {"entry": own, "active": active}):
            return made["version"]


def rebuild_vocabulary(records: DataFrame, folder: str, moment: Column, max_features: int = VOCABULARY_SIZE) -> str:
    """Fit the vocabulary on the keepers' titles and make it the active version."""
    terms = stable(fit_tfidf(keeper_documents(records), max_features))
    found = terms.agg(F.max("n_docs").alias("n"), F.count("*").alias("v")).first()
    stats = F.to_json(F.struct(F.lit(found["n"]).alias("keeper_count"), F.lit(found["v"]).alias("vocab_size")))
    return _save(terms, stats, folder, moment)


def save_model(model: KeeperModel, spark: SparkSession, folder: str, moment: Column) -> str:
    accuracy = max((h["val_accuracy"] for h in model.history if "val_accuracy" in h), default=0.0)
    stats = F.to_json(F.struct(F.lit(float(accuracy)).alias("val_accuracy")))
    return _save(model.to_rows(spark), stats, folder, moment)


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """Table of the newest active version, None when nothing has been saved."""
    _, state = CommitLog(spark, f"{folder}_log").state()
    return None if state is None else spark.read.parquet(state["active"]["path"])


def latest_model(spark: SparkSession, folder: str) -> KeeperModel | None:
    rows = latest(spark, folder)
    return None if rows is None else KeeperModel.from_rows(rows)
