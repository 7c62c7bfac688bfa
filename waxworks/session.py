"""Where a job may put data that has to outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"
_local_base: tempfile.TemporaryDirectory | None = None  # goes when the process ends


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a folder of this machine; anywhere else a missing
    setting is an error, because a lost executor would take the data with it.
    """
    global _local_base
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    if _local_base is None:
        _local_base = tempfile.TemporaryDirectory(prefix="waxworks-", ignore_cleanup_errors=True)
    return _local_base.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_base(spark)}/waxworks/{name}-{uuid.uuid4().hex}"


def stable(df):
    """Cut lineage at ``df`` with a reliable checkpoint.

    Needed wherever a value depends on how rows happened to be partitioned: a recomputed partition
    must not see another numbering than the one its neighbours already used.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()
