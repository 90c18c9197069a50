"""Sessions with the settings that the library expects, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "weft", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings are given with underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # Checkpoints go when nothing refers to them any more.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; a folder of its own only in local mode, where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    if named := spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def saved(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the shared checkpoint folder."""
    use_checkpoints(frame.sparkSession)
    return frame.checkpoint()
