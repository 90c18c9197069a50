"""Refreshes that read only what has changed: facts of a file are kept under its path and a hash of its content.

A store is a folder of revisions; each holds the facts of all files of its time, so readers need the last one only. What a file says
of itself (imports, callables) is kept; what files say together (resolution, graphs) is derived anew from the facts, which is cheap beside reading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from weft.operators import imports, interfaces


def _callables(files: DataFrame) -> DataFrame:
    return interfaces.callables(interfaces.lines(files, whole=True).where(F.col("extension").isin(*interfaces.CODE)))


#: What is kept of files: each extractor makes rows with their path.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"imports": imports.imports, "callables": _callables}


def hashed(files: DataFrame) -> DataFrame:
    """path, hash of files (path, content); a file without content has a hash too."""
    return files.select("path", F.sha2(F.coalesce(F.col("content"), F.lit("")).cast("binary"), 256).alias("hash"))


def _previous(spark: SparkSession, uri: str, name: str, revision: int) -> DataFrame | None:
    """A table of the last revision before this one, or none."""
    try:
        table = spark.read.parquet(f"{uri}/{name}")
    except AnalysisException:  # nothing has been stored yet
        return None
    last = table.where(F.col("revision") < revision).agg(F.max("revision")).first()[0]
    return None if last is None else table.where(F.col("revision") == last).drop("revision")


def refresh(spark: SparkSession, files: DataFrame, uri: str, revision: int, extractors: dict[str, Callable[[DataFrame], DataFrame]] = EXTRACTORS) -> DataFrame:
    """Stores the facts of `files` (path, content, size) as a revision and returns the paths that were read for it.

    Files whose path and hash the revision before knows keep its facts (a join of hashes, not of contents); the others are extracted;
    facts of files that are gone are left behind. Revisions are whole and are only written once, last of all the list of files, so that one
    that was broken off isn't taken for done; running it again overwrites it.
    """
    uri = uri.rstrip("/")
    now = hashed(files)
    known = _previous(spark, uri, "files", revision)
    changed = now if known is None else now.join(known, ["path", "hash"], "left_anti")
    same = None if known is None else now.join(known, ["path", "hash"], "left_semi").select("path")
    fresh = files.join(changed.select("path"), "path", "left_semi")
    for name, extract in extractors.items():
        facts = extract(fresh)
        old = None if same is None else _previous(spark, uri, name, revision)
        every = facts if old is None else facts.unionByName(old.join(same, "path", "left_semi"))
        every.write.mode("overwrite").parquet(f"{uri}/{name}/revision={revision}")
    now.write.mode("overwrite").parquet(f"{uri}/files/revision={revision}")
    return changed.select("path")


def facts(spark: SparkSession, uri: str, name: str) -> DataFrame:
    """A table of facts as of the last revision that is whole."""
    last = spark.read.parquet(f"{uri.rstrip('/')}/files").agg(F.max("revision")).first()[0]
    return spark.read.parquet(f"{uri.rstrip('/')}/{name}").where(F.col("revision") == last).drop("revision")
