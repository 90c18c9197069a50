"""Paths as hierarchies: counts of subtrees, and the longest known prefix, both by exploding a path's ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column, own: bool = False) -> Column:
    """The folders above a path, from the top; with `own` the path too. The root is not among them."""
    parts = F.split(path, "/")
    most = F.size(parts) if own else F.size(parts) - 1
    return F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))


def subtree_counts(frame: DataFrame, path: str) -> DataFrame:
    """folder, depth, n: how many rows lie below each folder. Counts are added up before the shuffle."""
    return frame.select(F.explode(ancestors(F.col(path))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n")).select("folder", F.size(F.split("folder", "/")).alias("depth"), "n")


def longest_prefix(frame: DataFrame, path: str, roots: DataFrame, root: str, own: bool = False) -> DataFrame:
    """frame with `root`, the longest of the roots that is an ancestor of its path, or null: an equi-join, no range join."""
    paths = frame.select(path).distinct()
    found = paths.select(path, F.explode(ancestors(F.col(path), own)).alias("_above")).join(roots.select(F.col(root).alias("_above")).distinct(), "_above")
    best = found.groupBy(path).agg(F.max_by("_above", F.length("_above")).alias(root))
    return frame.join(best, path, "left")


def first_candidate(frame: DataFrame, key: str, candidates: str, known: DataFrame, target: str) -> DataFrame:
    """key, `target`: for each key the first of its ordered candidates that is known. Keys without one are not returned."""
    tried = frame.select(key, F.posexplode(candidates).alias("_priority", target))
    return tried.join(known.select(target).distinct(), target).groupBy(key).agg(F.min_by(target, "_priority").alias(target))


def unmatched(frame: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return frame.join(known.select(*by).distinct(), list(by), "left_anti")
