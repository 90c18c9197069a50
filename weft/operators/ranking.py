"""Ordered cuts: the first of a group, the top of a group with what is hidden, tails folded into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefer(frame: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order given, which should be total."""
    ranked = frame.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def top(frame: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each key, with rank; Spark keeps no more than that of a key before the shuffle."""
    ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def top_with_hidden(frame: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """As top(), with `hidden`: how many rows of the key are cut."""
    sizes = frame.groupBy(*by).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("hidden"))
    return top(frame, by, order, limit).join(sizes, by)


def composition(frame: DataFrame, name: str, limit: int, other: str = "other") -> DataFrame:
    """name, n: counts of the `limit` most frequent values (ties to the smaller), the rest in one row that comes last."""
    counts = frame.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    first = counts.where(F.col("name") != other).orderBy(F.desc("n"), "name").limit(limit).select("name", F.lit(True).alias("_kept"))
    folded = counts.join(F.broadcast(first), "name", "left").select(F.when(F.col("_kept"), F.col("name")).otherwise(other).alias("name"), "n")
    return folded.groupBy("name").agg(F.sum("n").alias("n"))
