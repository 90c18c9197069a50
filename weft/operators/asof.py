"""As-of joins, carried state and extents: one shuffle by key and one sort, never a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """Both sides in one table: `_side` 0 for left rows, 1 for right rows, `_take` what right rows offer."""
    one = left.select("*", F.lit(0).alias("_side"), F.lit(None).alias("_take"))
    offered = F.struct(F.col(on).alias(f"matched_{on}"), *take).alias("_take")
    two = right.select(*by, on, F.lit(1).alias("_side"), offered)
    return one.unionByName(two, allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], within: Column | int | None = None, forward: bool = False) -> DataFrame:
    """Left rows with the columns `take` and matched_<on> of the nearest right row of the same key at or before
    (forward: at or after) them, null where there is none or it lies farther than `within`.

    Rows of one key are sorted once; a key's rows stream through a window and are not collected.
    """
    order = [F.col(on), F.col("_side").desc()] if not forward else [F.col(on).desc(), F.col("_side").desc()]
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _merged(left, right, by, on, take).withColumn("_take", F.last("_take", ignorenulls=True).over(window)).where("_side = 0")
    if within is not None:
        gap = F.abs(F.col(on).cast("double") - F.col(f"_take.matched_{on}").cast("double"))
        found = found.withColumn("_take", F.when(gap <= within, F.col("_take")))
    return found.select(*left.columns, "_take.*")


def carried(frame: DataFrame, by: list[str], order: list[str], value: Column, name: str, reset: Column | None = None) -> DataFrame:
    """The last non-null value at or before each row of its key; a row where `reset` holds forgets what came before."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.struct(value.alias("v"))
    set_ = value.isNotNull() if reset is None else value.isNotNull() | reset
    return frame.withColumn(name, F.last(F.when(set_, state), ignorenulls=True).over(window)["v"])


def extents(frame: DataFrame, by: list[str], start: str, end: Column, name: str = "until") -> DataFrame:
    """Where each row's stretch ends: one before the next start of the key, or `end` for the last."""
    following = F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    return frame.withColumn(name, F.coalesce(following - 1, end))
