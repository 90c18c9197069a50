"""Changes of a workspace as a stream: filtered, gathered to bursts, and published as numbered snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from weft.functions import paths
from weft.sources.files import ALWAYS_EXCLUDED, is_readable


def relevant(changes: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Changes (path, ts) of files that are analysed."""
    return changes.where(is_readable(F.col("path")) & ~paths.matches(F.col("path"), [*ALWAYS_EXCLUDED, *exclude]))


def bursts(changes: DataFrame, gap: str = "800 milliseconds", late: str = "10 seconds", by: str | None = None) -> DataFrame:
    """start, until, n, paths of changes with less than `gap` between them. A burst is complete, and is emitted in append
    mode, once the watermark has passed it: event time stands in for a timer. A stream needs a column `by`, such as the
    workspace that a change belongs to: Spark keeps sessions by key."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    window = F.session_window("ts", gap).alias("w")
    keys = [window] if by is None else [window, F.col(by)]
    found = changes.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return found.select(*([] if by is None else [by]), F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n", "paths")


class Quiet(StatefulProcessor):
    """Gathers a key's changes until none has come for `gap` milliseconds of processing time. Each change sets the timer anew; what is kept of a
    burst is its counts and times, whatever its length."""

    def __init__(self, by: str, gap: int):
        self.by, self.gap = by, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "n long, start timestamp, until timestamp, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.burst.get() if self.burst.exists() else None
        n, start, until, due = held or (0, None, None, None)
        for row in rows:
            n += 1
            start = row.ts if start is None or row.ts < start else start
            until = row.ts if until is None or row.ts > until else until
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.handle.registerTimer(due)
        self.burst.update((n, start, until, due))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.burst.exists():
            n, start, until, _ = self.burst.get()
            self.burst.clear()
            yield Row(**{self.by: key[0], "start": start, "until": until, "n": n})

    def close(self) -> None:
        pass


def quiet_bursts(changes: DataFrame, by: str, gap: int = 800) -> DataFrame:
    """by, start, until, n of each burst of a stream of changes (ts), once `gap` milliseconds have gone by without another one of its key.

    A timer in processing time ends a burst, so a lone one is emitted without any later event; bursts() instead ends sessions by event time.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). A burst that is open when the query stops goes on after a
    restart from its checkpoint.
    """
    kind = changes.schema[by].dataType.simpleString()
    shape = f"{by} {kind}, start timestamp, until timestamp, n long"
    return changes.select(by, "ts").groupBy(by).transformWithState(statefulProcessor=Quiet(by, gap), outputStructType=shape, outputMode="Append", timeMode="ProcessingTime")


def publish(stream: DataFrame, refresh: Callable[[int], DataFrame], uri: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """For each micro-batch with changes writes refresh(revision) to <uri>/revision=<n>, n growing with the batches.

    Batches follow one another, so no two refreshes run at once and a later one never gives way to an earlier; a batch that is run
    again after a failure overwrites its own revision. Readers take the greatest.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            refresh(number).write.mode("overwrite").parquet(f"{uri.rstrip('/')}/revision={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark, uri: str) -> DataFrame:
    """The rows of the greatest revision."""
    table = spark.read.parquet(uri)
    top = table.agg(F.max("revision").alias("_top"))
    return table.join(F.broadcast(top), table.revision == top._top).drop("_top")
