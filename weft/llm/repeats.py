"""Anchors that occur more than once: the candidate step of both substring deduplications.

A map step hands over, for each block of text, hashes at anchor positions, one entry for each hash of the block with
its number there: what occurs twice in a block is known to repeat and stays out of the exchange but for that entry. So a
hash that half the documents share costs an entry for each block, not for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import blocks, flat, groups, least_count

#: What shares an anchor that occurs more often than this is dealt by whole windows instead.
HEAVY = 20_000
#: At most so many heavy anchors are told to all tasks; if there are more, the most frequent ones.
HEAVIEST = 1 << 20
#: Buckets of hashes for each shuffle partition.
SPREAD = 8
ANCHOR, PLACE, WATCHED = range(3)
_LOW = np.uint64((1 << 40) - 1)


def spread(docs: DataFrame) -> int:
    return SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(buckets)


def short(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as its bucket knows it: the bucket's number before its lower 40 bits."""
    return _bucket(h, buckets) << np.uint64(40) | (h & _LOW)


def repeated(docs: DataFrame, anchors: Callable, heavy: int | None = None) -> DataFrame:
    """`_j`, pos of every anchor whose hash occurs twice or more in all documents; and rows with hot, n (else null): the
    short hashes that occur more than `heavy` times.

    docs has `_j` and text; anchors(data, offsets) gives hash, row and position of the anchors of a block, and the hashes
    to be watched for heat (None: those of the anchors). As `_j` and the bits that are compared in a bucket may be shared by
    chance, some places too many may be returned, never one too few.
    """
    buckets, heavy = spread(docs), HEAVY if heavy is None else heavy

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            h, row, pos, watched = anchors(*flat(block.column("text")))
            if watched is not None and len(watched):
                yield from _dealt(WATCHED, *_counted(watched, buckets))
            if not len(h):
                continue
            j = block.column("_j").to_numpy()[row]
            order, new = groups(h)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h)))
            one = order[first]
            yield from _dealt(ANCHOR, _bucket(h[one], buckets), (h[one], 5), (np.minimum(times, 0xFFFF), 2), (j[one], 4), (pos[one], 4))
            here = order[np.repeat(times > 1, times)]
            yield from _dealt(PLACE, j[here].astype(np.uint32) % np.uint64(buckets), (j[here], 4), (pos[here], 4))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for bucket, kind, packed in zip(*(c.to_pylist() for c in batch.columns)):
                by_bucket.setdefault((bucket, kind), []).append(packed)
        while by_bucket:
            (bucket, kind), rows = by_bucket.popitem()
            if kind == PLACE:
                yield _places(*(np.concatenate(x) for x in zip(*(_unpack(r, 4, 4) for r in rows))))
                continue
            h, times, *place = (np.concatenate(x) for x in zip(*(_unpack(r, *(5, 2, 4, 4)[: 2 if kind == WATCHED else 4]) for r in rows)))
            order, new = groups(h)
            first = np.flatnonzero(new)
            total = np.add.reduceat(times[order], first)
            if place:
                entries = np.diff(np.append(first, len(h)))
                found = order[np.repeat(entries > 1, entries)]
                found = found[times[found] == 1]  # where a block has several, all their places are there already
                yield _places(place[0][found], place[1][found])
            hot = total > heavy
            if (kind == WATCHED or not watch) and hot.any():
                keys = np.uint64(bucket) << np.uint64(40) | h[order][first][hot].view(np.uint64)
                yield _hot(keys, total[hot])

    watch = anchors(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))[3] is not None
    hashes = docs.select("_j", "text").mapInArrow(emit, "bucket int, kind int, packed binary")
    return hashes.repartition("bucket").mapInArrow(meet, "_j int, pos int, hot long, n long")


def hottest(found: DataFrame) -> np.ndarray:
    """The heavy hashes of repeated(), sorted: at most HEAVIEST of them, above a threshold on their counts."""
    hot = found.where("hot IS NOT NULL").select("hot", "n")
    table = hot.where(F.col("n") >= least_count(hot, HEAVIEST)).select("hot").toArrow()
    return np.sort(table.column("hot").to_numpy().astype(np.int64).view(np.uint64))


def among(h: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Which of the hashes are heavy."""
    if not len(hot):
        return np.zeros(len(h), dtype=bool)
    key = short(h, buckets)
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key


def _counted(h: np.ndarray, buckets: int) -> tuple:
    order, new = groups(h)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    h = h[order][first]
    return _bucket(h, buckets), (h, 5), (np.minimum(times, 0xFFFF), 2)


def _dealt(kind: int, bucket: np.ndarray, *columns: tuple[np.ndarray, int]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: columns as planes of so many lower bytes, as high bytes compress well so."""
    if not len(bucket):
        return
    order, new = groups(bucket)
    first = np.flatnonzero(new)
    planes = [np.ascontiguousarray(x[order].astype("<i8", copy=False) if x.dtype != np.uint64 else x[order]).view(np.uint8).reshape(-1, 8)[:, :n] for x, n in columns]
    whole = np.concatenate(planes, axis=1)
    packed = [whole[a:b].T.tobytes() for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int32)), pa.array([kind] * len(first), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "kind", "packed"])


def _unpack(packed: bytes, *sizes: int) -> list[np.ndarray]:
    """The columns again: signed where they have four bytes."""
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(sum(sizes), -1).T
    out, at = [], 0
    for n in sizes:
        value = np.zeros((len(planes), 4 if n == 4 else 8), dtype=np.uint8)
        value[:, :n] = planes[:, at : at + n]
        out.append(value.view("<i4" if n == 4 else "<i8").reshape(-1))
        at += n
    return out


def _places(j: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(j), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(j), pa.array(pos), none, none], names=["_j", "pos", "hot", "n"])


def _hot(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int32())
    return pa.RecordBatch.from_arrays([none, none, pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["_j", "pos", "hot", "n"])


#: What both steps that need the texts read of them, so that Spark deals them out once and uses that again.
TEXTS = ("doc_id", "_k", "_o", "_j", "text")


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The documents that have such anchors, with the list `_at` of them (no longer than the document)."""
    lists = places.where("hot IS NULL").groupBy("_j").agg(F.collect_list("pos").alias("_at"))
    return docs.select(*TEXTS).join(lists, "_j").select(*TEXTS, "_at")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All documents, with the list `_spans` of what to remove (k, o, s, e), or null."""
    lists = spans.withColumn("_j", F.hash("_k")).groupBy("_j").agg(F.collect_list(F.struct(F.col("_k").alias("k"), "o", "s", "e")).alias("_spans"))
    return docs.select(*TEXTS).join(lists, "_j", "left").select(*TEXTS, "_spans")


def listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """A column of lists of structs: the row of each entry, then the named fields."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat_values = column.flatten()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lengths)
    return rows, *(flat_values.field(i).to_numpy(zero_copy_only=False) for i in (flat_values.type.get_field_index(x) for x in names))


def placed(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of each place of with_places()."""
    column = block.column("_at")
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def span_lists(block: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row, begins and ends of its own spans (those of other rows with the same `_j` are left out)."""
    rows, k, o, s, e = listed(block.column("_spans"), "k", "o", "s", "e")
    keep = (o == block.column("_o").to_numpy()[rows]) & (k == block.column("_k").to_numpy()[rows])
    rows, s, e = rows[keep], s[keep].astype(np.int64), e[keep].astype(np.int64)
    at = np.searchsorted(rows, np.arange(block.num_rows + 1))
    for i in range(block.num_rows):
        yield s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]


def later(key: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> np.ndarray:
    """True where an equal key has an earlier place; entries with the same key and place are one."""
    order, _ = groups(*key, *place)
    start = _starts(order, key)
    first = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    same = np.ones(len(order), dtype=bool)
    for x in place:
        ranked = x[order]
        same &= ranked == ranked[first]
    out = np.empty(len(order), dtype=bool)
    out[order] = ~same
    return out


def _starts(order: np.ndarray, key: tuple[np.ndarray, ...]) -> np.ndarray:
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for x in key:
        ranked = x[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return new
