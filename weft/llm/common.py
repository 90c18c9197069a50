"""What the text operators share: Arrow access, word boundaries, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of bytes other than these (space and \t \n \v \f \r).
WHITE = b" \t\n\x0b\x0c\r"
SOLID = np.ones(256, dtype=bool)
SOLID[list(WHITE)] = False
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that a task handles at once.
BLOCK = 4 << 20
LAST = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def carried(docs: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    """The columns to keep, as one private struct; none for none."""
    return [F.struct(*(docs[c] for c in keep)).alias("_keep")] if keep else []


def carried_type(docs: DataFrame) -> str:
    """That struct's part of a schema."""
    return f", _keep {docs.schema['_keep'].dataType.simpleString()}" if "_keep" in docs.columns else ""


def carried_back(result: DataFrame) -> DataFrame:
    return result.select(*(c for c in result.columns if c != "_keep"), "_keep.*") if "_keep" in result.columns else result


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and private columns: `_k` identifies a row by id and text, `_j` is a short hash of that to deal
    rows by, `_o` orders documents (null ids last), `_keep` has what else is to be kept."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(doc_id.alias("doc_id"), text.alias("text"), *carried(docs, keep))
    docs = docs.select("*", F.xxhash64("doc_id", "text").alias("_k"), F.coalesce("doc_id", F.lit(LAST)).alias("_o"))
    return docs.withColumn("_j", F.hash("_k"))


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo parts; null ids get null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `limit` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one more at the end)."""
    solid = SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    inner = edge[(edge > 0) & (edge < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths, dtype=np.int64) - lengths
    total = int(begin[-1]) + int(lengths[-1])
    kind = np.int32 if max(total, len(data)) < 1 << 31 else np.int64  # the narrow one is faster
    inside = np.arange(total, dtype=kind) - np.repeat(begin.astype(kind), lengths)
    value = powers(int(lengths.max()))[inside]
    value *= _BYTE[data[np.repeat(starts.astype(kind), lengths) + inside]]
    return mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` values, built by doubling."""
    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    part, size, out, done = values, 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:  # the windows of `part` go before those gathered so far
                n = len(values) - done - size + 1
                out = part[:n] * _power(done) + out[size : size + n]
                done += size
        if done == width:
            return out
        n = len(values) - 2 * size + 1
        part = part[:n] * _power(size) + part[size : size + n]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys (first key first), and where a new group starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = False
        for key in keys:
            ranked = key[order]
            new[1:] |= ranked[1:] != ranked[:-1]
    return order, new


def runs(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges [start, start + width) of sorted starts, as disjoint ranges."""
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > starts[:-1] + width
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + width


def spans_union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; touching ranges join."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width`, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the minimum of each window of `width` lies, the first of equal ones, by doubling."""
    at, size = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1

    def joined(step: int) -> None:
        nonlocal values, at
        n = len(values) - step
        later = values[step:] < values[:n]
        values, at = np.where(later, values[step:], values[:n]), np.where(later, at[step:], at[:n])

    while 2 * size <= width:
        joined(size)
        size *= 2
    if width > size:
        joined(width - size)
    return at


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest threshold on column n (by eighths of a power of two) that at most `most` rows reach."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    total = 0
    for row in sorted(counts.groupBy(step).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
        total += row["rows"]
        if total > most:
            return int(np.ceil(2 ** ((row["step"] + 1) / 8)))
    return 1
