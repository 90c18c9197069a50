"""Benchmark decontamination by MinHash containment search over size partitions.

Items are partitioned by their number of shingles, by powers of two. For each partition a document is read as windows
of three blocks, each block as long as the partition's smallest item, so a window that holds an item's passage is at most a few
times its size and their Jaccard similarity has a known lower bound; with 64 one-row bands a passage with four
fifths of the shingles is missed with a probability below 1e-7. Candidates are verified by the exact containment of
the item's shingles in the whole document. Items come in blocks of bounded size, each a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import LOWER, blocks, flat, keyed, mix, rolling, word_bounds, word_hashes

SHINGLE, THRESHOLD, PERMUTATIONS = 5, 0.8, 64
#: Items that are handed to the tasks at once, and bytes of their texts (one item may be longer).
ITEMS, ITEM_BYTES = 20_000, 16 << 20
SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    words = text.translate(LOWER).split()
    return {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and for each row the index of its first (one more at the end)."""
    data = _LOWER[data]
    starts, ends, at = word_bounds(data, offsets)
    h = mix(rolling(word_hashes(data, starts, ends), shingle))
    n = np.maximum(np.diff(at) - shingle + 1, 0)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return h[np.repeat(at[:-1], n) + inside], np.append(0, np.cumsum(n))


class Index:
    """The items of one block: for each size class and permutation, their least values in order."""

    def __init__(self, items: list[tuple], shingle: int, permutations: int):
        self.items, self.shingle = items, shingle
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        texts = pa.array([t for _, t in items], pa.binary())
        h, at = _shingles(*flat(texts), shingle)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[int]] = {}
        values = {}
        for i in range(len(items)):
            own = np.unique(h[at[i] : at[i + 1]])
            if len(own):
                rows.setdefault(int(len(own)).bit_length() - 1, []).append(i)
                values[i] = own
        for size, members in rows.items():
            least = np.array([[(values[i] * f).min() for i in members] for f in self.factors], dtype=np.uint64)
            order = np.argsort(least, axis=1, kind="stable")
            seen = np.zeros((len(self.factors), 1 << 14), dtype=bool)
            for p in range(len(self.factors)):
                seen[p, (least[p] >> np.uint64(50)).astype(np.int64)] = True
            self.classes[size] = (np.take_along_axis(least, order, axis=1), np.array(members)[order], seen)

    def contained(self, text: pa.Array, threshold: float) -> list[tuple]:
        """Row, item_id, shingles, shared shingles and containment of the rows that hold enough of an item."""
        sets: dict[int, set[bytes]] = {}
        out, row, own = [], -1, set()
        for r, i in sorted(self.search(*_shingles(*flat(text), self.shingle))):
            if r != row:
                row, own = r, shingle_set((text[r].as_py() or "").encode(), self.shingle)
            if i not in sets:
                sets[i] = shingle_set(self.items[i][1], self.shingle)
            shared = len(sets[i] & own)
            if shared >= threshold * len(sets[i]):
                out.append((r, self.items[i][0], len(sets[i]), shared, shared / len(sets[i])))
        return out

    def search(self, h: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of a row and an item with an equal least value under some permutation."""
        found: set[tuple[int, int]] = set()
        n = np.diff(at)
        for size, (least, members, seen) in self.classes.items():
            width = 1 << size
            many = -(-n // width)  # blocks of each row
            base = np.append(0, np.cumsum(many))
            inside = np.arange(base[-1]) - np.repeat(base[:-1], many)
            first = np.repeat(at[:-1], many) + inside * width
            if not len(first):
                continue
            row = np.repeat(np.arange(len(n)), many)
            end = base[row + 1] - 1
            here = np.arange(len(first))
            one, two = np.minimum(here + 1, end), np.minimum(here + 2, end)
            for p, factor in enumerate(self.factors):
                low = np.minimum.reduceat(h * factor, first)
                low = np.minimum(np.minimum(low, low[one]), low[two])
                hit = np.flatnonzero(seen[p, (low >> np.uint64(50)).astype(np.int64)])
                left, right = np.searchsorted(least[p], low[hit], side="left"), np.searchsorted(least[p], low[hit], side="right")
                for x, a, b in zip(row[hit[right > left]].tolist(), left[right > left].tolist(), right[right > left].tolist()):
                    found.update((x, int(i)) for i in members[p, a:b])
        return found


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each document that holds at least `threshold` of the
    distinct `shingle`-word shingles of an item (item_id, text).

    Words are lower-cased (A-Z). Items and documents with fewer words than a shingle, or null, have no shingles and
    are in no pair. Documents of any length are read whole; containment of exactly `threshold` counts. Null ids are returned as they
    are; repeated rows of either table give repeated pairs; empty tables give none; further columns are ignored.
    """
    docs = keyed(docs)

    def search(index) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                out = [(block.column("doc_id")[r].as_py(), *rest) for r, *rest in index.value.contained(block.column("text"), threshold)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                names = ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=names)

        return docs.select("doc_id", "text").mapInArrow(each, SCHEMA)

    return reduce(DataFrame.unionByName, map(search, _indexes(items, shingle, permutations)))


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item so far; see contained_items()."""
    for index in _indexes(items, shingle, permutations):

        def each(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                keep = np.ones(block.num_rows, dtype=bool)
                keep[[r for r, *_ in index.value.contained(block.column("text"), threshold)]] = False
                yield block.filter(pa.array(keep))

        docs = docs.mapInArrow(each, docs.schema)
    return docs


def _indexes(items: DataFrame, shingle: int, permutations: int) -> Iterator:
    """The items as broadcast indexes of a bounded number and size each; one empty index if there are none."""
    context, held, size, empty = items.sparkSession.sparkContext, [], 0, True
    for row in items.selectExpr("CAST(item_id AS BIGINT)", "CAST(coalesce(text, '') AS BINARY) AS text").toLocalIterator():
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
        if len(held) == ITEMS or size >= ITEM_BYTES:
            yield context.broadcast(Index(held, shingle, permutations))
            held, size, empty = [], 0, False
    if held or empty:
        yield context.broadcast(Index(held, shingle, permutations))
