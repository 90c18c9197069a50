"""Substring deduplication on words, with difference-cover anchors.

The positions {0, 1, 3, 9} modulo 13 form a difference cover: for any two positions some shift below 13 takes
both to cover positions. So two equal windows of 20 words share an aligned anchor of 8 words at one of their first 13
words, whatever their places in the documents. Only anchors (4/13 of the words) are hashed and dealt; the anchors
that are found twice are extended to whole windows, and equal windows meet once more to find the earliest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import blocks, flat, groups, keyed, minima, mix, rolling, spans_union, word_bounds, word_hashes
from weft.llm.repeats import among, hottest, later, placed, repeated, span_lists, spread, with_places, with_spans
from weft.session import saved

PERIOD, COVER = 13, (0, 1, 3, 9)
WINDOW = 20
#: Windows that share a least anchor meet in one task as long as it leads no more of them than this.
HEAVY = 2_000
_COVER = np.zeros(PERIOD, dtype=bool)
_COVER[list(COVER)] = True


def _windows(values: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words in a block, whether each lies in one row, its row and its position."""
    h = rolling(values, width)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(h)]
    pos = np.arange(len(h)) - at[row]
    return mix(h), at[row + 1] - at[row] >= pos + width, row, pos


def spans(docs: DataFrame, window: int = WINDOW, heavy: int | None = None) -> DataFrame:
    """`_k`, o, s, e: ranges of words in windows that also start earlier (smaller doc_id, or same document before).

    docs comes from keyed(). The ranges may overlap. Rows that repeat both id and text are one document. Windows meet
    where their least anchor leads them, or, if more than `heavy` have that one, each where its own hash leads it.
    """
    buckets = spread(docs)
    size = window - PERIOD + 1
    if size < 1:
        raise ValueError(f"a window needs {PERIOD} words or more")

    def anchors(data: np.ndarray, offsets: np.ndarray):
        starts, ends, at = word_bounds(data, offsets)
        values = word_hashes(data, starts, ends)
        h, whole, row, pos = _windows(values, at, size)
        keep = whole & _COVER[pos % PERIOD]
        return h[keep], row[keep], pos[keep], _leading(h, at, window, size)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around repeated anchors; those with an earlier one in the same block are settled here."""
        for block in blocks(batches):
            data, offsets = flat(block.column("text"))
            starts, ends, first = word_bounds(data, offsets)
            values = word_hashes(data, starts, ends)
            h, whole, row, pos = _windows(values, first, window)
            if not len(h):
                continue
            n = np.bincount(row, minlength=block.num_rows)
            base = np.cumsum(n) - n
            where, anchor = placed(block)
            mark = np.zeros(len(h) + 1, dtype=np.int64)
            last = base[where] + n[where]
            np.add.at(mark, np.minimum(np.maximum(base[where] + anchor - PERIOD + 1, base[where]), last), 1)
            np.add.at(mark, np.minimum(base[where] + anchor + 1, last), -1)
            at = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & whole)
            if not len(at):
                continue
            w, s, r = h[at], pos[at], row[at]
            o, k = block.column("_o").to_numpy()[r], block.column("_k").to_numpy()[r]
            known = later((w,), (o, k, s))
            new = np.flatnonzero(_breaks(r[known], s[known], window))
            if len(new):
                to = np.append(new[1:], known.sum()) - 1
                ro, b, e = k[known][new], s[known][new], s[known][to] + window
                yield _rows(ro, o[known][new], ro, b, e, [b""] * len(new))
            # Windows in a row that share their least anchor go as one row, to where their equals go too.
            least = minima(mix(rolling(values, size)), PERIOD)[at]
            keep = ~known
            w, s, r, o, k, least = w[keep], s[keep], r[keep], o[keep], k[keep], least[keep]
            alone = among(least, hot, buckets)
            new = _breaks(r, s, 1) | alone
            new[1:] |= least[1:] != least[:-1]
            new = np.flatnonzero(new)
            to = np.append(new[1:], len(s))
            packed = [w[a:b].tobytes() for a, b in zip(new.tolist(), to.tolist())]
            yield _rows(np.where(alone, w, least)[new].view(np.int64), o[new], k[new], s[new], np.full(len(new), -1), packed)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        m, o, k, s, e = (pa.concat_arrays([b.column(i) for b in found]).to_numpy(zero_copy_only=False) for i in range(5))
        data, offsets = flat(pa.concat_arrays([b.column(5) for b in found]))
        del found
        done = e >= 0
        out = [(k[done], o[done], s[done], e[done])]
        n = np.diff(offsets) // 8
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        w, m, o, k, s = data.view(np.uint64), np.repeat(m, n), np.repeat(o, n), np.repeat(k, n), np.repeat(s, n) + inside
        again = later((m, w), (o, k, s))
        order, _ = groups(k[again], o[again], s[again])
        k, o, s = (x[again][order] for x in (k, o, s))
        first = np.flatnonzero(_breaks(k, s, window))
        if len(first):
            out.append((k[first], o[first], s[first], s[np.append(first[1:], len(k)) - 1] + window))
        for columns in out:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(columns, ("i8", "i8", "i4", "i4"))], names=["_k", "o", "s", "e"])

    found = saved(repeated(docs, anchors, HEAVY if heavy is None else heavy))
    hot = hottest(found)
    near = with_places(docs, found)
    windows = near.mapInArrow(extend, "w long, o long, k long, s int, e int, windows binary")
    return windows.repartition("w").mapInArrow(settle, "_k long, o long, s int, e int")


def _leading(h: np.ndarray, at: np.ndarray, window: int, size: int) -> np.ndarray:
    """The least anchors that lead the windows of a block, once for each stretch of windows that one leads."""
    if len(h) < PERIOD:
        return np.zeros(0, dtype=np.uint64)
    least = minima(h, PERIOD)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    whole = at[row + 1] - at[row] >= np.arange(len(least)) - at[row] + window
    new = whole.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
    return least[new]


def _breaks(key: np.ndarray, start: np.ndarray, reach: int) -> np.ndarray:
    """True where a new run begins: another key, or a start more than `reach` after the one before."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + reach)
    return new


def _rows(w, o, k, s, e, windows) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x).astype(t, copy=False)) for x, t in zip((w, o, k, s, e), ("i8", "i8", "i8", "i4", "i4"))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(windows, pa.binary())], names=["w", "o", "k", "s", "e", "windows"])


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text: each word in a window of `window` words whose
    sequence also starts earlier (smaller doc_id, or same document before) is removed.

    Windows are judged on the input. Kept words are joined by one space. Null texts have no words; null ids come
    after all others; rows equal in id and text count as one document and each gets the same result; a text longer
    than a block is a block of its own, taken whole; an empty table gives an empty one; further columns are ignored.
    """
    docs = keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = []
            for text, (s, e) in zip(block.column("text").cast(pa.binary()).to_pylist(), span_lists(block)):
                words = text.split()
                s, e = spans_union(s, e)
                kept, at = [], 0
                for a, b in zip(s.tolist(), e.tolist()):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            n, gone, sha, joined = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(joined, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    found = with_spans(docs, spans(docs, window))
    return found.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


