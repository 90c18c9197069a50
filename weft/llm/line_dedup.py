"""Line deduplication by a segment-partition edit join.

A line of L characters is split into threshold + 1 segments. Of two lines within the threshold, the longer holds one
segment of the shorter unchanged, near its place; so lines index their segments under (L, number, content) and probe the
few substrings, by length and place, that could be a segment of a shorter line (the multi-match-aware choice).
That choice also bounds the edits on each side of a segment, so lines of a segment that very many share are split again
on one side of it, until few enough meet. What meets is filtered by counts of characters and verified with a banded
bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LAST, blocks, carried_back, carried_type, groups, keyed
from weft.llm.repeats import TEXTS, listed, spread
from weft.session import saved

THRESHOLD, MIN_CHARS = 2, 30
BLANK = " \t\n\x0b\x0c\r"
#: Lines to compare that are handed to every task; more of them are joined instead.
BROADCAST_LINES = 500_000
#: Lines with a signature in common that are compared with one another; more of them are split by what lies beside it, so many times.
CELL, DEPTH = 4096, 5
#: One of so many documents tells which signatures have FAR times as many lines as a cell takes; those lines are split at once, without meeting.
SAMPLED, FAR, MOST_TOLD = 64, 8, 1 << 16
CLASSES = 16


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """Start and length of `count` segments of even size."""
    small, extra = divmod(length, count)
    sizes = [small] * (count - extra) + [small + 1] * extra
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def signatures(line: str, threshold: int, min_chars: int, salt: int = 0) -> tuple[list[int], list[int]]:
    """Hashes of the segments that a line is found under, and of the substrings that it looks for besides those."""
    h, length, count = xxhash.xxh3_64_intdigest, len(line), threshold + 1
    own = [h(line[p : p + n].encode(), length * 64 + i ^ salt) for i, (p, n) in enumerate(segments(length, count))]
    probes = []
    for shorter in range(max(min_chars, length - threshold), length + 1):
        shift = length - shorter
        for i, (p, n) in enumerate(segments(shorter, count)):
            low = max(0, p - i, p + shift - (threshold - i))
            high = min(length - n, p + i, p + shift + (threshold - i))
            for at in range(low, high + 1):
                if shift or at != p:
                    probes.append(h(line[at : at + n].encode(), shorter * 64 + i ^ salt))
    return own, probes


def _beside(line: str, threshold: int, min_chars: int) -> list[tuple[str, int, str]]:
    """For each of the line's signatures, in their order: the text on one side, the edits allowed there, and what else has to agree.

    A segment number i has at most i edits before it and `threshold` - i behind it.
    """
    length, out = len(line), []

    def side(i: int, at: int, n: int) -> None:
        last = i == threshold and i > 0
        out.append((line[:at], threshold, line[at + n :]) if last else (line[at + n :], threshold - i, ""))

    for i, (p, n) in enumerate(segments(length, threshold + 1)):
        side(i, p, n)
    for shorter in range(max(min_chars, length - threshold), length + 1):
        shift = length - shorter
        for i, (p, n) in enumerate(segments(shorter, threshold + 1)):
            for at in range(max(0, p - i, p + shift - (threshold - i)), min(length - n, p + i, p + shift + (threshold - i)) + 1):
                if shift or at != p:
                    side(i, at, n)
    return out


def _within(line: str, hot: set[int], level: int, threshold: int, min_chars: int, buckets: int) -> list[tuple[int, str, int]]:
    """Salt, text and edits allowed of what a line is split by at a level, where it lies in hot cells at all levels before."""
    parts = [(0, line, threshold, min_chars)]
    for _ in range(level):
        found = []
        for salt, text, edits, least in parts:
            own, probes = signatures(text, edits, least, salt)
            for h, (rest, left, same) in zip(own + probes, _beside(text, edits, least)):
                if (cell := _cell(h, buckets)) in hot:
                    found.append((xxhash.xxh3_64_intdigest(same.encode(), cell), rest, left, 0))
        parts = list(dict.fromkeys(found))
    return [p[:3] for p in parts]


def _cell(h: int, buckets: int) -> int:
    """The number of a signature's cell, as meetings() has it, unsigned."""
    return (h & (1 << 40) - 1) << 16 ^ (h >> 40) % buckets


def edit_distance(a: str, b: str, limit: int) -> int:
    """The edit distance if it is at most `limit`, else limit + 1: bit-parallel over a band of 2 * limit + 1 diagonals."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b or len(a) > limit and limit == 0:
        return min(len(a), limit + 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + limit)
    width = 2 * limit + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    # Bit x is the row (column - limit + x) of a; rows up to 0 fall towards row 0, those below rise from it.
    rise, fall = full & ~((1 << (limit + 1)) - 1), (1 << (limit + 1)) - 1
    lead = len(a) - len(b)
    score, diagonal = lead, 1 << (limit + lead)
    for column, c in enumerate(b):
        match = where.get(c, 0) >> column & full
        up, down = rise >> 1 | top, fall >> 1
        same = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | full & ~(same | up), same & up
        if not same & diagonal:
            score += 1
            if score > limit:
                return limit + 1
        right = (right << 1 | 1) & full
        rise, fall = ((left << 1) | full & ~(same | right)) & full, same & right
    return score


def _lines(text: str, min_chars: int) -> list[tuple[int, str]]:
    return [(i, s) for i, line in enumerate(text.split("\n")) if len(s := line.strip(BLANK)) >= min_chars]


def _id(line: str) -> int:
    """63 bits of a hash in the upper bits of a signed long; the lowest is free for the role."""
    return (xxhash.xxh3_64_intdigest(line.encode()) & ~1) - (1 << 63)


def sketches(lines: list[str]) -> np.ndarray:
    """For each line, how many characters fall in each of 16 classes, modulo 256."""
    if not lines:
        return np.zeros((0, CLASSES), dtype=np.uint8)
    points = np.frombuffer("\n".join(lines).encode("utf-32-le"), dtype=np.uint32)
    line = np.repeat(np.arange(len(lines)), [len(x) + 1 for x in lines])[: len(points)]
    kind = (points * np.uint32(2654435761) >> np.uint32(13)) & np.uint32(CLASSES - 1)
    counts = np.bincount(line * CLASSES + kind, minlength=len(lines) * CLASSES).reshape(-1, CLASSES)
    ends = np.cumsum([len(x) + 1 for x in lines])[:-1] - 1
    counts[np.arange(len(lines) - 1), kind[ends]] -= 1  # the line breaks between
    return counts.astype(np.uint8)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each line long enough: id, place (o, k, i), length n and the two halves x, y of its sketch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [_lines(t, min_chars) for t in block.column("text").to_pylist()]
            row = np.repeat(np.arange(block.num_rows), [len(x) for x in found])
            lines = [s for x in found for _, s in x]
            halves = sketches(lines).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_id(s) for s in lines], pa.int64()),
                    *(pa.array(block.column(c).to_numpy()[row]) for c in ("_o", "_k")),
                    pa.array([i for x in found for i, _ in x], pa.int32()),
                    pa.array([len(s) for s in lines], pa.int32()),
                    pa.array(halves[:, 0].copy()),
                    pa.array(halves[:, 1].copy()),
                ],
                names=["line", "o", "k", "i", "n", "x", "y"],
            )

    return docs.select("_o", "_k", "text").mapInArrow(each, "line long, o long, k long, i int, n int, x long, y long")


def frequent(docs: DataFrame, threshold: int, min_chars: int) -> np.ndarray:
    """Signatures, in order, that very many lines have, as far as a sample of the documents tells. They are few, as each has a great share of
    all lines, and the most frequent ones are told if not; what is missed meets first and is split then, so results don't depend on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = {s for t in block.column("text").to_pylist() for _, s in _lines(t, min_chars)}
            found = np.array([h for s in lines for part in signatures(s, threshold, min_chars) for h in part], dtype=np.uint64)
            h, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("_k"), F.lit(SAMPLED)) == 0).select("text")
    counts = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLED >= FAR * CELL)
    told = counts.orderBy(F.desc("n"), "h").limit(MOST_TOLD).select("h").toArrow().column("h").to_numpy()
    return np.sort(told.astype(np.int64).view(np.uint64))


def meetings(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """cell, line, indexed: lines that share a signature, in cells of at most CELL lines; of the few that still share more
    after DEPTH splits, in cells of CELL indexed and CELL other lines."""
    buckets, most, depth = spread(docs), CELL, DEPTH
    known = frequent(docs, threshold, min_chars) if depth else None

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = {_id(s): s for t in block.column("text").to_pylist() for _, s in _lines(t, min_chars)}
            yield from _emitted(((line, *signatures(s, threshold, min_chars)) for line, s in lines.items()), buckets, known)

    def again(level: int):
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("line", "s", "hot")))
                parts = ((line, x) for line, s, hot in rows for x in _within(s, {c & (1 << 64) - 1 for c in hot}, level, threshold, min_chars, buckets))
                yield from _emitted(((line, *signatures(text, edits, 0, salt)) for line, (salt, text, edits) in parts), buckets)

        return split

    def meet(last: bool):
        return lambda batches: _meetings(batches, most, last)

    schema = "cell long, line long, indexed int, hot boolean"
    met = saved(docs.select("text").mapInArrow(first, "bucket int, rows binary").repartition("bucket").mapInArrow(meet(not depth), schema))
    found, crowded = [met.where("NOT hot")], met.where("hot").select("cell", "line")
    for level in range(1, depth + 1):
        if crowded.isEmpty():
            break
        cells = crowded.groupBy("line").agg(F.collect_set("cell").alias("hot"))
        texts = line_texts(docs, cells.select("line"), min_chars).join(cells, "line")
        met = saved(texts.mapInArrow(again(level), "bucket int, rows binary").repartition("bucket").mapInArrow(meet(level == depth), schema))
        found.append(met.where("NOT hot"))
        new = met.where("hot").select("cell", "line")
        # A line's hot cells of all levels lead to its next parts, while it has one at the last level.
        crowded = new if new.isEmpty() else saved(crowded.join(new.select("line").distinct(), "line", "left_semi").select("cell", "line").unionByName(new))
    return reduce(DataFrame.unionByName, found).select("cell", "line", "indexed")


def _emitted(lines: Iterator[tuple[int, list[int], list[int]]], buckets: int, known: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Signatures with the lines that have them (odd: as their own segment), a row for each bucket. Those of known hot signatures are dealt by
    line, to buckets of negative numbers, with their cells."""
    h, who = [], []
    for line, own, probes in lines:
        h += own + probes
        who += [line | 1] * len(own) + [line] * len(probes)
    if not h:
        return
    h, who = np.array(h, dtype=np.uint64), np.array(who, dtype=np.int64)
    if known is not None and len(known):
        hot = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        if hot.any():
            cell = (h[hot] & np.uint64((1 << 40) - 1)) << np.uint64(16) ^ (h[hot] >> np.uint64(40)) % np.uint64(buckets)
            yield _dealt_by_line(cell.view(np.int64), who[hot], buckets)
            h, who = h[~hot], who[~hot]
            if not len(h):
                return
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order, new = groups(bucket)
    first = np.flatnonzero(new)
    to = np.append(first[1:], len(h))
    packed = [_pack(h[order[a:b]], who[order[a:b]]) for a, b in zip(first, to)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), pa.array(packed, pa.binary())], names=["bucket", "rows"])


def _dealt_by_line(cell: np.ndarray, who: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = -1 - ((who.view(np.uint64) >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order, new = groups(bucket)
    first = np.flatnonzero(new)
    both = np.stack([cell, who], axis=1)[order]
    packed = [both[a:b].tobytes() for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][first].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "rows"])


def _meetings(batches: Iterator[pa.RecordBatch], most: int, last: bool) -> Iterator[pa.RecordBatch]:
    """The cells of the buckets of a partition; those of too many lines are marked hot, or at last cut into tiles."""
    by_bucket: dict[int, list[bytes]] = {}
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_bucket.setdefault(bucket, []).append(packed)
    while by_bucket:
        bucket, rows = by_bucket.popitem()
        if bucket < 0:
            both = np.unique(np.frombuffer(b"".join(rows), dtype=np.int64).reshape(-1, 2), axis=0)
            yield _met(both[:, 0].copy(), both[:, 1] & ~1, both[:, 1] & 1, True)
            continue
        h, who = (np.concatenate(x) for x in zip(*map(_unpack, rows)))
        order, new = groups(h, who)
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (who[order][1:] != who[order][:-1])
        h, who = h[order][fresh], who[order][fresh]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(start, len(h)))
        line, own = who & ~1, (who & 1).astype(np.int64)
        indexed = np.add.reduceat(own, start)
        several = np.minimum.reduceat(line, start) != np.maximum.reduceat(line, start)
        good = (indexed > 0) & several
        plain = good & (n <= most)
        cell = (h << np.uint64(16) ^ np.uint64(bucket)).view(np.int64)
        keep = np.repeat(plain, n)
        yield _met(cell[keep], line[keep], own[keep])
        if not last:
            keep = np.repeat(good & ~plain, n)
            yield _met(cell[keep], line[keep], own[keep], True)
            continue
        for a, size in zip(start[good & ~plain], n[good & ~plain]):
            ids, roles = line[a : a + size], own[a : a + size]
            left, right = ids[roles == 1], np.unique(ids)
            for x in range(0, len(left), most):
                for y in range(0, len(right), most):
                    one, two = left[x : x + most], right[y : y + most]
                    tile = np.uint64(int(cell[a]) & (2**64 - 1)) ^ np.uint64((x * 7919 + y + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                    yield _met(np.full(len(one) + len(two), tile).view(np.int64), np.concatenate([one, two]), np.repeat([1, 0], [len(one), len(two)]))


def _met(cell: np.ndarray, line: np.ndarray, own: np.ndarray, hot: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(line), pa.array(own.astype(np.int32)), pa.array(np.full(len(cell), hot))], names=["cell", "line", "indexed", "hot"])


def _pack(h: np.ndarray, who: np.ndarray) -> bytes:
    planes = (h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], who.astype("<i8").view(np.uint8).reshape(-1, 8))
    return np.concatenate([x.T.reshape(-1) for x in planes]).tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(13, -1).T
    h = np.zeros((len(planes), 8), dtype=np.uint8)
    h[:, :5] = planes[:, :5]
    return h.view("<u8").reshape(-1), np.ascontiguousarray(planes[:, 5:]).view("<i8").reshape(-1)


def candidates(met: DataFrame, kinds: DataFrame, threshold: int) -> DataFrame:
    """a < b: pairs of lines of a cell whose lengths and counts of characters allow the threshold."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        cell, line, own, n, x, y = (pa.concat_arrays([b.column(i) for b in found]).to_numpy(zero_copy_only=False) for i in range(6))
        order, new = groups(cell)
        line, own, n = line[order], own[order] == 1, n[order].astype(np.int64)
        sketch = np.stack([x[order], y[order]], axis=1).view(np.uint8).reshape(-1, CLASSES)
        start = np.flatnonzero(new)
        out: list[np.ndarray] = []
        for a, b in zip(start.tolist(), np.append(start[1:], len(line)).tolist()):
            inside = slice(a, b)
            index = np.flatnonzero(own[inside]) + a
            for at in range(0, len(index), 64):
                i = index[at : at + 64]
                apart = np.abs((sketch[i, None] - sketch[None, inside]).view(np.int8).astype(np.int16)).sum(axis=2) <= 2 * threshold
                apart &= (np.abs(n[i, None] - n[None, inside]) <= threshold) & (line[i, None] != line[None, inside])
                p, q = np.nonzero(apart)
                if len(p):
                    out.append(np.stack([line[i[p]], line[q + a]], axis=1))
        if out:
            both = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    rows = met.join(kinds.select("line", "n", "x", "y"), "line").select("cell", "line", "indexed", "n", "x", "y")
    return rows.repartition("cell").mapInArrow(pairs, "a long, b long").distinct()


def line_texts(docs: DataFrame, need: DataFrame, min_chars: int) -> DataFrame:
    """line, s: the texts of the lines in `need` (line)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lines = {_id(s): s for t in block.column("text").to_pylist() for _, s in _lines(t, min_chars)}
            yield pa.RecordBatch.from_arrays([pa.array(lines.keys(), pa.int64()), pa.array(lines.values(), pa.string())], names=["line", "s"])

    need = saved(need.distinct())
    if need.count() <= BROADCAST_LINES:
        need = F.broadcast(need)
    return saved(docs.select("text").mapInArrow(texts, "line long, s string").join(need, "line", "left_semi").groupBy("line").agg(F.first("s").alias("s")))


def verified(docs: DataFrame, pairs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """a, b: the pairs within the threshold. Only lines that occur in a pair are brought together."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s, t = (batch.column(c) for c in ("a", "b", "s", "t"))
            keep = pa.array([edit_distance(x, y, threshold) <= threshold for x, y in zip(s.to_pylist(), t.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    pairs = saved(pairs)
    lines = line_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("line")), min_chars)
    both = pairs.join(lines.select(F.col("line").alias("a"), "s"), "a").join(lines.select(F.col("line").alias("b"), F.col("s").alias("t")), "b")
    return both.mapInArrow(check, "a long, b long")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = (), short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, class_id, kept_sha256, kept_text and the columns to keep: a line is removed if
    the same line, or one within `threshold` edits, occurs earlier (smaller doc_id, or same document, earlier line).

    Lines are split at \\n and compared without white space around them; lines under `min_chars` characters stay;
    with `short` those too go where the same line, blank ones aside, occurs earlier. n_links counts, over the document's
    lines, other line texts within the threshold; class_id is the smallest doc_id that has one of its lines or a near one.
    Null texts are empty and have one empty line; null ids come after all others; texts and lines of any length are read whole;
    rows equal in id and text count as one document and each gets the same result; an empty table gives an empty one;
    further columns are ignored. Equal lines are told by 63 bits of a hash.
    """
    docs = keyed(docs, keep)
    places = saved(occurrences(docs, 1 if short else min_chars))
    kinds = saved(places.groupBy("line").agg(F.min(F.struct("o", "k", "i")).alias("first"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("x").alias("x"), F.first("y").alias("y")))
    links = verified(docs, candidates(meetings(docs, threshold, min_chars), kinds, threshold), threshold, min_chars)
    links = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    near = links.join(kinds.select(F.col("line").alias("b"), "first"), "b").groupBy("a").agg(F.min("first").alias("near"), F.count("*").alias("links"))
    # Lines that occur once and are near no other have no part in this; those of a very frequent line can be split.
    known = kinds.join(near, kinds.line == near.a, "left").where("times > 1 OR links > 0")
    known = saved(known.select("line", F.least("first", "near").alias("first"), F.coalesce("links", F.lit(0)).alias("links")))
    marks = places.join(known, "line").withColumn("gone", F.struct("o", "k", "i") > F.col("first")).where("gone OR links > 0")
    lists = marks.withColumn("_j", F.hash("k")).groupBy("_j").agg(F.collect_list(F.struct("k", "o", "i", "gone", "links", F.col("first.o").alias("least"))).alias("_marks"))
    texts = docs.select(*TEXTS, "_keep") if keep else docs.select(*TEXTS)
    found = texts.join(lists, "_j", "left").select(*texts.columns, "_marks")
    schema = "doc_id long, n_lines long, n_removed long, n_links long, class_id long, kept_sha256 string, kept_text string"
    return carried_back(found.mapInArrow(_cut, schema + carried_type(texts)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        rows, k, o, i, gone, links, least = listed(block.column("_marks"), "k", "o", "i", "gone", "links", "least")
        own = (o == block.column("_o").to_numpy()[rows]) & (k == block.column("_k").to_numpy()[rows])
        drop: dict[int, set[int]] = {}
        count = np.zeros(block.num_rows, dtype=np.int64)
        first = block.column("_o").to_numpy().copy()
        for r, x, g, n, m in zip(rows[own].tolist(), i[own].tolist(), gone[own].tolist(), links[own].tolist(), least[own].tolist()):
            if x in (seen := drop.setdefault(r, set())) or -x - 1 in seen:
                continue  # the row is there more than once
            seen.add(x if g else -x - 1)
            count[r] += n
            first[r] = min(first[r], m)
        out = []
        for r, text in enumerate(block.column("text").to_pylist()):
            lines = text.split("\n")
            kept = [x for n, x in enumerate(lines) if n not in drop.get(r, ())]
            joined = "\n".join(kept)
            out.append((len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined))
        n, gone, sha, joined = zip(*out)
        classes = pa.array([None if x == LAST else x for x in first.tolist()], pa.int64())
        more = [x for x in block.schema.names if x == "_keep"]
        columns = [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count), classes, pa.array(sha), pa.array(joined, pa.string())]
        names = ["doc_id", "n_lines", "n_removed", "n_links", "class_id", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([*columns, *(block.column(x) for x in more)], names=[*names, *more])
