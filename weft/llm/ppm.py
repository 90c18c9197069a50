"""Scoring by prediction by partial matching, and by single words.

Training counts every run of five bytes; its endings give the shorter contexts of a byte-context trie. A byte is coded in
its longest known context; if it hasn't been seen there, an escape (method C: as likely as the context has different
successors) leads to the next shorter one, where the symbols already ruled out are excluded from the counts. The sum
of the logarithms is the text's log-probability. Texts end with a symbol of their own and begin after such symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOWER, blocks, flat, fold, groups, keyed, least_count, mix, word_bounds, word_hashes
from weft.session import saved

ORDER = 4
END = 0xFF  # no byte of UTF-8
#: Contexts of so many bytes are a bounded table (at most 256 ** 2 runs) that every task gets whole; longer ones are dealt by it.
SHORT = 2
#: Runs whose logarithms are handed to all tasks, and words whose counts are; all others are joined.
NODES = 1 << 20
WORDS = 1 << 19
END_WORD = 1  # the key of the end token; hashes of words are even
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)
#: Entries of a task's running counts before they are added up.
PENDING = 2 << 20


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of each row the last order + 1 symbols as one number, and where each row's begin."""
    n = np.diff(offsets)
    size = n + order + 1
    base = np.append(0, np.cumsum(size))
    stream = np.full(int(base[-1]), END, dtype=np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    stream[np.arange(len(data)) - offsets[row] + base[row] + order] = data
    out = np.zeros(len(stream) - order, dtype=np.uint64) if len(stream) > order else np.zeros(0, dtype=np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | stream[i : i + len(out)]
    keep = np.ones(len(out), dtype=bool)
    for i in range(order):  # runs that would end within the next row's lead
        at = base[1:-1] + i
        keep[at[at < len(out) + order] - order] = False
    return out[keep], np.append(0, np.cumsum(n + 1))


class Lookup:
    """A hash table from 64-bit keys to numbers, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.values, self.full = np.zeros(size, dtype=np.uint64), np.zeros(size), np.zeros(size, dtype=bool)
        keys = keys.astype(np.uint64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[~self.full[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            now = free[first]
            self.keys[slot[now]], self.values[slot[now]], self.full[slot[now]] = keys[now], values[now], True
            left = np.setdiff1d(left, now, assume_unique=True)
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys).view(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, and whether the key is there."""
        keys = keys.view(np.uint64)
        slot = self._slot(keys)
        known = self.full[slot] & (self.keys[slot] == keys)
        out = self.values[slot]
        left = np.flatnonzero(~known & self.full[slot])
        while len(left):
            slot[left] = slot[left] + 1 & self.mask
            at = slot[left]
            hit = self.full[at] & (self.keys[at] == keys[left])
            out[left[hit]], known[left[hit]] = self.values[at[hit]], True
            left = left[~hit & self.full[at]]
        return out, known


class Trie:
    """Counts of runs for each order, and the escapes between them."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts[k]: sorted runs of k + 1 symbols and how often each occurred."""
        self.runs, self.logs = [], []
        self.contexts: list[tuple] = []
        for k, (runs, count) in enumerate(counts):
            context = runs >> np.uint64(8)
            start = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(runs) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(count, start) if len(start) else count
            kinds = np.diff(np.append(start, len(runs)))
            ruled = np.zeros(len(start))  # counts, one order down, of the symbols seen here
            if k:
                low = np.uint64((1 << (8 * k)) - 1)
                shorter, number = counts[k - 1]
                at = np.searchsorted(shorter, runs & low)
                ruled = np.add.reduceat(number[at], start) if len(start) else ruled
            self.runs.append(runs)
            self.contexts.append((context[start], total, kinds, ruled))
            self.logs.append(count)

    def _context(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.contexts[k][0]
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        return at, (known[at] == key) if len(known) else np.zeros(len(key), dtype=bool)

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's last symbol after the others."""
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))
        ruled_n, ruled_q = np.zeros(len(wanted)), np.zeros(len(wanted))
        for k in range(len(self.runs) - 1, -1, -1):
            if not len(left):
                return out
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            run = wanted[left] & mask
            at, known = self._context(k, run >> np.uint64(8))
            here = left[known]
            _, total, kinds, ruled = (x[at[known]] if len(x) else x for x in self.contexts[k])
            q = kinds - ruled_q[here]
            whole = total - ruled_n[here] + q
            runs = self.runs[k]
            place = np.minimum(np.searchsorted(runs, run[known]), max(0, len(runs) - 1))
            hit = runs[place] == run[known]
            out[here[hit]] += np.log10(self.logs[k][place[hit]] / whole[hit])
            away = ~hit & (q > 0)
            out[here[away]] += np.log10(q[away] / whole[away])
            ruled_n[here], ruled_q[here] = ruled, kinds
            done = np.zeros(len(wanted), dtype=bool)
            done[here[hit]] = True
            left = left[~done[left]]
        if len(left):
            out[left] -= np.log10(np.maximum(1, 256 - ruled_q[left]))
        return out


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind (0: runs of order + 1 symbols, 1: words and ends), key, n over the rows of docs (text, held_out) that are not
    held out, and m over all rows. Words of held-out rows are not counted.

    A task adds up what its blocks count before Spark does; it holds a bounded number of entries.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for whole in blocks(batches):
            out = whole.column("held_out")
            for block, learns in ((whole.filter(pc.invert(out)), 1), (whole.filter(out), 0)):
                if not block.num_rows:
                    continue
                data, offsets = flat(block.column("text"))
                data = _LOWER[data]
                key, m = np.unique(grams(data, offsets, order)[0], return_counts=True)
                held[0].append((key, m * learns, m))
                if learns:
                    starts, ends, _ = word_bounds(data, offsets)
                    words, n = np.unique(_words(data, starts, ends), return_counts=True)
                    n = np.append(n, block.num_rows)
                    held[1].append((np.append(words, END_WORD), n, n))
            for kind in (0, 1):
                if sum(len(x[0]) for x in held[kind]) > PENDING:
                    total = _added(held[kind])
                    held[kind][:] = [total]
                    if len(total[0]) > PENDING // 2:
                        yield from _counts(kind, *total)
                        held[kind].clear()
        for kind in (0, 1):
            if held[kind]:
                yield from _counts(kind, *_added(held[kind]))

    found = docs.select("text", "held_out").mapInArrow(each, "kind int, key long, n long, m long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    key, *numbers = (np.concatenate(x) for x in zip(*parts))
    if not len(key):
        return key, *numbers
    order, new = groups(key)
    start = np.flatnonzero(new)
    return key[order][start], *(np.add.reduceat(n[order], start) for n in numbers)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (word_hashes(data, starts, ends) & ~np.uint64(1)).view(np.int64)


def _counts(kind: int, key: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 1 << 16):
        part, *numbers = key[at : at + (1 << 16)].view(np.int64), *(x[at : at + (1 << 16)].astype(np.int64) for x in (n, m))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, dtype=np.int32)), pa.array(part), *map(pa.array, numbers)], names=["kind", "key", "n", "m"])


def _endings(key: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted runs of `size` symbols that the runs end with, and their counts."""
    runs, count = _added([(key & np.uint64((1 << (8 * size)) - 1), n)])
    return runs, count.astype(np.float64)


def coded(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """key, m, v: every run, how often it occurs and log10 of the probability of its last symbol after the others.

    Runs meet by the symbols just before the last one. So a task has all training runs that follow a context of SHORT
    symbols or of more, and the counts of shorter ones come whole with it: nothing of the trie is left out.
    """
    runs = counts.where("kind = 0").select("key", "n", "m")
    short = min(order, SHORT)
    table = runs.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * short)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow() if short else None
    base = [_endings(table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy(), k + 1) for k in range(short)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        key, n, m = (pa.concat_arrays([b.column(c) for b in found]).to_numpy() for c in ("key", "n", "m"))
        key = key.view(np.uint64)
        known = n > 0
        trie = Trie([*base, *(_endings(key[known], n[known], k + 1) for k in range(short, order + 1))])
        for at in range(0, len(key), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(m[part]), pa.array(trie.log10(key[part]))], names=["key", "m", "v"])

    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * short)) - 1))
    return runs.repartition(context).mapInArrow(code, "key long, m long, v double")


def _lists(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each of the rows its different keys, and how often each occurs."""
    order, new = groups(row, key)
    start = np.flatnonzero(new)
    at = pa.array(np.append(0, np.cumsum(np.bincount(row[order][start], minlength=rows))).astype(np.int32))
    times = np.diff(np.append(start, len(key))).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(key[order][start])), pa.ListArray.from_arrays(at, pa.array(times))


def scores(docs: DataFrame, order: int = ORDER, nodes: int = NODES, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Both models learn from the documents whose crc32 of the id as text modulo 5 is not 1 (null ids among them); held_out
    tells that it is. A-Z are lower-cased. Tokens are words and one end for each text. base_score adds up
    log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens; n_known counts tokens with c > 0; score is the byte model's
    log10-probability of the text and its end. Null texts are empty. Rows equal in id and text each get the same row (and each
    is trained on); texts of any length are scored whole, one longer than a block as a block of its own; without
    training rows every symbol is as likely as any; an empty table gives an empty one; further columns are ignored.
    """
    docs = keyed(docs).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)))
    counts = saved(counted(docs, order))
    spark = docs.sparkSession
    vocabulary = counts.where("kind = 1").select(F.col("key").alias("w"), F.col("n").alias("c"))
    total, different = vocabulary.select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_count(vocabulary.withColumnRenamed("c", "n"), words)
    table = vocabulary.where(F.col("c") >= least).toArrow()
    key, number = table.column("w").to_numpy(), table.column("c").to_numpy()
    runs = saved(coded(counts, order))
    least_run = least_count(runs.withColumnRenamed("m", "n"), nodes)
    table = runs.where(F.col("m") >= least_run).toArrow()
    shared = spark.sparkContext.broadcast((Lookup(table.column("key").to_numpy(), table.column("v").to_numpy()), Lookup(key, np.log10(number + 0.5))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs_of, known = shared.value
        for block in blocks(batches):
            data, offsets = flat(block.column("text"))
            data = _LOWER[data]
            run, at = grams(data, offsets, order)
            logs, hit = logs_of.get(run)
            value = np.add.reduceat(np.where(hit, logs, 0), at[:-1])
            rare_runs = _lists(np.repeat(np.arange(block.num_rows), np.diff(at))[~hit], run[~hit].view(np.int64), block.num_rows)
            del run
            starts, ends, first = word_bounds(data, offsets)
            w = np.insert(_words(data, starts, ends), first[1:], END_WORD)  # an end after each row's words
            row = np.repeat(np.arange(block.num_rows), np.diff(first) + 1)
            logs, hit = known.get(w)
            base = np.bincount(row[hit], weights=logs[hit], minlength=block.num_rows)
            n_known = np.bincount(row[hit], minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.column(c) for c in ("doc_id", "_k", "held_out")),
                    pa.array(np.bincount(row, minlength=block.num_rows).astype(np.int64)),
                    pa.array(n_known.astype(np.int64)),
                    pa.array(base.astype(np.float64)),
                    pa.array(value.astype(np.float64)),
                    *_lists(row[~hit], w[~hit], block.num_rows),
                    *rare_runs,
                ],
                names=["doc_id", "_k", "held_out", "n_tokens", "n_known", "base", "score", "words", "times", "runs", "run_times"],
            )

    schema = "doc_id long, _k long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<bigint>, times array<int>, runs array<bigint>, run_times array<int>"
    scored = saved(docs.select("doc_id", "_k", "held_out", "text").mapInArrow(each, schema))
    once = scored.select("_k", "words", "times", "runs", "run_times").where("size(words) + size(runs) > 0").dropDuplicates(["_k"])
    rare = once.select("_k", F.explode(F.arrays_zip("words", "times")).alias("r")).select("_k", F.col("r.words").alias("w"), F.col("r.times").alias("m"))
    looked = rare.join(vocabulary.where(F.col("c") < least), "w", "left")
    sums = looked.groupBy("_k").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known")
    )
    rare = once.select("_k", F.explode(F.arrays_zip("runs", "run_times")).alias("r")).select("_k", F.col("r.runs").alias("key"), F.col("r.run_times").alias("times"))
    tails = rare.join(runs.where(F.col("m") < least_run).select("key", "v"), "key").groupBy("_k").agg(F.sum(F.col("times") * F.col("v")).alias("tail"))
    part = np.log10(total + 0.5 * (different + 1))
    return scored.join(sums, "_k", "left").join(tails, "_k", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(part))).alias("base_score"),
        (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )
