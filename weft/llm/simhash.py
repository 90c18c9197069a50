"""SimHash near-duplicates with covering locality-sensitive hashing.

For radius r each bit i of the fingerprint has a non-zero vector m(i) of r + 1 bits. Table v, for each non-zero v,
keeps the bits with an odd product of m(i) and v. Any r differing bits have a common v with even products, so that
table drops them all: every pair within the radius collides in some table. A bucket that holds many fingerprints
is covered again on the bits its table dropped, so at depth three at most a few bits are free and buckets are small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LAST, blocks, keyed
from weft.operators.components import components
from weft.session import saved

RADIUS, SHINGLE, SEED = 2, 3, 42
#: A bucket with more fingerprints is covered again.
BUCKET = 32
DEPTH = 3
#: Rows of a small table that every task may be given; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A fingerprint of more documents than this is looked up apart, from a table that has at most one row for so many documents.
HOT = 50_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64. Without a word, zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())])
    n, counts = len(hashes) // 8, np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, `_o`, `_k` and fp (the fingerprint as a signed long) of keyed documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in block.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "_o", "_k")), pa.array(fp.view(np.int64))], names=["doc_id", "_o", "_k", "fp"])

    return docs.select("doc_id", "_o", "_k", "text").mapInArrow(each, "doc_id long, _o long, _k long, fp long")


def covering_masks(bits: int, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of `bits`: for any `radius` of them, some mask has none of these."""
    size = 1 << (radius + 1)
    places = [i for i in range(64) if bits >> i & 1]
    return [sum(1 << p for n, p in enumerate(places) if ((1 + n % (size - 1)) & v).bit_count() % 2) for v in range(1, size)]


def close_pairs(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """a, b: all pairs of different fingerprints (column fp, distinct) with at most `radius` differing bits."""
    everything = (1 << 64) - 1
    paths = [0]  # the bits that the tables of this depth keep
    rows = prints.select("fp", F.lit(0).alias("path"))
    found = []
    for level in range(depth):
        paths = [kept | mask for kept in paths for mask in covering_masks(everything & ~kept, radius)]
        masks = F.array(*(F.lit(p - (1 << 64) if p >> 63 else p) for p in paths))
        tables = (1 << (radius + 1)) - 1
        spread = rows.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda v: F.col("path") * tables + v)).alias("path"))
        spread = spread.withColumn("key", F.col("fp").bitwiseAND(F.element_at(masks, F.col("path") + 1)))
        sizes = spread.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        several = saved(spread.join(sizes, ["path", "key"]))
        last = level == depth - 1
        small = several if last else several.where(F.col("n") <= bucket)
        found.append(_pairs(small, radius))
        rows = several.where(F.col("n") > bucket).select("fp", "path")
        if last or rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def _pairs(rows: DataFrame, radius: int) -> DataFrame:
    a = rows.select("path", "key", F.col("fp").alias("a"))
    b = rows.select("path", "key", F.col("fp").alias("b"))
    near: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return a.join(b, (a.path == b.path) & (a.key == b.key) & (F.col("a") < F.col("b")) & near).select("a", "b")


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, `_k`, fp and component_id of keyed documents."""
    prints = saved(fingerprints(docs, shingle))
    distinct = saved(prints.groupBy("fp").agg(F.min("_o").alias("first"), F.count("*").alias("n")))
    member = components(close_pairs(distinct.select("fp"), radius))
    roots = distinct.join(member, distinct.fp == member.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("first").alias("least"))
    named = saved(roots.join(names, "root").select("fp", "n", F.when(F.col("least") < LAST, F.col("least")).alias("component_id")))
    columns = ["doc_id", "_k", "fp", "component_id"]
    hot = named.where(F.col("n") > HOT)
    if hot.isEmpty():
        return prints.join(named, "fp").select(*columns)
    # Copies of one text may be a third of all rows: their fingerprint goes to where the rows are.
    cold = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named, "fp")
    return prints.join(F.broadcast(hot), "fp").select(*columns).unionByName(cold.select(*columns))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id among documents reachable over pairs of
    fingerprints with at most `radius` differing bits.

    Texts are lower-cased (A-Z); null or blank texts have fingerprint zero, which links like any other. Rows with a
    null id take part and get a component; component_id is null only where all members' ids are null. Bits set in exactly half
    of the shingles are 0. Texts of any length are read whole. Repeated rows are each returned; an empty table gives an empty one;
    further columns are ignored.
    """
    hexa = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(keyed(docs), radius, shingle).select("doc_id", hexa, "component_id")


def first_of_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group; in a group without ids, all rows.

    Rows that repeat that id and text stay together. The keys of the others are handed to all tasks if they are few.
    """
    found = grouped(keyed(docs), radius, shingle).where("component_id IS NOT NULL AND NOT doc_id <=> component_id")
    gone = saved(found.select(F.col("_k").alias("_gone"), F.col("doc_id").alias("_gone_id")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    return docs.join(gone, (F.xxhash64(doc_id, text) == gone["_gone"]) & doc_id.eqNullSafe(gone["_gone_id"]), "left_anti")
