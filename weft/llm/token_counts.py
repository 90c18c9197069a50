"""Token counts of flat token files: a separator scan.

A file holds the ids of its documents one after another, each closed by an end-of-document id, without any index. It
is read in blocks of fixed size by many tasks; each looks for the separators of its block at once. Sums and maxima
over the blocks before (a prefix scan) then give each block the number of its first document and how many tokens of that lie in
earlier blocks.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import blocks
from weft.session import saved, use_checkpoints

#: Bytes of a block.
BLOCK_BYTES = 8 << 20
#: Ranks of a byte-level BPE of 50,256 ids; the id behind them is free and ends documents.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
# A fixed value: how that vocabulary splits texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space (as the pattern has it) that are too long for the pattern's search, which recurses on them.
RUN = 100_000
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Looked for at the first character of a run only, so that runs a little shorter cost no second look.
_BLANKS = re.compile(f"(?<!{_BLANK}){_BLANK}{{{RUN},}}")


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    """One table for each Python worker."""
    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def encoded(table: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text of any length.

    A long run of white space is one piece of the pattern, but for its last character, which goes to what follows; so it
    is cut out and merged by itself, and all ids are those of the whole text.
    """
    if len(text) < RUN:
        return table.encode_ordinary(text)
    out, at = [], 0
    for run in _BLANKS.finditer(text):
        out += table.encode_ordinary(text[at : run.start()])
        at = run.end() if run.end() == len(text) else run.end() - 1
        out += table._encode_single_piece(text[run.start() : at])
    return out + table.encode_ordinary(text[at:])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, ranks: str = RANKS, end: int = END, dtype: str = "<u2") -> DataFrame:
    """Writes one flat file of ids for each partition; returns path, first, doc_ids: the documents of a file in order,
    some hundred to a row, of which the first has number `first`.

    The driver reads the rank file and sends it along. folder must be one that all executors and the driver share. The result is checkpointed: a task that is run again
    writes another file, and files that the result doesn't name don't count.
    """
    with open(ranks, "rb") as f:
        data = f.read()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, path, out, number = encoding(data), f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        for block in blocks(batches):
            if out is None:
                store, inside = _open(path)
                store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(inside)
            for text in block.column("text").to_pylist():
                out.write(np.array([*encoded(table, text), end], dtype=dtype).tobytes())  # an id too large for dtype is an error
            doc_ids = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int64()), doc_ids], names=["path", "first", "doc_ids"])
            number += block.num_rows
        if out is not None:
            out.close()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return saved(source.mapInArrow(each, "path string, first long, doc_ids array<bigint>"))


def count_tokens(files: DataFrame, end: int = END, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, number, n_tokens, closed of each document of flat token files (column path: distinct URIs).

    The separator isn't counted. Tokens after the last separator are a document too, with closed false; an empty
    file has none. A null path gives none; a file that ends within an id is an error.
    """
    item = np.dtype(dtype).itemsize
    step = max(1, block_bytes // item) * item

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                store, inside = _open(path)
                size = store.get_file_info(inside).size
                if size % item:
                    raise ValueError(f"{path} ends within an id")
                n = -(-size // step)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64())], names=["path", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = _open(path)
                with store.open_input_file(inside) as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(step), dtype=dtype)
                at = np.flatnonzero(ids == end)
                head = int(at[0]) if len(at) else None
                last = block * (step // item) + int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), *(pa.array([x], pa.int64()) for x in (block, len(ids), head, last, len(at))), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    names=["path", "block", "n", "head", "last", "ends", "inner"],
                )

    parts = files.select("path").mapInArrow(cut, "path string, block long").repartition("path", "block")
    found = saved(parts.mapInArrow(scan, "path string, block long, n long, head long, last long, ends long, inner array<bigint>"))
    # Only numbers go through the scan over a file's blocks; the lists of its documents are joined to the result.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    opened = F.coalesce(F.max("last").over(before) + 1, F.lit(0))
    first = F.coalesce(F.sum("ends").over(before), F.lit(0))
    at_end = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    stitched = found.select("path", "block", "n", "head", "last", "ends", start.alias("start"), opened.alias("opened"), first.alias("first"), at_end.alias("at_end"))
    yes, no = F.lit(True).alias("closed"), F.lit(False).alias("closed")
    heads = stitched.where("ends > 0").select("path", F.col("first").alias("number"), (F.col("start") - F.col("opened") + F.col("head")).alias("n_tokens"), yes)
    lists = found.where("ends > 1").select("path", "block", "inner").join(stitched.select("path", "block", "first"), ["path", "block"])
    inside = lists.select("path", "first", F.posexplode("inner").alias("nth", "n_tokens")).select("path", (F.col("first") + F.col("nth") + 1).alias("number"), "n_tokens", yes)
    rest = F.col("start") + F.col("n") - F.greatest(F.col("opened"), F.coalesce(F.col("last") + 1, F.lit(0)))
    tail = stitched.where(F.col("at_end") & (rest > 0)).select("path", (F.col("first") + F.col("ends")).alias("number"), rest.alias("n_tokens"), no)
    return heads.unionByName(inside).unionByName(tail)


def document_token_counts(docs: DataFrame, ranks: str = RANKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens: docs written as flat token files in the shared checkpoint folder, and counted there.

    Null and empty texts have none; texts of any length are encoded whole; null ids and repeated rows are returned as they
    are; an empty table gives an empty one; further columns are ignored. The result is checkpointed and the files are
    removed then, those of failed tasks too.
    """
    spark = docs.sparkSession
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    written = write_token_files(docs, folder, ranks)
    counts = count_tokens(written.select("path").distinct(), block_bytes=block_bytes)
    documents = written.select("path", "first", F.posexplode("doc_ids").alias("nth", "doc_id")).select("path", (F.col("first") + F.col("nth")).alias("number"), "doc_id")
    # Both sides grow with the documents, so neither is to be broadcast.
    result = saved(documents.hint("merge").join(counts, ["path", "number"]).select("doc_id", "n_tokens"))
    store, inside = _open(folder)
    if store.get_file_info(inside).type == fs.FileType.Directory:
        store.delete_dir(inside)
    return result
