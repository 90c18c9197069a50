"""The corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays, documents with
benchmark items go, and the rest is encoded. Each stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontamination, line_dedup, sentencepiece_codec, simhash, toxicity
from weft.session import use_checkpoints

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; what labels say outside the held-out fifth teaches the score.

    Null and empty texts are scored as ones without a vote; each row, null ids and repeated rows too, is judged by its
    whole text, however long; columns beyond those of documents go. An empty table, of documents or labels, is borne.
    """
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that occur earlier or nearly so; n_chars counts what is left.

    Lines of any length of texts of any length are compared, those under 30 characters aside. A null text becomes an empty one;
    null ids come after all others; rows equal in id and text are one document and keep the same lines; columns beyond
    those of documents go; an empty table gives an empty one.
    """
    cut = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by close fingerprints the one with the smallest id.

    Texts of any length are fingerprinted whole. Null and blank texts form a group; rows with a null id go if their group has an id, else all of them stay; rows
    that repeat the smallest id and its text stay together; columns beyond those of documents go; an empty table gives an empty one.
    """
    return simhash.first_of_groups(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: no four fifths of its five-word shingles, anywhere in a text of any length.

    Null and short texts, and null, short or repeated items, hold nothing; null ids and repeated rows are judged like
    others; columns beyond those of documents go; empty tables are borne.
    """
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, their number, and whether they decode to the text.

    Texts of any length are encoded whole. Null and empty texts have no ids; each row, null ids and repeated rows too, gives one; an empty table gives an empty one.
    """
    return sentencepiece_codec.encode(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. Stages' tables lie in the shared checkpoint folder; each goes when the
    next is whole, and the last, which the result reads, stays there."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _removed(spark, f"{folder}/{number - 1}")
    return docs


def _removed(spark: SparkSession, uri: str) -> None:
    """Removes a folder, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
