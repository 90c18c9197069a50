"""Texts beyond a block of 4 MB: what each operator and stage makes of a long text, its copy, and a passage at its very end."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from weft.llm import decontamination, line_dedup, ppm, quality, sentencepiece_codec, simhash, substring_dedup, suffix_dedup, toxicity
from weft.llm.common import BLOCK

PASSAGE = "a passage of some benchmark that nobody should ever train on because it is asked for later"


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(12)
    lines, size = [], 0
    while size < BLOCK + 400_000:
        lines.append(" ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(14)))
        size += len(lines[-1]) + 1
    long = "\n".join(lines) + "\n" + PASSAGE
    short = "one quiet text of a few plain words that stands between two long ones"
    return [(1, long, "en", "s", len(long)), (2, short, "en", "s", len(short)), (3, long, "en", "s", len(long)), (4, long[:-40] + "zzz", "en", "s", len(long) - 37)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(10, PASSAGE), (11, "some other thing that is nowhere to be found in all of these texts")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_quality(docs, rows):
    found = by_id(quality.quality(docs))
    for doc_id, text, *_ in rows:
        assert found[doc_id].n_words == len(text.split()) and found[doc_id].word_chars == sum(map(len, text.split()))
    assert found[1].base_failed is False and found[1].n_dup_lines == 0


def test_bytes(docs, rows):
    found = by_id(suffix_dedup.dedup_bytes(docs).drop("kept"))
    size = len(rows[0][1].encode())
    assert (found[1].n_removed, found[2].n_removed) == (0, 0) and found[1].kept_sha256 == sha(rows[0][1])
    assert (found[3].n_bytes, found[3].n_removed, found[3].n_spans, found[3].kept_sha256) == (size, size, 1, sha(""))
    assert found[4].n_removed == size - 40 and found[4].kept_sha256 == sha("zzz")


def test_words(docs, rows):
    found = by_id(substring_dedup.dedup_words(docs).drop("kept_text"))
    n = len(rows[0][1].split())
    assert found[1].n_removed == 0 and found[3].n_removed == found[3].n_words == n and found[3].kept_sha256 == sha("")
    mine, other = rows[3][1].split(), rows[0][1].split()
    same = next(i for i, (a, b) in enumerate(zip(mine, other)) if a != b)
    assert found[4].kept_sha256 == sha(" ".join(mine[same:]))


def test_ids(docs, rows):
    found = by_id(sentencepiece_codec.encode(docs.select("doc_id", "text")))
    decoded = [c for c in next(iter(found.values())).asDict() if isinstance(found[1][c], bool)]
    assert decoded and all(found[r[0]][c] for r in rows for c in decoded)


def test_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    found = by_id(toxicity.toxicity(docs, labels))
    assert set(found) == {1, 2, 3, 4} and found[1].score == found[3].score and all(0 <= r.score <= 1 for r in found.values())


def test_language_model(docs, rows):
    found = by_id(ppm.scores(docs))
    for doc_id, text, *_ in rows:
        assert found[doc_id].n_tokens == len(text.split()) + 1
    assert found[1].score == pytest.approx(found[3].score) and found[1].score < found[2].score < 0


def test_lines(docs, rows):
    found = by_id(line_dedup.dedup_lines(docs))
    assert found[1].kept_text == rows[0][1] and found[3].kept_text == "" and found[2].kept_text == rows[1][1]
    assert found[4].kept_text == rows[3][1].split("\n")[-1]


def test_items_and_groups(spark, docs, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect()} == {(1, 10), (3, 10)}
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 1}


def test_stages(spark, docs, rows, folder):
    out = {name: {r.doc_id: r for r in stage(spark, docs, folder).collect()} for name, stage in corpus_pipeline.STAGES}
    assert set(out["toxicity"]) == {1, 2, 3, 4} and out["toxicity"][1].text == rows[0][1]
    assert out["line dedup"][3].text == "" and out["line dedup"][1].text == rows[0][1]
    assert set(out["SimHash near-dedup"]) == {1, 2} and out["SimHash near-dedup"][1].text == rows[0][1]
    assert set(out["benchmark decontamination"]) == {2, 4}
    assert set(out["SentencePiece encoding"]) == {1, 2, 3, 4} and out["SentencePiece encoding"][1].text == rows[0][1]
