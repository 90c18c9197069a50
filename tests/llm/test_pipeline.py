from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_near import lines_expected, print_of, roots
from tests.llm.texts import documents, frame, sortable
from weft.llm.sentencepiece_codec import Pieces, normalised, read_model, stream
from weft.llm.simhash import first_of_groups

INSULTS = "moron scum idiot pathetic".split()


def table(spark, folder, rows, labels, items):
    kept = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return kept


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_the_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [r for r in documents(14, 50) if r[0] is None or r[0] < 100]
    toxic = set()
    for i in range(200, 260):
        words = rows[i % 40][1].split(" ") + ["end", str(i)]
        if i % 3 == 0:
            toxic.add(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), "en", "s", 5))
    labels = [(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None]
    items = [(i, " ".join(rows[i][1].split()[:20])) for i in (2, 5, 11)] + [(9, None)]
    kept = table(spark, str(tmp_path), rows, labels, items)
    left = [r for r in kept if r[0] not in toxic]
    cut = {(r[0], r[1]): e for r, e in zip(left, lines_expected(left))}
    left = [(r[0], cut[r[0], r[1]][-1], r[2], r[3], len(cut[r[0], r[1]][-1])) for r in left]
    prints = [print_of(r[1]) for r in left]
    root = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, p in zip(left, prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    left = [r for r, p in zip(left, prints) if least.get(root[p], r[0]) == r[0]]
    parts = [s for s in map(shingles, (t for _, t in items)) if s]
    left = [r for r in left if not any(len(s & shingles(r[1])) >= 0.8 * len(s) for s in parts)]
    pieces = Pieces(read_model())
    expected = [(*r, ids := stream(pieces, normalised(r[1])), len(ids), True) for r in left]
    assert 10 < len(expected) < len(rows) - len(toxic)
    assert sortable(corpus_pipeline.run(spark, str(tmp_path)).collect()) == sortable(expected)


def test_every_stage_bears_empty_tables(spark, tmp_path):
    table(spark, str(tmp_path), [], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes


def test_first_of_groups_keeps_columns(spark, monkeypatch):
    rows = frame(spark, documents(14, 20))
    few = first_of_groups(rows)
    assert few.columns == rows.columns
    monkeypatch.setattr("weft.llm.simhash.BROADCAST_ROWS", 0)
    assert sortable(first_of_groups(rows).collect()) == sortable(few.collect())
