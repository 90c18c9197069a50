"""Small tables with what the operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, `KEPT` string, line string, h int"


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(40))
    line = " ".join(words(12))
    texts = []
    for i in range(n):
        lines = [" ".join(words(rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 4 == 0:
            lines.append(line if i % 8 else line[:-1] + "x")
        texts.append("\n".join(lines))
    texts += [texts[0], texts[5], texts[5][:-3] + "zzz", "", "   \n\t ", "a", "x" * 700, "ab" * 400, "é" * 130, " ".join(words(3000))]
    texts += [texts[7].replace("a", "A"), "one two", "Same.\nSame.\nSame line that is quite long enough here\nSame line that is quite long enough here"]
    rows = [(i, t, "en", "s", len(t), "x", "y", "z", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None, None, None, None), (n + 50, None, "en", "s", None, None, None, None, None)]
    rows += [rows[4], rows[9], (None, texts[1], "??", None, None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def unique(rows: list[tuple]) -> list[tuple]:
    """(order, text) of the different documents, earliest first; null ids last."""
    return sorted({(1 << 63 if r[0] is None else r[0], r[1] or "") for r in rows})


def key(row: tuple) -> tuple:
    return (1 << 63 if row[0] is None else row[0], row[1] or "")


def sortable(rows) -> list[tuple]:
    return sorted((tuple((x is None, x) for x in r) for r in map(tuple, rows)), key=repr)
