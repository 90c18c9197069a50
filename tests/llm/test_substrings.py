from __future__ import annotations

import hashlib
import random

import numpy as np

from tests.llm.texts import documents, frame, key, sortable, unique
from weft.llm import repeats, substring_dedup, suffix_dedup
from weft.llm.common import byte_values, keyed, least_places, mix, rolling, word_bounds, word_hashes
from weft.llm.substring_dedup import COVER, PERIOD, dedup_words
from weft.llm.suffix_dedup import common_prefix_classes, dedup_bytes


def removed(tokens: dict, width: int) -> dict:
    seen, out = set(), {}
    for doc in sorted(tokens):
        t = tokens[doc]
        gone = [False] * len(t)
        for s in range(len(t) - width + 1):
            window = tuple(t[s : s + width])
            if window in seen:
                gone[s : s + width] = [True] * width
            seen.add(window)
        out[doc] = gone
    return out


def words_expected(rows):
    tokens = {d: d[1].encode().split() for d in unique(rows)}
    gone = removed(tokens, 20)
    out = []
    for r in rows:
        t, g = tokens[key(r)], gone[key(r)]
        kept = b" ".join(w for w, x in zip(t, g) if not x)
        out.append((r[0], len(t), sum(g), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def bytes_expected(rows):
    tokens = {d: d[1].encode() for d in unique(rows)}
    gone = removed(tokens, 100)
    out = []
    for r in rows:
        t, g = tokens[key(r)], gone[key(r)]
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((r[0], len(t), sum(g), sum(a and not b for a, b in zip(g, [False, *g])), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_words_match_brute_force(spark):
    rows = documents()
    expected = words_expected(rows)
    assert sum(r[2] for r in expected) > 500
    assert sortable(dedup_words(frame(spark, rows)).collect()) == sortable(expected)


def test_bytes_match_brute_force(spark):
    rows = documents(5)
    expected = bytes_expected(rows)
    assert sum(r[2] for r in expected) > 1000
    got = [(*r[:5], bytes(r[5])) for r in dedup_bytes(frame(spark, rows)).collect()]
    assert sortable(got) == sortable(expected)


def test_bytes_with_heavy_anchors_and_small_chunks(spark, monkeypatch):
    rows = documents(6)
    monkeypatch.setattr(repeats, "HEAVY", 3)
    monkeypatch.setattr(suffix_dedup.spans, "__defaults__", (100, 24, 500, None))
    got = [(*r[:5], bytes(r[5])) for r in dedup_bytes(frame(spark, rows)).collect()]
    assert sortable(got) == sortable(bytes_expected(rows))


def shared_passage() -> list[tuple]:
    """A passage in every document, at its start in most, before words of the document's own."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    passage = words(40)
    texts = [f"{'' if i % 4 else words(i % 9)} {passage} {words(25)}".strip() for i in range(120)]
    return [(i, t, "en", "s", len(t), "x", "y", "z", 1) for i, t in enumerate(texts)]


def test_a_passage_of_every_document(spark, monkeypatch):
    """Its anchors are heavy, so windows at its borders, which all differ, are dealt one by one; nothing is lost."""
    rows = shared_passage()
    words, raw = sortable(words_expected(rows)), sortable(bytes_expected(rows))
    for heavy in (5, 20_000):
        monkeypatch.setattr(repeats, "HEAVY", heavy)
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
        assert sortable(dedup_words(frame(spark, rows)).collect()) == words
        assert sortable((*r[:5], bytes(r[5])) for r in dedup_bytes(frame(spark, rows)).collect()) == raw
    monkeypatch.setattr(repeats, "HEAVY", 5)
    docs = keyed(frame(spark, rows))
    hashes = []

    def anchors(data, offsets):
        starts, ends, at = word_bounds(data, offsets)
        h = mix(rolling(word_hashes(data, starts, ends), 8))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(h)]
        return h, row, np.arange(len(h)) - at[row], None

    found = repeats.repeated(docs, anchors)
    hot = repeats.hottest(found)
    for _, text in unique(rows):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        hashes.append(anchors(data, np.array([0, len(data)]))[0])
    h, times = np.unique(np.concatenate(hashes), return_counts=True)
    assert repeats.among(h, hot, repeats.spread(docs)).tolist() == (times > 5).tolist() and (times > 5).sum() == 33
    assert found.where("hot IS NULL").distinct().count() == times[times > 1].sum()


def test_empty_tables(spark):
    empty = frame(spark, documents()).limit(0)
    assert dedup_words(empty).count() == 0
    assert dedup_bytes(empty).count() == 0


def test_cover_reaches_all_shifts():
    for d in range(PERIOD):
        assert any((a - b) % PERIOD == d for a in COVER for b in COVER)


def test_interval_expansion_finds_common_prefixes():
    rng = random.Random(1)
    for length in (2, 5, 9):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
        data = np.array([c for p in parts for c in [*(ord(x) + 1 for x in p), 0]], dtype=np.uint16)
        order, new = common_prefix_classes(data, length)
        for a, b, fresh in zip(order, order[1:], new[1:]):
            x, y = data[a : a + length].tolist(), data[b : b + length].tolist()
            if 0 not in x and 0 not in y and len(x) == len(y) == length:
                assert fresh == (x != y)


def test_rolling_windows_depend_on_content_only():
    data = np.frombuffer(b"abcabcabcabd", dtype=np.uint8)
    for width in (1, 2, 3, 5, 7):
        h = rolling(byte_values(data), width)
        content = [data[i : i + width].tobytes() for i in range(len(data) - width + 1)]
        assert len(h) == len(content)
        assert all((h[i] == h[j]) == (content[i] == content[j]) for i in range(len(h)) for j in range(len(h)))


def test_the_least_place_is_the_first_of_equal_ones():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 5, 60).astype(np.uint64)
    for width in (1, 2, 3, 7, 13, 60):
        expected = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert least_places(values, width).tolist() == expected
