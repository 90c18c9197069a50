from __future__ import annotations

import hashlib
import itertools
import random

import pytest
import xxhash

from tests.llm.texts import documents, frame, key, sortable, unique
from weft.llm import line_dedup, simhash
from weft.llm.common import keyed
from weft.llm.decontamination import Index, contained_items
from weft.llm.line_dedup import BLANK, dedup_lines, edit_distance, segments, signatures
from weft.operators.components import components


def plain_edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(rng, text: str, n: int, letters: str) -> str:
    out = list(text)
    for _ in range(n):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        out[at : at + (kind > 0)] = [rng.choice(letters)] if kind < 2 else []
    return "".join(out)


def test_banded_distance_and_signatures():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 4), "abc")
        true = plain_edit_distance(a, b)
        for limit in (1, 2, 3):
            assert edit_distance(a, b, limit) == min(true, limit + 1)
        if a != b and true <= 2 and min(len(a), len(b)) >= 6:
            (one, probe_one), (two, probe_two) = signatures(a, 2, 6), signatures(b, 2, 6)
            assert set(one) & {*two, *probe_two} or set(two) & set(probe_one)
    assert [n for _, n in segments(11, 3)] == [3, 4, 4]


def lines_expected(rows, threshold=2, min_chars=30):
    places: dict[str, list] = {}
    for doc in unique(rows):
        for i, raw in enumerate(doc[1].split("\n")):
            if len(s := raw.strip(BLANK)) >= min_chars:
                places.setdefault(s, []).append((doc, i))
    near: dict[str, list[str]] = {s: [] for s in places}
    for a, b in itertools.combinations(places, 2):
        if abs(len(a) - len(b)) <= threshold and plain_edit_distance(a, b) <= threshold:
            near[a].append(b)
            near[b].append(a)
    out = []
    for r in rows:
        doc, kept, links, least = key(r), [], 0, key(r)[0]
        lines = doc[1].split("\n")
        for i, raw in enumerate(lines):
            s = raw.strip(BLANK)
            if s not in places:
                kept.append(raw)
                continue
            first = min(places[x][0] for x in (s, *near[s]))
            links += len(near[s])
            least = min(least, first[0][0])
            if first >= (doc, i):
                kept.append(raw)
        text = "\n".join(kept)
        out.append((r[0], len(lines), len(lines) - len(kept), links, None if least == 1 << 63 else least, hashlib.sha256(text.encode()).hexdigest(), text))
    return out


def test_hot_segments_are_split_where_near_lines_still_meet():
    """Near lines that share a hot signature share another one at the next level, whatever is hot."""
    rng = random.Random(12)
    buckets = 40
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(3, 16)))
        b = edited(rng, a, rng.randint(0, 2), "abc")
        if plain_edit_distance(a, b) > 2 or min(len(a), len(b)) < 3:
            continue
        hot: set[int] = set()
        for level in range(4):
            found = []
            for x in (a, b):
                sides = [signatures(t, e, 3 if level == 0 else 0, salt) for salt, t, e in line_dedup._within(x, hot, level, 2, 3, buckets)]
                found.append(({h for own, _ in sides for h in own}, {h for own, probes in sides for h in [*own, *probes]}))
            (own_a, all_a), (own_b, all_b) = found
            shared = own_a & all_b | own_b & all_a
            assert shared
            hot |= {line_dedup._cell(h, buckets) for h in shared}


@pytest.mark.parametrize("cell, broadcast, depth", [(4096, 500_000, 5), (2, 0, 0), (2, 0, 3), (6, 500_000, 5)])
def test_lines_match_brute_force(spark, monkeypatch, cell, broadcast, depth):
    monkeypatch.setattr(line_dedup, "CELL", cell)
    monkeypatch.setattr(line_dedup, "DEPTH", depth)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rng = random.Random(4)
    rows = documents(8, 30)
    for i in range(40):
        base = rows[i % 10][1].split("\n")[0]
        rows.append((500 + i, edited(rng, base, rng.randint(0, 3), "abcé") + "\nshort", *rows[0][2:]))
    expected = lines_expected(rows)
    assert sum(r[3] for r in expected) > 10
    assert sortable(dedup_lines(frame(spark, rows)).collect()) == sortable(expected)


def test_a_segment_of_very_many_lines_is_split(spark, monkeypatch):
    """Lines that share their first and last thirds don't all meet; near ones are found among them."""
    monkeypatch.setattr(line_dedup, "CELL", 15)
    rng = random.Random(13)
    lines = [f"Copyright notice of this page: {''.join(rng.choice('abcdefgh') for _ in range(24))} - all rights are reserved" for _ in range(90)]
    lines += [edited(rng, x, 2, "abc") for x in lines[:15]]
    rows = [(i, x, "en", "s", 1, "x", "y", "z", 1) for i, x in enumerate(lines)]
    docs = keyed(frame(spark, rows))
    sizes = [r["count"] for r in line_dedup.meetings(docs, 2, 30).groupBy("cell").count().collect()]
    assert sizes and max(sizes) <= 15
    assert sortable(dedup_lines(frame(spark, rows)).collect()) == sortable(lines_expected(rows))


def test_segments_known_to_be_hot_never_meet(spark, monkeypatch):
    """Where a sample tells of a segment that very many lines have, they are dealt by line and split at once; results stay the same."""
    rng = random.Random(14)
    lines = [f"Copyright notice of this page: {''.join(rng.choice('abcdefgh') for _ in range(24))} - all rights are reserved" for _ in range(90)]
    lines += [edited(rng, x, 2, "abc") for x in lines[:15]] + [f"{x} and {i}" for i, x in enumerate(lines[:9])]
    rows = [(i, x + "\n" + lines[i % 7], "en", "s", 1, "x", "y", "z", 1) for i, x in enumerate(lines)]
    expected = sortable(lines_expected(rows))
    docs = keyed(frame(spark, rows))
    assert len(line_dedup.frequent(docs, 2, 30)) == 0
    for cell, far, sampled in ((15, 1, 1), (4, 2, 1), (4, 1, 3)):
        monkeypatch.setattr(line_dedup, "CELL", cell)
        monkeypatch.setattr(line_dedup, "FAR", far)
        monkeypatch.setattr(line_dedup, "SAMPLED", sampled)
        assert len(line_dedup.frequent(docs, 2, 30)) > 0
        assert sortable(dedup_lines(frame(spark, rows)).collect()) == expected
    # Direct rows are one for each cell and line, whatever number of blocks has the line.
    known = line_dedup.frequent(docs, 2, 30)
    given = [(line_dedup._id(x), *line_dedup.signatures(x, 2, 30)) for x in lines[:40]]
    made = [b for _ in range(3) for b in line_dedup._emitted(iter(given), 16, known)]
    met = [(c, x) for b in line_dedup._meetings(iter(made), 4, False) for c, x, hot in zip(*(b.column(n).to_pylist() for n in ("cell", "line", "hot"))) if hot]
    cells = {(line_dedup._cell(h, 16) - (1 << 64 if line_dedup._cell(h, 16) >> 63 else 0), line) for line, own, probes in given for h in own + probes if h in set(known.tolist())}
    assert cells <= set(met)


def test_short_lines_go_where_they_repeat_exactly(spark):
    hot = "All rights reserved"
    rows = [(i, f"own text {i} of this row\n  {hot}\n\n{hot if i % 2 else hot + '.'}", "en", "s", 1, "x", "y", "z", 1) for i in range(30)]
    got = {r.doc_id: r for r in dedup_lines(frame(spark, rows), short=True).collect()}
    plain = {r.doc_id: r for r in dedup_lines(frame(spark, rows)).collect()}
    seen = set()
    for i, text, *_ in rows:
        kept = []
        for raw in text.split("\n"):
            if not raw.strip(BLANK) or raw.strip(BLANK) not in seen:
                kept.append(raw)
            seen.add(raw.strip(BLANK))
        assert got[i].kept_text == "\n".join(kept) and got[i].n_links == 0
        assert got[i].class_id == 0 and plain[i].n_removed == 0


def print_of(text: str) -> int:
    words = text.encode().lower().split()
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(nodes, linked) -> dict:
    out = {x: x for x in nodes}

    def top(x):
        while out[x] != x:
            x = out[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            out[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


@pytest.mark.parametrize("hot", [50_000, 1])
def test_simhash_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(2)
    rows = documents(9, 40)
    for i in range(60):
        words = rows[i % 20][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words), *rows[0][2:]))
    prints = {key(r): print_of(r[1] or "") for r in rows}
    root = roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict[int, int] = {}
    for doc, fp in prints.items():
        least[root[fp]] = min(least.get(root[fp], 1 << 63), doc[0])
    name = lambda x: None if x == 1 << 63 else x
    expected = [(r[0], f"{prints[key(r)]:016x}", name(least[root[prints[key(r)]]])) for r in rows]
    assert len({r[2] for r in expected}) < len({r[1] for r in expected})
    assert sortable(simhash.near_duplicates(frame(spark, rows)).collect()) == sortable(expected)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_every_close_pair_collides(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 2))}) for x in base for _ in range(60)}
    for bucket in (1, 1000):
        rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
        got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.close_pairs(rows, bucket=bucket).collect()}
        assert got == {frozenset(p) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 2}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (50, 51), (51, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_items_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = documents(10, 40)
    items = []
    for i in range(30):
        words = rows[i][1].split()
        size = rng.randint(3, 45)
        at = rng.randrange(max(1, len(words) - size))
        part = words[at : at + size]
        if i % 4 == 1 and part:
            part[rng.randrange(len(part))] = "other"
        items.append((i, " ".join(part).upper() if i % 5 == 0 else " ".join(part), "x"))
    items += [(90, None, "x"), (91, "", "x"), (None, items[6][1], "x"), items[2]]
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = lambda t: {tuple(low(t)[i : i + 5]) for i in range(len(low(t)) - 4)}
    docs = [(r[0], shingles(r[1])) for r in rows]
    expected = []
    for i, text, _ in items:
        own = shingles(text)
        expected += [(d, i, len(own), len(own & s), len(own & s) / len(own)) for d, s in docs if own and len(own & s) >= 0.8 * len(own)]
    assert len(expected) > 20
    table = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    for block, size in ((20_000, 16 << 20), (7, 16 << 20), (20_000, 300)):
        monkeypatch.setattr("weft.llm.decontamination.ITEMS", block)
        monkeypatch.setattr("weft.llm.decontamination.ITEM_BYTES", size)
        assert sortable(contained_items(frame(spark, rows), table).collect()) == sortable(expected)
    assert contained_items(frame(spark, rows), table.limit(0)).count() == 0
    assert contained_items(frame(spark, rows).limit(0), table).count() == 0
    assert Index([], 5, 8).classes == {}


def test_recall_of_damaged_items_in_long_documents(spark):
    """Passages that keep 80 % or a little more of an item's shingles, somewhere in 3,000 other words."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    items, docs = [], []
    for i in range(150):
        own = words(rng.choice([12, 30, 60, 130]))
        part, left = list(own), int(0.2 * (len(own) - 4))
        while left >= 5:  # a changed word breaks five shingles
            part[rng.randrange(len(part))] = "zzzzz"
            left -= 5
        at = rng.randint(0, 3000)
        around = words(3000)
        items.append((i, " ".join(own)))
        docs.append((i, " ".join(around[:at] + part + around[at:])))
    cut = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near = {i for i in range(150) if len(cut(items[i][1]) & cut(docs[i][1])) >= 0.8 * len(cut(items[i][1]))}
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(near) > 100 and {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in near}
