from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.texts import documents, frame, sortable
from weft.llm import ppm, quality
from weft.llm import toxicity as weak
from weft.llm.toxicity import SHOUT, Voters, label_model, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_base_counts_match_brute_force(spark):
    rows = documents()
    expected = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text.encode())
        lines = text.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if WORD.search(x.encode()) and x in lines[:i])
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = sum(any(windows.get(tuple(words[j : j + 3]), 0) > 1 for j in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words)))
        chars = sum(len(w.decode()) for w in words)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        expected.append((r[0], len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, repeat, failed))
    got = quality.quality(frame(spark, rows))
    assert sortable(tuple(r)[:7] for r in got.collect()) == sortable(expected)
    assert all(not r.kept for r in got.collect() if r.base_failed)
    assert quality.quality(frame(spark, rows).limit(0)).count() == 0


def test_divergence_rejects_odd_texts_only(spark):
    rng = random.Random(1)
    common = quality.COMMON["en"].split()[:30]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefghi") for _ in range(6)) for _ in range(120)) + "."
    rows = [(i, prose(), "en" if i % 2 else None) for i in range(60)]
    rows += [(100, " ".join("#%&|" * 3 + str(i) for i in range(120)), "en"), (101, " ".join(f"zz{i}qq" for i in range(120)), "en")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].kept and got[100].char_distance > 0.3
    assert not got[101].kept and got[101].word_distance > 0.5


def plain_distance(p: list[float], q: list[float]) -> float:
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def plain_verdicts(rows: list[tuple], base: dict, min_docs: int) -> dict:
    """(char_distance, word_distance, kept) of each row, by plain loops over texts and words."""
    hists = {}
    for i, r in enumerate(rows):
        text = r[1] or ""
        chars = [0] * 9
        for c in text:
            wide = ord(c) >= 0xC0 and c not in "×÷" and not 0x2000 <= ord(c) < 0x3040
            kind = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in " \t" else 5 if c in "\n\r\x0b\x0c" else 6 if c in ".,;:!?'\"-" else 7 if ord(c) < 128 else 2 if wide else 8
            chars[kind] += 1
        words = [w.strip(b".,;:!?'\"-").lower().decode(errors="replace") for w in WORD.findall(text.encode())]
        best = None
        for lang in sorted(quality.COMMON):
            if r[2] not in (lang, None):
                continue
            known = list(dict.fromkeys(quality.COMMON[lang].split()))
            count = [words.count(w) for w in known]
            count += [0] * (quality.N_WORDS - 1 - len(known)) + [len(words) - sum(count)]
            if best is None or count[-1] < best[1][-1]:
                best = lang, count
        hists[i] = best and best[0], chars, best and best[1], len(text), len(words)
    means = {}
    for lang in quality.COMMON:
        own = [h for i, h in hists.items() if h[0] == lang and h[3] >= 200 and h[4] >= 50 and not base[i]]
        if len(own) >= min_docs:
            means[lang] = [sum(h[1][k] / h[3] for h in own) for k in range(9)], [sum(h[2][k] / h[4] for h in own) for k in range(quality.N_WORDS)]
    out = {}
    for i, (lang, chars, count, n_chars, n_words) in hists.items():
        a = plain_distance(chars, means[lang][0]) if lang in means and n_chars >= 200 else None
        b = plain_distance(count, means[lang][1]) if lang in means and n_words >= 50 else None
        out[i] = a, b, not base[i] and (a or 0) <= 0.25 and (b or 0) <= 0.24 + 0.8 / math.sqrt(max(1, n_words))
    return out


def test_verdicts_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "en", "de", None, "xx"])
        common = quality.COMMON[lang if lang in quality.COMMON else "en"].split()
        share = rng.choice([0.0, 0.3, 0.5, 0.6])
        words = [rng.choice(common) if rng.random() < share else "".join(rng.choice("abcdefghiÉ#7") for _ in range(6)) for _ in range(rng.randint(5, 150))]
        rows.append((i, " ".join(words), lang))
    rows += [(90, "#|&%" * 300, "en"), (91, None, "en"), (92, "", None), (93, "same words here " * 60, "en"), (94, "x" * 500, "fr"), (None, rows[0][1], "en")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_docs=5).collect()}
    expected = plain_verdicts(rows, {i: got[r[0]].base_failed for i, r in enumerate(rows)}, 5)
    for i, r in enumerate(rows):
        a, b, kept = expected[i]
        assert got[r[0]].char_distance == (None if a is None else pytest.approx(a, abs=1e-9))
        assert got[r[0]].word_distance == (None if b is None else pytest.approx(b, abs=1e-9))
        assert got[r[0]].kept == kept
    assert {r.kept for r in got.values() if not r.base_failed} == {True, False}
    assert all(got[r[0]].word_distance is None for r in rows if r[2] in ("xx", "fr"))  # another language; too few for a reference


def test_jensen_shannon_distance():
    p, q = np.array([1, 0, 3]), np.array([0, 5, 0])
    assert quality.distance(p, p * 7) == pytest.approx(0)
    assert quality.distance(p, q) == pytest.approx(1)
    assert quality.distance(np.zeros(3), q) == 0
    a, b = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (a + b) / 2
    expected = math.sqrt(sum(x * math.log2(x / y) for x, y in zip(a, m)) / 2 + sum(x * math.log2(x / y) for x, y in zip(b, m)) / 2)
    assert quality.distance(a, b) == pytest.approx(expected)


def test_label_model_finds_the_latent_label():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.15
    rates = np.array([[0.01, 0.02, 0.01, 0.3], [0.5, 0.4, 0.6, 0.3]])
    votes = (rng.random((4000, 4)) < rates[y.astype(int)]).astype(float)
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # two voters that repeat the first
    post, found, weight = label_model(votes, np.where(votes[:, :3].any(axis=1), 0.9, 0.02), 0.2)
    assert ((post > 0.5) == y).mean() > 0.93
    assert found[1, 2] > 10 * found[0, 2]
    assert weight[0] < 0.5 < weight[2]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["gruxon", "gruxel", "gruxi", "vornak", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "en"))
    rows += [(1000, None), (None, ""), (5000, "gruxothers are what you vornak say moron"), rows[6]]
    labels += [(7, None, "en"), (8, 5, "en"), (None, 1, "en"), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = toxicity(docs, table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 900:
            assert r.predicted == (r.doc_id % 6 == 0)
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == 1 and by[1000].predicted == 0 and by[None].score == by[1000].score
    assert toxicity(docs.limit(0), table).count() == 0
    alone = {r.doc_id: r.predicted for r in toxicity(docs, table.limit(0)).collect()}
    assert alone[5000] == 1 and alone[1000] == 0


def plain_fit(rows: list[tuple[str, int]], voters: Voters, prior: float) -> tuple[list[float], list[float], float]:
    """Posteriors, weights and bias by loops: the label model on votes and labels, then the classifier."""
    fired = [voters.fired(t) for t, _ in rows]
    n, size = len(rows), len(voters.names)
    votes = [[float(k in f[0]) for k in range(size)] + [float(y == 1), float(y == 0)] for f, (_, y) in zip(fired, rows)]
    m = size + 2
    post, weight = [0.95 if y else 0.05 for _, y in rows], [1.0] * m
    for turn in range(25):
        rate = []
        for w in ([1 - p for p in post], post):
            rate.append([(sum(w[i] * votes[i][k] for i in range(n)) + 0.05) / (sum(w) + 1) for k in range(m)])
        if turn % 5 == 2:
            left = [[votes[i][k] - rate[0][k] - post[i] * (rate[1][k] - rate[0][k]) for k in range(m)] for i in range(n)]
            cov = [[sum(left[i][a] * left[i][b] for i in range(n)) / n for b in range(m)] for a in range(m)]
            spread = [math.sqrt(max(cov[k][k], 1e-12)) for k in range(m)]
            for a in range(m):
                tied = [1.0 if a == b else min(1.0, max(0.0, cov[a][b] / (spread[a] * spread[b]))) for b in range(m)]
                weight[a] = 1 / sum(x if x >= 0.1 else 0 for x in tied)
        for i in range(n):
            odds = math.log(prior / (1 - prior))
            for k in range(m):
                a, b = (rate[1][k], rate[0][k]) if votes[i][k] else (1 - rate[1][k], 1 - rate[0][k])
                odds += weight[k] * math.log(a / b)
            post[i] = 1 / (1 + math.exp(-min(30, max(-30, odds))))
        prior = min(0.5, max(1e-3, sum(post) / n))
    x = [[float(k in f[0]) for k in range(size)] + [float(f[1] > 0), math.log1p(f[1]), min(1.0, 20 * f[1] / max(1, f[2]))] for f in fired]
    mean = sum(post) / n
    w, b = [0.0] * (size + 3), math.log((mean + 1e-3) / (1 - mean + 1e-3))
    first, second = [0.0] * (size + 4), [0.0] * (size + 4)
    for t in range(1, 401):
        gap = [1 / (1 + math.exp(-min(30, max(-30, sum(p * q for p, q in zip(row, w)) + b)))) - y for row, y in zip(x, post)]
        grad = [sum(g * row[k] for g, row in zip(gap, x)) / n + 1e-4 * w[k] for k in range(size + 3)] + [sum(gap) / n]
        for k, g in enumerate(grad):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            step = 0.1 * (first[k] / (1 - 0.9**t)) / (math.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            if k < size + 3:
                w[k] -= step
            else:
                b -= step
    return post, w, b


def test_label_model_and_scores_match_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(weak, "SEEDS", "moron idiot scum")
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(60):
        toxic = i % 4 == 0
        words = [rng.choice(["calm", "plain", "nice", "day", "tea"]) for _ in range(12)] + [rng.choice(["moron", "vornak", "scum"])] * (toxic or i % 11 == 0)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [rows[3], (3, "another text of that id")]  # ids that repeat add no rows to the fit
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(labels, "doc_id long, toxic int")
    fitted = weak.fit(docs, table)
    train = [(t, labels[i][1]) for i, t in rows[:60] if zlib.crc32(str(i).encode()) % 5]
    assert fitted.rows == len(train)
    if "another text of that id" in {t for t, _ in map(tuple, weak._labelled(docs, table, 1000).collect())}:
        train = [(t if t != rows[3][1] else "another text of that id", y) for t, y in train]
    share = sum(y for _, y in train) / len(train)
    post, w, b = plain_fit(train, fitted.voters, min(0.5, max(0.001, share)))
    assert fitted.weights.tolist() == pytest.approx(w, abs=0.02) and fitted.bias == pytest.approx(b, abs=0.02)
    assert fitted.moved == sum((p >= 0.5) != bool(y) for p, (_, y) in zip(post, train))
    for r in toxicity(docs, table).collect():
        text = next(t for i, t in rows if i == r.doc_id) if r.doc_id != 3 else None
        if text is not None:
            on, hits, tokens = fitted.voters.fired(text)
            odds = b + sum(w[k] for k in on) + (hits > 0) * w[-3] + math.log1p(hits) * w[-2] + min(1.0, 20 * hits / tokens) * w[-1]
            assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=0.01)


def plain_ppm(train: list[bytes], text: bytes, order: int) -> float:
    lead = bytes([255]) * order
    seen: list[dict] = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        whole = lead + t + b"\xff"
        for i in range(order, len(whole)):
            for k in range(order + 1):
                seen[k][whole[i - k : i]][whole[i]] += 1
    total, whole = 0.0, lead + text + b"\xff"
    for i in range(order, len(whole)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            counts = {s: n for s, n in seen[k].get(whole[i - k : i], {}).items() if s not in out}
            if not counts:
                continue
            size = sum(counts.values()) + len(counts)
            if whole[i] in counts:
                total += math.log10(counts[whole[i]] / size)
                break
            total += math.log10(len(counts) / size)
            out |= set(counts)
        else:
            total -= math.log10(max(1, 256 - len(out)))
    return total


@pytest.mark.parametrize("words", [1 << 19, 20])
def test_scores_match_brute_force(spark, words):
    rows = documents(12, 40)
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = [low(r[1]) for r in rows if not held(r[0])]
    tally = Counter(w for t in train for w in WORD.findall(t))
    tally["end"] = len(train)
    total, kinds = sum(tally.values()), len(tally)
    expected = []
    for r in rows:
        tokens = [*WORD.findall(low(r[1])), "end"]
        base = sum(math.log10((tally[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        expected.append((r[0], held(r[0]), len(tokens), sum(tally[t] > 0 for t in tokens), total, base, plain_ppm(train, low(r[1]), 4)))
    got = ppm.scores(frame(spark, rows), words=words).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(got) == len(expected)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_scores_of_odd_tables(spark):
    rows = documents(12, 10)
    assert ppm.scores(frame(spark, rows).limit(0)).count() == 0
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1]
    got = ppm.scores(frame(spark, held)).collect()
    assert len(got) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert got[0].score == pytest.approx(-math.log10(256) * (len(held[[h[0] for h in held].index(got[0].doc_id)][1].encode()) + 1))


def test_few_nodes_still_give_probabilities(spark):
    rows = documents(12, 20)
    assert all(-1e9 < r.score < 0 for r in ppm.scores(frame(spark, rows), nodes=50).collect())


@pytest.mark.parametrize("nodes", [50, 1])
def test_runs_beyond_the_broadcast_are_scored_exactly(spark, nodes):
    rows = documents(12, 30)
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    train = [low(r[1]) for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    expected = sorted(plain_ppm(train, low(r[1]), 4) for r in rows)
    assert sorted(r.score for r in ppm.scores(frame(spark, rows), nodes=nodes).collect()) == pytest.approx(expected)


def test_shouting_counts_over_the_whole_text():
    voters = Voters(["moron", *SHOUT])
    upper = voters.place["!upper"]
    calm, loud = ["calm"] * 450, ["SHOUTED"] * 100
    assert upper in voters.fired(" ".join(calm + loud))[0]
    assert upper not in voters.fired(" ".join(["SHOUTED"] * 45 + calm))[0]
    assert upper not in voters.fired(" ".join(calm))[0] and upper not in voters.fired("")[0]
    assert voters.fired("Moron MORON moron OK") == ([0, upper], 3, 4)


def test_all_voters_that_the_sample_gives(spark):
    """700 words that only toxic rows hold: all are voters where no number bounds them, else the first by gain, then name."""
    names = [f"bad{i:03d}" for i in range(700)]
    rows = [(" ".join(names), 1)] * 3 + [(f"calm words number {i}", 0) for i in range(300)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    every, _ = weak.find_voters(sample, None)
    assert set(names) <= set(every)
    few, _ = weak.find_voters(sample, 10)
    found = lambda xs: [x for x in xs if x.startswith("bad")]
    assert len(found(few)) <= 10 and set(few) < set(every)
    assert len(found(weak.find_voters(sample)[0])) <= weak.VOTERS


def test_labels_hold_where_voters_tell_another_split(spark):
    """On this table the label model took the languages with few marks for clean, 21 of 45 toxic rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    assert weak.fit(docs, labels).moved <= 4
    got = toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "score").collect()
    toxic, clean = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert sum(a > b for a in toxic for b in clean) > 0.95 * len(toxic) * len(clean)
