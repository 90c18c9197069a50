from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.texts import documents, frame, sortable
from weft.llm import fill_middle, filter_audit, mixing
from weft.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labelled(spark, rows):
    found = [(r[0], (r[0] * 7) % 3 % 2, zlib.crc32(str(r[0]).encode()) % 2) for r in rows if r[0] is not None and r[0] % 4]
    return found, spark.createDataFrame([*found, (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")


def audited(rows, labels):
    """The rows of the audit, by plain loops."""
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1} for i in (0, 1))
    first: dict[str, int] = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    failed = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        late = text in first and (r[0] is None or r[0] > first[text])
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": late}
        failed.append((r[3] or "", {k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    out = {}
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        shapley = {x: 0 for x in "ABCDE"}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                failing = sum(x in f[1] for f in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_against_plain_loops(spark):
    rows = documents() + [(900 + i, "A B " * 150 + "$" * (i % 2), "en", (None, "t")[i % 2], 1, "x", "y", "z", 1) for i in range(9)]
    rows += [(880, " ".join(f"w{i}" for i in range(300)), "en", "t", 1, "x", "y", "z", 1)]
    found, labels = labelled(spark, rows)
    expected = audited(rows, [*found, (5, 0, 1)])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(frame(spark, rows), labels).collect()}
    assert got == expected and len(got) == 600 * len({r[3] or "" for r in rows})
    empty = filter_audit.audit(frame(spark, rows).limit(0), labels)
    assert empty.count() == 0
    assert filter_audit.audit(frame(spark, rows), labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_words_of_a_very_long_text(spark):
    text = "word other " * 600_000
    rows = [(1, text, "en", "s", 1, "", "", "", 1)]
    step = filter_audit.audit(frame(spark, rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    first = {r.filter_order[0]: r.removed for r in step.where("step = 1").collect()}
    assert first == {"A": 0, "B": 1, "C": 0, "D": 0, "E": 0}


def sql_rows(name, rows, columns):
    arrays = list(zip(*rows))
    documents = pa.table({"doc_id": pa.array(arrays[0], pa.int64()), "text": pa.array(arrays[1], pa.string()), "source": pa.array(arrays[3], pa.string())})  # noqa: F841
    found = duckdb.sql(ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    return [tuple(r[i] for i in at) for r in found.fetchall()]


def mixed_rows():
    rng = random.Random(8)
    rows = documents()
    for i in range(3000):
        source = rng.choice(["a", "a", "a", "b", "c", "é", None, "z" * 3])
        rows.append((1000 + i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60) if source != "b" else 2)), "en", source, 1, "x", "y", "z", 1))
    rows += [(2_000_000, "same words here", "en", "c", 1, "x", "y", "z", 1)] * 200
    rows += [(3_000_000 + i, "", "en", "none", 0, "x", "y", "z", 1) for i in range(50)]
    rows += [(4_000_000, "long " * 30_000, "en", "long", 0, "x", "y", "z", 1)]
    return rows


def test_mix_against_sql_and_its_goal(spark, monkeypatch):
    rows = mixed_rows()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    result = mixing.mix(frame(spark, rows))
    assert result.columns == columns
    rounded = lambda found: sorted(((d if d is not None else -1, s, a, round(t, 6), k) for d, s, a, t, k in found))
    got = [tuple(r) for r in result.collect()]
    assert rounded(got) == rounded(sql_rows("op12_source_mixing", rows, columns))
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    by_target: dict = {}
    for _, _, source_size, target, taken in got:
        by_target.setdefault((source_size, target), []).append(taken)
    assert abs(sum(t for _, t in by_target) - 1.5 * sum(r[1] for r in got)) < 1e-3
    for (_, target), taken in by_target.items():
        assert target - 250 <= sum(taken) <= target + 1  # equal rows round down
    monkeypatch.setattr(mixing, "BROADCAST", 0)  # the join for many sources
    assert rounded(tuple(r) for r in mixing.mix(frame(spark, rows)).collect()) == rounded(got)


def test_shards_and_documents_of_a_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 128)
    monkeypatch.setattr(mixing, "STRETCH", 2)
    rows = mixed_rows()
    mix = mixing.Mix(frame(spark, rows))
    draws = mix.draws.collect()
    assert len({(d.sid, d["pass"], d.block) for d in draws}) == len(draws)
    per = {}
    for d in draws:
        per.setdefault(d.shard, []).append(d.place)
    assert len(per) > 1 and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(p) == list(range(len(p))) for p in per.values())
    again = mixing.Mix(frame(spark, rows)).draws.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, draws))
    words = mix.documents().groupBy("doc_id").agg(F.sum("words").alias("words"))
    taken = mix.taken().groupBy("doc_id").agg(F.sum("taken").alias("taken")).where("taken > 0")
    assert sortable(words.collect()) == sortable(taken.collect())
    for empty in (frame(spark, rows).limit(0), frame(spark, [(1, "", "en", "s", 0, "", "", "", 1), (2, None, "en", None, 0, "", "", "", 1)])):
        assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in mixing.mix(empty).collect()) and mixing.mix(empty).count() == empty.count()


@pytest.mark.parametrize("total, marked, drawn", [(1000, 300, 500), (50, 5, 25), (20_000, 11_000, 10_000), (7, 7, 3), (9, 0, 4)])
def test_hypergeometric_draws(spark, total, marked, drawn):
    n = 40_000
    uniform = (F.col("id") + 0.5) / n
    made = spark.range(n).select(mixing.hypergeometric(uniform, *(F.lit(x).cast("long") for x in (total, marked, drawn))).alias("x"))
    row = made.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("a"), F.max("x").alias("b")).first()
    p = marked / total
    variance = drawn * p * (1 - p) * (total - drawn) / max(1, total - 1)
    assert abs(row.m - drawn * p) < 4 * (variance / n) ** 0.5 + 1e-3 and abs(row.v - variance) < 0.03 * variance + 1e-3
    assert row.a >= max(0, drawn + marked - total) and row.b <= min(marked, drawn)


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_against_plain_python(spark):
    rows = documents() + [(700, "a <P> b\nc", "en", "s", 1, "", "", "", 1), (701, "<P\n>\n<S\n", "en", "s", 1, "", "", "", 1), (702, "\n\n\n", "en", "s", 1, "", "", "", 1), (703, "x\r\ny z\n𝄞<", "en", "s", 1, "", "", "", 1)]
    rows += [(704, "line\n" * 200_000, "en", "s", 1, "", "", "", 1), (705, "w" * 2_000_000, "en", "s", 1, "", "", "", 1)]
    made = fill_middle.fill_in_middle(frame(spark, rows), keep=("lang", "KEPT", "h"))
    expected = [(r[0], *plain_middle(r[0], r[1]), r[2], r[6], r[7 + 1]) for r in rows]
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "lang", "KEPT", "h"]
    assert made.columns == columns and sortable(made.collect()) == sortable(expected)
    back = fill_middle.with_digests(fill_middle.fill_in_middle(frame(spark, rows)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sortable(back.select("doc_id", "output_sha256", "restored_sha256").collect()) == sortable((r[0], sha(plain_middle(r[0], r[1])[4]), sha(r[1] or "")) for r in rows)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, rows), rate=0).where("form <> 'plain'").count() == 0
    assert fill_middle.fill_in_middle(frame(spark, rows).limit(0)).count() == 0
