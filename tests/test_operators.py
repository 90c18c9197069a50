from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import ids, paths, text
from weft.operators import asof, components, graph, ranking, rollup
from weft.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "pattern, path, fits",
    [
        ("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/**", "src/a/b.js", True), ("src/**", "lib/a.js", False),
        ("a/?.js", "a/b.js", True), ("a/?.js", "a/bb.js", False), ("*.{js,ts}", "x.ts", True), ("*.{js,{ts,tsx}}", "x.tsx", True), ("[abc].py", "b.py", True),
        ("[!abc].py", "b.py", False), ("[!abc].py", "d.py", True), ("a[", "a[", False), ("{a,b", "a", False), ("a.b", "axb", False), ("**/x/**", "p/x/q/r", True),
    ],
)
def test_globs(spark, pattern, path, fits):
    assert one(spark, paths.matches(F.lit(path), [pattern])) == fits


def test_paths(spark):
    for path, expected in {"./a/../b//c/.": "b/c", "../../x": "x", "a\\b\\..\\c": "a/c", "": "", "a/b": "a/b"}.items():
        assert one(spark, paths.normalised(F.lit(path))) == expected
    assert one(spark, paths.stem(F.lit("a/.gitignore"))) == ".gitignore" and one(spark, paths.stem(F.lit("a/b.test.ts"))) == "b.test"
    assert one(spark, paths.extension(F.lit("x/Y.TSX"))) == "tsx" and one(spark, paths.dirname(F.lit("top"))) == ""


def test_texts_and_ids(spark):
    for content, n in {"": 0, "a": 1, "a\n": 1, "a\nb": 2, "\n\n": 2}.items():
        assert one(spark, text.count_lines(F.lit(content))) == n
    assert one(spark, text.truncated(F.lit("abcdef"), 4)) == "abc…" and one(spark, text.truncated(F.lit("abcd"), 4)) == "abcd"
    assert one(spark, text.snake_case(F.lit("OrderLine"))) == "order_line"
    assert [one(spark, text.plural(F.lit(x))) for x in ("city", "box", "day", "cat")] == ["cities", "boxes", "days", "cats"]
    assert one(spark, ids.fnv1a(F.lit("ab"))) == 1294271946
    assert one(spark, ids.base36(F.lit(35 * 36 + 7))) == "z7"
    assert one(spark, ids.percent_encoded(F.lit("a b/c(d)*~!'"))) == "a%20b%2Fc(d)*~!'"
    row = spark.createDataFrame([("x = 1\n\nfoo(a)\nbar foo(b)\nfoo(a)\n",)], "content string").select(text.located("content", "foo\\((\\w)\\)").alias("f")).first()
    assert [(r.value, r.line) for r in row.f] == [("a", 3), ("b", 4), ("a", 5)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=25))
def test_asof_matches_brute_force(spark, left, right):
    right = [(k, t, n) for n, (k, t) in enumerate(dict.fromkeys(right))]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, k int, t int")
    b = spark.createDataFrame(right, "k int, t int, v int")
    for forward in (False, True):
        got = {r.i: r.v for r in asof.asof(a, b, ["k"], "t", ["v"], within=8, forward=forward).collect()}
        for i, (k, t) in enumerate(left):
            near = [(abs(t - u), v) for q, u, v in right if q == k and (u >= t if forward else u <= t) and abs(t - u) <= 8]
            assert got[i] == (min(near)[1] if near else None)


def test_ranking(spark):
    rows = spark.createDataFrame([(k, v) for k in "ab" for v in range(5)], "k string, v int")
    cut = ranking.top_with_hidden(rows, ["k"], [F.desc("v")], 2)
    assert {(r.k, r.v, r.hidden) for r in cut.collect()} == {("a", 4, 3), ("a", 3, 3), ("b", 4, 3), ("b", 3, 3)}
    names = spark.createDataFrame([(x,) for x in "aaabbbccd"], "x string")
    assert {r.name: r.n for r in ranking.composition(names, "x", 2).collect()} == {"a": 3, "b": 3, "other": 3}


def test_rollups(spark):
    frame = spark.createDataFrame([("a/b/x",), ("a/b/y",), ("a/z",), ("top",)], "path string")
    assert {r.folder: r.n for r in rollup.subtree_counts(frame, "path").collect()} == {"a": 3, "a/b": 2}
    roots = spark.createDataFrame([("a",), ("a/b",), ("q",)], "root string")
    assert {r.path: r.root for r in rollup.longest_prefix(frame, "path", roots, "root").collect()} == {"a/b/x": "a/b", "a/b/y": "a/b", "a/z": "a", "top": None}


def test_graphs(spark):
    nodes = spark.createDataFrame([(x, "module", "A" if x in "abc" else "B", x) for x in "abcdef"] + [("x", "external", "B", "x")], "id string, kind string, area string, label string")
    edges = spark.createDataFrame([("a", "b", "exact"), ("b", "a", "inferred"), ("a", "a", "exact"), ("c", "d", "unresolved"), ("c", "e", "exact"), ("d", "e", "exact")], "src string, dst string, confidence string")
    assert {r.id: r.degree for r in graph.degrees(nodes, edges).collect()} == {"a": 3, "b": 2, "c": 2, "d": 2, "e": 2, "f": 0, "x": 0}
    assert [r.id for r in graph.isolated(nodes, edges).collect()] == ["f"]
    assert tuple(graph.health(nodes, edges).first()) == (1, 1, 1)
    assert {(r.a, r.b): r.n for r in graph.undirected_pairs(edges).collect()}["a", "b"] == 2
    found = {r.area: (r.members, r.internal, r.crossing, r.neighbours) for r in graph.areas(nodes, edges).collect()}
    assert found == {"A": (3, 3, 2, ["B"]), "B": (4, 1, 2, ["A"])}
    folded = graph.boundary(nodes, edges, "A").collect()
    assert [(r.node, r.direction, r.n, r.labels, r.confidence) for r in folded] == [("c", "out", 2, ["d", "e"], "unresolved")]
    assert {(r.side, r.id) for r in graph.neighbours(edges, "a", 4).collect()} == {("out", "b"), ("in", "b")}
    path = spark.createDataFrame([("c", "d"), ("d", "e"), ("c", "e")], "src string, dst string")
    assert {r.id: r["rank"] for r in graph.longest_path_ranks(nodes, path).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 2, "f": 0, "x": 0}
    with pytest.raises(ValueError):
        graph.longest_path_ranks(nodes, edges, rounds=9)


def test_hubs_and_crossings(spark):
    nodes = spark.range(30).select(F.col("id").cast("string").alias("id"))
    edges = spark.createDataFrame([("0", str(i)) for i in range(13)] + [("1", "2")], "src string, dst string")
    assert [r.id for r in graph.hubs(nodes, edges).collect()] == ["0"]
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(5), rng.randrange(5)) for _ in range(30)]
    expected = {c: sum(a[1] < b[1] and a[2] > b[2] for a in rows for b in rows if a[0] == b[0] == c) for c in (0, 1)}
    assert {r.column: r.n for r in graph.crossings(spark.createDataFrame(rows, "column int, top int, bottom int")).collect()} == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(9)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(9)}}


def test_changes_stream(spark, tmp_path):
    moment = lambda ms: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)
    rows = [("a.py", moment(0)), ("b.py", moment(500)), (".env", moment(600)), ("node_modules/x.js", moment(700)), ("a.py", moment(5000)), ("z.py", moment(100_000))]
    source = str(tmp_path / "in")
    spark.createDataFrame([("w", *r) for r in rows], "workspace string, path string, ts timestamp").write.parquet(source)
    stream = spark.readStream.schema("workspace string, path string, ts timestamp").parquet(source)
    closed = changes.bursts(changes.relevant(stream), by="workspace")
    query = closed.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = {tuple(r.paths): r.n for r in changes.bursts(changes.relevant(spark.read.parquet(source))).collect()}
    assert batch == {("a.py", "b.py"): 2, ("a.py",): 1, ("z.py",): 1}
    assert {tuple(r.paths): r.n for r in spark.table("bursts").collect()} == {("a.py", "b.py"): 2, ("a.py",): 1}
    out = str(tmp_path / "out")
    changes.publish(stream, lambda n: spark.range(3).select(F.lit(n).alias("batch"), "id"), out, str(tmp_path / "check"), once=True).awaitTermination(60)
    spark.range(5).select(F.lit(9).alias("batch"), "id").write.parquet(f"{out}/revision=9")
    assert {r.batch for r in changes.latest(spark, out).collect()} == {9}
