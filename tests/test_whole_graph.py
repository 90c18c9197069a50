"""The graph queries over every line against brute force."""

from __future__ import annotations

import random

import pytest

from weft import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    out = tmp_path_factory.mktemp("graph")
    lines = [(n // 3 + 1, rng.randint(1, 120), rng.randint(1, 25), n % 3 + 1) for n in range(90)] + [(900 + n, 3, 5, 1) for n in range(60)] + [(16, 14, 2, 4)]
    spark.createDataFrame([(k,) for k in range(1, 201)], "p_partkey long").write.parquet(f"{out}/part.parquet")
    spark.createDataFrame([(k,) for k in range(5)], "c_custkey long").write.parquet(f"{out}/customer.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{out}/lineitem.parquet")
    return str(out), [(p, s * 7, s % 3) for _, p, s, _ in lines if p != s * 7]


def test_degrees_isolated_health_and_hubs(spark, folder):
    path, edges = folder
    degree = {k: sum((a == k) + (b == k) for a, b, _ in edges) for k in range(1, 201)}
    got = {r.id: r.degree for r in queries.degree(spark, path).collect()}
    more = {10**12 + k for k in range(5)}
    assert got == degree | dict.fromkeys(more, 0)
    alone = {k for k, n in degree.items() if not n and k % 10} | more
    assert {r.id for r in queries.isolated(spark, path).collect()} == alone
    assert tuple(queries.graph_health(spark, path).first()) == (sum(x == 1 for *_, x in edges), sum(x == 2 for *_, x in edges), len(alone))
    assert {(r.id, r.degree) for r in queries.hubs(spark, path).collect()} == {(k, n) for k, n in degree.items() if n >= 45}


def test_components_of_every_line(spark, folder):
    path, edges = folder
    root = {x: x for a, b, _ in edges for x in (a, b)}
    while any(root[a] != root[b] for a, b, _ in edges):
        for a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in queries.component_roots(spark, path).collect()} == root


def test_ends_meet_once_and_levels_are_written_once(spark, monkeypatch):
    from weft.operators import communities, graph

    nodes = spark.createDataFrame([(i, "module") for i in range(8)], "id long, kind string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] * 50, "src long, dst long")
    assert [r.id for r in graph.isolated(nodes, edges).collect()] == [7]
    assert "Aggregate" in graph.isolated(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    written = []
    keep = communities.saved
    monkeypatch.setattr(communities, "saved", lambda frame: written.append(keep(frame)) or written[-1])
    found = communities.breadth_first(nodes.select("id"), edges)
    assert found.count() == 8
    rows = sum(f.count() for f in written if "way" in f.columns)
    assert rows == 8
