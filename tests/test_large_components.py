"""Labels of components that are too large for one group, against those that a group gives."""

from __future__ import annotations

import numpy as np
import pytest

from tests.test_cycles import clustered, frame, plain_labels
from weft.operators import communities, graph


@pytest.mark.parametrize("edges, least", [(clustered(3), 0), (clustered(4), 30), ([(x, x + 1) for x in range(12)] + [(40, 41), (41, 40), (42, 41)], 5)])
def test_components_over_a_size_are_no_group_and_have_the_same_labels(spark, monkeypatch, edges, least):
    nodes = sorted({x for e in edges for x in e} | {500})
    table = spark.createDataFrame([(x,) for x in nodes], "id long")
    hub = {r.id for r in graph.hubs(table, frame(spark, edges)).collect()}
    whole = communities.communities(table, frame(spark, edges)).collect()
    passed, written = communities._passed, []
    monkeypatch.setattr(communities, "_passed", lambda own, *more: written.append(own.count()) or passed(own, *more))
    found = communities.communities(table, frame(spark, edges), grouped=least).collect()
    assert written and written[0] > least
    assert {tuple(r) for r in found} == {tuple(r) for r in whole}
    assert {r.id: r.community for r in found} == plain_labels(nodes, edges, hub)


def test_neighbours_of_a_hub_fill_several_rows(spark, monkeypatch):
    monkeypatch.setattr(communities, "PACKED", 4)
    edges = [(f"n{x:02d}", f"n{y:02d}") for x, y in clustered(5) if x != y]
    nodes = sorted({x for e in edges for x in e})
    table, links = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
    hub = {r.id for r in graph.hubs(table, links).collect()}
    ids, found = communities.labels(np.array([a for a, _ in edges], dtype=object), np.array([b for _, b in edges], dtype=object), hub)
    got = {r.id: r.community for r in communities.communities(table, links, grouped=0).collect()}
    assert got == dict(zip(ids, found))
