"""Labels that are told to all tasks, against those that are sent along the edges."""

from __future__ import annotations

import pytest

from tests.test_cycles import clustered, frame, plain_labels
from weft.operators import communities, graph


@pytest.mark.parametrize("packed", [4096, 4])
def test_told_labels_send_no_edge_and_are_those_of_plain_voting(spark, monkeypatch, packed):
    monkeypatch.setattr(communities, "PACKED", packed)
    edges = clustered(6)
    nodes = sorted({x for e in edges for x in e})
    table = spark.createDataFrame([(x,) for x in nodes], "id long")
    hub = {r.id for r in graph.hubs(table, frame(spark, edges)).collect()}
    told, used = communities._told, []
    monkeypatch.setattr(communities, "_told", lambda *a: used.append(1) or told(*a))
    found = {r.id: r.community for r in communities.communities(table, frame(spark, edges), grouped=0).collect()}
    assert used and found == plain_labels(nodes, edges, hub)
    monkeypatch.setattr(communities, "TOLD", 1)
    sent = {r.id: r.community for r in communities.communities(table, frame(spark, edges), grouped=0).collect()}
    assert len(used) == 1 and sent == found


def test_names_are_numbered_in_their_order(spark):
    edges = [(f"é{x:03d}" if x % 2 else f"z{x:03d}", f"é{y:03d}" if y % 2 else f"z{y:03d}") for x, y in clustered(7) if x != y]
    nodes = sorted({x for e in edges for x in e})
    table, links = spark.createDataFrame([(x,) for x in nodes], "id string").repartition(5), spark.createDataFrame(edges, "src string, dst string")
    whole = {r.id: r.community for r in communities.communities(table, links).collect()}
    assert {r.id: r.community for r in communities.communities(table, links, grouped=0).collect()} == whole
