"""Cycles of directed graphs (src, dst): groups of nodes that reach one another, ranks over them, and edges to turn so that none is left."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import longest_path_ranks
from weft.session import saved

#: Groups of up to so many edges are searched depth first, by one task each; in larger ones edges that run against the order of ids are turned.
SEARCHED = 2_000_000


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node, value: the greatest value that reaches each node along edges (src, dst), its own included; one round for each step of the way."""
    current = saved(start)
    while True:
        arriving = edges.join(current.withColumnsRenamed({"node": "src", "value": "_in"}), "src").groupBy(F.col("dst").alias("node")).agg(F.max("_in").alias("_in"))
        after = saved(current.join(arriving, "node", "left").select("node", F.greatest("value", "_in").alias("value"), (F.col("_in") > F.col("value")).alias("_moved")))
        if after.where("_moved").isEmpty():
            return after.select("node", "value")
        current = after.select("node", "value")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source is arrived at and whose target is left: what cycles can be made of, by dropping the others again and again."""
    edges, n = saved(edges), None
    while True:
        count = edges.count()
        if count == n or not count:
            return edges
        n = count
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = saved(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))


def mutual(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges: root is the least node that it reaches and that reaches it.

    Nodes on no cycle are trimmed away. Of what is left each node takes the greatest node that reaches it as its colour; among the nodes of a
    colour, those from which its node can be reached are one group. Edges between colours and those of the groups go, until none is left.
    Each round is a few joins of what is left of the edge table, checkpointed; loops and repeated edges do no harm.
    """
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left, found = _trimmed(edges.select("src", "dst").where("src <> dst").distinct()), []
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = _spread(nodes.select("node", F.col("node").alias("value")), left)
        of = lambda end: colours.select(F.col("node").alias(end), F.col("value").alias(f"_{end}"))  # noqa: B023, E731
        within = saved(left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("colour")))
        # Backwards from each colour's own node, along edges of its colour.
        reached, n = saved(colours.where("node = value").select("node", F.col("value").alias("colour"))), -1
        while (count := reached.count()) != n:
            n = count
            back = within.join(reached.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"], "left_semi").select(F.col("src").alias("node"), "colour")
            reached = saved(reached.unionByName(back).distinct())
        found.append(reached)
        done = reached.select("node")
        rest = within.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trimmed(rest.select("src", "dst"))
    if not found:
        return every.select("node", F.col("node").alias("root"))
    groups = reduce(DataFrame.unionByName, found)
    roots = groups.join(groups.groupBy("colour").agg(F.min("node").alias("root")), "colour").select("node", "root")
    return saved(every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def condensed_ranks(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """node, root, rank: the longest path of groups of mutual() to each node's group."""
    groups = mutual(edges) if groups is None else groups
    of = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    links = edges.join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    ranks = longest_path_ranks(groups.select(F.col("root").alias("id")).distinct(), saved(links))
    return groups.join(ranks.withColumnRenamed("id", "root"), "root").select("node", "root", "rank")


def back_edges(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which of the edges, sorted by source and target, a search depth first from the least node on finds leading to a node that it is below."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    heads, targets = at[: len(src)], at[len(src) :]
    first = np.searchsorted(heads, np.arange(len(ids) + 1)).tolist()
    targets, back = targets.tolist(), np.zeros(len(src), dtype=bool)
    state, place = [0] * len(ids), first[:-1]
    for start in range(len(ids)):
        if state[start]:
            continue
        stack, state[start] = [start], 1
        while stack:
            node = stack[-1]
            edge = place[node]
            if edge == first[node + 1]:
                state[node] = 2
                stack.pop()
                continue
            place[node] = edge + 1
            target = targets[edge]
            if state[target] == 1:
                back[edge] = True
            elif not state[target]:
                state[target] = 1
                stack.append(target)
    return back


def without_cycles(edges: DataFrame, groups: DataFrame | None = None, searched: int = SEARCHED) -> DataFrame:
    """src, dst, turned for each different edge: turned ones, taken the other way round, leave a graph without cycles (loops aside, which are turned).

    Only edges within a group of mutual() can be turned, so each group is searched by itself: depth first, nodes and edges in the order of
    ids, an edge to a node that is still open is turned. A group of more than `searched` edges isn't searched in one task: there, edges to
    smaller ids are turned, which leaves no cycle either, but turns more edges.
    """
    edges = edges.select("src", "dst").distinct()
    groups = mutual(edges) if groups is None else groups
    of = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
    placed = saved(edges.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", F.when((F.col("_src") == F.col("_dst")) & (F.col("src") != F.col("dst")), F.col("_src")).alias("root")))
    sizes = placed.where("root IS NOT NULL").groupBy("root").agg((F.count("*") > searched).alias("_large"))
    inside = placed.where("root IS NOT NULL").join(sizes, "root")
    kind = edges.schema["src"].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        table = table.select(["src", "dst"]).sort_by([("src", "ascending"), ("dst", "ascending")])
        turned = back_edges(*(table[c].to_numpy(zero_copy_only=False) for c in ("src", "dst")))
        return table.append_column("turned", pa.array(turned))

    found = inside.where("NOT _large").select("root", "src", "dst").groupBy("root").applyInArrow(search, f"src {kind}, dst {kind}, turned boolean")
    large = inside.where("_large").select("src", "dst", (F.col("src") > F.col("dst")).alias("turned"))
    others = placed.where("root IS NULL").select("src", "dst", (F.col("src") == F.col("dst")).alias("turned"))
    return found.unionByName(large).unionByName(others)
