"""Communities of a graph (src, dst): labels passed among neighbours, small groups merged, and the nodes that tie areas together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.components import components
from weft.operators.graph import degrees, hubs
from weft.session import saved

#: Rounds of passing labels, and what a hub's vote is worth.
ROUNDS, HUB_VOTE = 14, 0.06
#: Votes that differ by no more are equal.
EQUAL = 1e-9
#: A component of up to so many edges is one group; of a larger one's neighbours a row holds about so many.
GROUPED, PACKED = 1_000_000, 4096
#: The labels of up to so many nodes are told to all tasks; those of more are sent along the edges. Votes that are counted at once.
TOLD, COUNTED = 1 << 21, 1 << 20
#: Communities of fewer members are merged.
LEAST = 5
#: A core is told of graphs of so many nodes and areas, and has so many members.
CORE_NODES, CORE_AREAS, CORE_MEMBERS = 16, 3, (2, 10)


def labels(src: np.ndarray, dst: np.ndarray, hub: set, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, and each one's label: the node whose name it took.

    In every round the nodes, one after another in the order of ids, take the label with most votes among their neighbours as these are by
    then, the least of equal ones. A vote is worth 1 / sqrt(degree), parallel edges count each, and a hub's is worth little.
    """
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends, kind="stable")
    degree = np.bincount(ends, minlength=len(ids))
    first = np.append(0, np.cumsum(degree)).tolist()
    near = others[order].tolist()
    weight = (np.where(np.isin(ids, list(hub)), HUB_VOTE, 1.0) / np.sqrt(np.maximum(1, degree))).tolist()
    label = list(range(len(ids)))
    for _ in range(rounds):
        moved = False
        for node in range(len(ids)):
            votes: dict[int, float] = {}
            for other in near[first[node] : first[node + 1]]:
                votes[label[other]] = votes.get(label[other], 0.0) + weight[other]
            best, most = label[node], -1.0
            for name in sorted(votes):
                if votes[name] > most + EQUAL:
                    best, most = name, votes[name]
            if best != label[node]:
                label[node], moved = best, True
        if not moved:
            break
    return ids, ids[label]


def _passed(edges: DataFrame, marks: DataFrame, rounds: int) -> DataFrame:
    """id, community of the nodes of edges (src, dst), as labels() gives them, by joins of the whole edge table; marks: id, degree, weight.

    What a node takes depends on what smaller neighbours take in this round and on what larger ones took in the last. So a round begins with
    the last one's labels, and all nodes vote at once, again and again, until no vote changes: as a node's label follows from those of smaller
    ones, there is only one such end, and it is that of voting one after another. It takes as many joins as labels go through steps that matter,
    mostly some ten; a chain of nodes in the order of ids takes one for each. Edges are packed by the end that gives the label, hubs in several rows.
    Of up to TOLD nodes the labels are broadcast instead, and no edge is sent: see _told().
    """
    if marks.count() <= TOLD:
        return _told(edges, marks, rounds)
    tied = edges.select(F.col("src").alias("other"), F.col("dst").alias("node")).unionByName(edges.select(F.col("dst").alias("other"), F.col("src").alias("node")))
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / PACKED)).alias("_chunk")
    near = saved(tied.join(marks.withColumnRenamed("id", "other"), "other").groupBy("other", "weight", chunk).agg(F.collect_list("node").alias("nodes")).drop("_chunk"))
    state = saved(marks.select("id", F.col("id").alias("last"), F.col("id").alias("label")))
    most = F.max("votes").over(Window.partitionBy("node"))
    for _ in range(rounds):
        moved = True
        while moved:
            told = near.join(state.withColumnRenamed("id", "other"), "other").select("other", "weight", "last", "label", F.explode("nodes").alias("node"))
            told = told.select("node", F.when(F.col("other") < F.col("node"), F.col("label")).otherwise(F.col("last")).alias("named"), "weight").repartition("node")
            votes = told.groupBy("node", "named").agg(F.sum("weight").alias("votes")).withColumn("_most", most)
            taken = votes.where(F.col("votes") >= F.col("_most") - EQUAL).groupBy(F.col("node").alias("id")).agg(F.min("named").alias("named"))
            state = saved(state.join(taken, "id").select("id", "last", F.col("named").alias("label"), (F.col("named") != F.col("label")).alias("_moved")))
            moved = not state.where("_moved").isEmpty()
            state = state.drop("_moved")
        if state.where("label <> last").isEmpty():
            break
        state = state.select("id", F.col("label").alias("last"), "label")
    return state.select("id", F.col("label").alias("community"))


def _told(edges: DataFrame, marks: DataFrame, rounds: int) -> DataFrame:
    """As _passed(), for nodes whose labels fit into every task. Nodes are numbered in the order of ids; each has its neighbours in a row, a
    hub in several, and the rows stay where they are: a round of votes sends each node's choice, and what there is of a hub's votes."""
    spark = edges.sparkSession
    placed = saved(marks.select("id", "weight", "degree").sort("id").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(row.part), F.lit(before)]
        before += row.n
    numbered = saved(placed.select("id", "weight", "degree", (F.create_map(*offsets)[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int").alias("i")))
    of = lambda end, *more: F.broadcast(numbered.select(F.col("id").alias(end), F.col("i").alias(f"_{end}"), *more))
    both = edges.join(of("src", F.col("degree").alias("_one")), "src").join(of("dst", F.col("degree").alias("_two")), "dst")
    tied = both.select(F.col("_src").alias("node"), F.col("_dst").alias("other"), F.col("_one").alias("degree")).unionByName(both.select(F.col("_dst").alias("node"), F.col("_src").alias("other"), F.col("_two").alias("degree")))
    parts = F.ceil(F.col("degree") / PACKED)
    near = saved(tied.groupBy("node", parts.alias("parts"), F.pmod(F.xxhash64("other"), parts).alias("_chunk")).agg(F.collect_list("other").alias("others")).drop("_chunk"))
    weights = numbered.select("i", "weight").toArrow()
    weight = np.empty(before)
    weight[weights["i"].to_numpy()] = weights["weight"].to_numpy()
    label = last = np.arange(before, dtype=np.int32)
    most = F.max("votes").over(Window.partitionBy("node"))
    for _ in range(rounds):
        moved = True
        while moved:
            known = spark.sparkContext.broadcast((label, last, weight))
            votes = near.mapInArrow(_counting(known), "node int, named int, votes double").groupBy("node", "named").agg(F.sum("votes").alias("votes")).withColumn("_most", most)
            taken = votes.where(F.col("votes") >= F.col("_most") - EQUAL).groupBy("node").agg(F.min("named").alias("named")).toArrow()
            known.destroy()
            now = label.copy()
            now[taken["node"].to_numpy()] = taken["named"].to_numpy()
            moved, label = bool((now != label).any()), now
        if (label == last).all():
            break
        last = label
    found = spark.createDataFrame(pa.table({"i": np.arange(before, dtype=np.int32), "_named": label}))
    return numbered.select("id", "i").join(found, "i").join(numbered.select(F.col("i").alias("_named"), F.col("id").alias("community")), "_named").select("id", "community")


def _counting(known):
    """For rows (node, parts, others): node, named, votes of the label that most of them give, the least of equal ones; all labels of a row that is one of several."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, last, weight = known.value
        for batch in batches:
            ends = np.cumsum(batch.column("others").value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, side="right")))
                rows = batch.slice(at, to - at)
                at = to
                node, several = rows.column("node").to_numpy(), rows.column("parts").to_numpy() > 1
                row = np.repeat(np.arange(len(node)), rows.column("others").value_lengths().to_numpy())
                other = rows.column("others").flatten().to_numpy()
                named = np.where(other < node[row], label[other], last[other])
                order = np.lexsort((other, named, row))
                row, named = row[order], named[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (named[1:] != named[:-1])))
                votes, row, named = np.add.reduceat(weight[other[order]], first), row[first], named[first]
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                best = votes >= np.maximum.reduceat(votes, begin)[row] - EQUAL
                best = np.flatnonzero(best)
                best = best[np.append(True, row[best][1:] != row[best][:-1])]  # names rise within a row
                keep = several[row]
                keep[best] = True
                yield pa.RecordBatch.from_arrays([pa.array(node[row[keep]]), pa.array(named[keep]), pa.array(votes[keep])], names=["node", "named", "votes"])

    return count


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, grouped: int = GROUPED) -> DataFrame:
    """root, id, community of each node (id): community is the node whose label it has at the end, root the least node of its component.

    Nodes take labels one after another, so a component is one group, packed as arrays of its edges; components run beside each other. One of
    more than `grouped` edges is no group: see _passed(). A node without edges is by itself.
    """
    proper = edges.where("src <> dst").select("src", "dst")
    kind = nodes.schema["id"].dataType.simpleString()
    roots = components(proper.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    crowded = hubs(nodes, edges).select("id", F.lit(True).alias("_hub"))
    degree = proper.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    placed = degree.join(roots.withColumnRenamed("node", "id"), "id").join(crowded, "id", "left").withColumn("_hub", F.coalesce("_hub", F.lit(False)))
    placed = saved(placed)
    sizes = placed.groupBy("root").agg((F.sum("degree") > 2 * grouped).alias("_large"))
    marks = saved(placed.join(sizes, "root"))
    small, large = marks.where("NOT _large"), marks.where("_large")
    of = lambda end, *more: small.select(F.col("id").alias(end), *more)
    marked = proper.join(of("src", "root", "_hub"), "src").join(of("dst", F.col("_hub").alias("_hub2")), "dst")

    def group(table: pa.Table) -> pa.Table:
        src, dst, one, two = (table[c].to_numpy(zero_copy_only=False) for c in ("src", "dst", "_hub", "_hub2"))
        # In the order of ids, so that sums of votes come out the same however rows arrive.
        order = np.lexsort((dst, src))
        hub = set(src[one == True]) | set(dst[two == True])  # noqa: E712
        ids, found = labels(src[order], dst[order], hub, rounds)
        return pa.table({"root": pa.array(np.full(len(ids), table["root"][0].as_py()), table["root"].type), "id": pa.array(ids, table["src"].type), "community": pa.array(found, table["src"].type)})

    made = marked.select("root", "src", "dst", "_hub", "_hub2").groupBy("root").applyInArrow(group, f"root {kind}, id {kind}, community {kind}")
    if not large.isEmpty():
        weight = F.when(F.col("_hub"), HUB_VOTE).otherwise(1.0) / F.sqrt("degree")
        passed = _passed(proper.join(large.select(F.col("id").alias("src")), "src", "left_semi"), large.select("id", "degree", weight.alias("weight")), rounds)
        others = large.select("root", "id").join(passed, "id")
        made = others if small.isEmpty() else made.unionByName(others)
    return nodes.select("id").join(made, "id", "left").select(F.coalesce("root", "id").alias("root"), "id", F.coalesce("community", "id").alias("community"))


def contracted(sizes: dict, ties: dict[object, dict], least: int = LEAST) -> dict:
    """Where each community goes: from the smallest on, one below `least` joins the one it has most edges to, the larger and then the first
    of equal ones; sizes grow on the way."""
    into: dict = {}

    def now(x):
        while x in into:
            x = into[x]
        return x

    for own in sorted(sizes, key=lambda c: (sizes[c], c)):
        if own in into or sizes[own] >= least:
            continue
        open_ = [(-n, -sizes[now(c)], now(c)) for c, n in ties.get(own, {}).items() if now(c) != own]
        if open_:
            target = min(open_)[2]
            into[own], sizes[target], sizes[own] = target, sizes[target] + sizes[own], 0
    return {c: now(c) for c in sizes}


def merged(found: DataFrame, edges: DataFrame, least: int = LEAST) -> DataFrame:
    """communities() with small ones merged into those they are tied to most; only a component of fewer members than `least` stays smaller.

    A component's communities and the numbers of edges between them, summed first, are one group: an order-dependent contraction.
    """
    of = lambda end: found.select(F.col("id").alias(end), F.col("community").alias(f"_{end}"))
    sizes = found.groupBy("root", "community").agg(F.count("*").alias("n"))
    tied = edges.join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst").select(F.least("_src", "_dst").alias("a"), F.greatest("_src", "_dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("ties"))
    rows = sizes.select("root", F.col("community").alias("a"), F.lit(None).cast(found.schema["community"].dataType).alias("b"), "n").unionByName(
        tied.join(sizes.select(F.col("community").alias("a"), "root"), "a").select("root", "a", "b", F.col("ties").alias("n"))
    )
    kind = found.schema["community"].dataType.simpleString()

    def group(table: pa.Table) -> pa.Table:
        counts: dict = {}
        ties: dict = {}
        for a, b, n in zip(*(table[c].to_pylist() for c in ("a", "b", "n"))):
            if b is None:
                counts[a] = n
            else:
                ties.setdefault(a, {})[b] = n
                ties.setdefault(b, {})[a] = n
        out = contracted(counts, ties, least)
        return pa.table({"community": pa.array(list(out), table["a"].type), "_into": pa.array(list(out.values()), table["a"].type)})

    moves = rows.groupBy("root").applyInArrow(group, f"community {kind}, _into {kind}")
    return found.join(moves, "community").select("root", "id", F.col("_into").alias("community"))


def core(nodes: DataFrame, edges: DataFrame, ambient: DataFrame) -> DataFrame:
    """id, reach of the nodes (id, area) that tie areas together: those with neighbours in two other areas at least, hubs (ambient: id)
    aside, the ten that reach most areas. None for graphs under 16 nodes or 3 areas, for fewer than two such nodes, or if fewer than 3 areas
    would keep a node of their own."""
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("area").alias(f"_{end}"))
    placed = edges.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst")
    sides = placed.select(F.col("src").alias("id"), F.col("_dst").alias("far")).unionByName(placed.select(F.col("dst").alias("id"), F.col("_src").alias("far"))).distinct()
    reach = sides.groupBy("id").agg(F.count("*").alias("reach")).where("reach >= 2").join(ambient.select("id"), "id", "left_anti")
    few, many = CORE_MEMBERS
    chosen = reach.orderBy(F.desc("reach"), "id").limit(many)
    kept = nodes.join(chosen.select("id", F.lit(True).alias("_core")), "id", "left").where("_core IS NULL").agg(F.count_distinct("area").alias("kept"))
    whole = nodes.agg(F.count("*").alias("n"), F.count_distinct("area").alias("areas")).crossJoin(kept).crossJoin(chosen.agg(F.count("*").alias("members")))  # one row each
    fits = whole.where((F.col("n") >= CORE_NODES) & (F.col("areas") >= CORE_AREAS) & (F.col("members") >= few) & (F.col("kept") >= CORE_AREAS)).select(F.lit(True).alias("_fits"))
    return chosen.crossJoin(F.broadcast(fits)).select("id", "reach")


def breadth_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """root, id, level, nth: the order in which a search goes outwards from each component's node with most edges (the first of equal
    ones): by level, then by the neighbour that a node was first reached from, then most edges first. nth counts within a level.

    One join for each level: a node's way is the least of its neighbours' ways, and itself; ways of one level are compared as arrays.
    Nodes without edges are levels of their own.
    """
    proper = edges.where("src <> dst").select("src", "dst")
    degree = degrees(nodes, proper)
    both = saved(proper.unionByName(proper.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    roots = components(proper.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    key = F.struct((-F.col("degree")).alias("d"), F.col("id").alias("id"))
    placed = saved(degree.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")).withColumn("key", key))
    first = placed.groupBy(F.col("root").alias("_c")).agg(F.min("key").alias("key")).select("_c", F.col("key.id").alias("root"), "key")
    frontier = saved(first.select("root", F.col("root").alias("id"), F.lit(0).alias("level"), F.array("key").alias("way")))
    levels, recent = [frontier], frontier.select("id")
    while True:
        near = frontier.select("root", F.col("id").alias("src"), "level", "way").join(both, "src").select("root", F.col("dst").alias("id"), (F.col("level") + 1).alias("level"), "way")
        fresh = near.join(recent, "id", "left_anti").groupBy("id").agg(F.min("root").alias("root"), F.min("level").alias("level"), F.min("way").alias("way"))
        # Only the last two levels can meet the next; each is written once and they are put together at the end.
        frontier = saved(fresh.join(placed.select("id", "key"), "id").select("root", "id", "level", F.concat("way", F.array("key")).alias("way")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        recent = levels[-2].select("id").unionByName(frontier.select("id"))
    return reduce(DataFrame.unionByName, levels).select("root", "id", "level", F.row_number().over(Window.partitionBy("root", "level").orderBy("way")).alias("nth"))
