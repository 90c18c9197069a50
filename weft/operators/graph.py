"""Property graphs as two tables, nodes (id, ...) and edges (src, dst, ...): degrees, health, neighbourhoods, areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import ranking
from weft.session import saved


def rank(confidence: Column) -> Column:
    return F.when(confidence == "exact", 2).when(confidence == "inferred", 1).otherwise(0)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree: a loop counts once, every other edge once at each end; nodes without edges have 0."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, least: int = 12, share: float = 0.22) -> DataFrame:
    """id, degree of nodes with at least max(least, share of all nodes) edges to others."""
    proper = degrees(nodes, edges.where("src <> dst"))
    limit = F.broadcast(nodes.agg(F.greatest(F.lit(float(least)), F.count("*") * share).alias("_limit")))
    return proper.join(limit, proper.degree >= limit._limit).select("id", "degree")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches, external ones aside."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # before they are sorted for the join
    return nodes.where("kind <> 'external'").join(ends, "id", "left_anti")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: inferred and unresolved edges, isolated nodes."""
    counts = edges.agg(F.count_if(F.col("confidence") == "inferred").alias("inferred"), F.count_if(F.col("confidence") == "unresolved").alias("unresolved"))
    return counts.crossJoin(isolated(nodes, edges).agg(F.count("*").alias("isolated")))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """a, b, n: edges between two different ends, whatever their direction."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, focus: Column | str, limit: int = 4) -> DataFrame:
    """side, id, confidence, hidden: the neighbours of a node on each side by their strongest edge, loops aside."""
    focus = F.lit(focus) if isinstance(focus, str) else focus
    out = edges.where((F.col("src") == focus) & (F.col("dst") != focus)).select(F.lit("out").alias("side"), F.col("dst").alias("id"), "confidence")
    into = edges.where((F.col("dst") == focus) & (F.col("src") != focus)).select(F.lit("in").alias("side"), F.col("src").alias("id"), "confidence")
    best = out.unionByName(into).groupBy("side", "id").agg(F.max_by("confidence", rank(F.col("confidence"))).alias("confidence"))
    return ranking.top_with_hidden(best, ["side"], [F.desc(rank(F.col("confidence"))), F.col("id")], limit).select("side", "id", "confidence", "hidden")


def weakest(edges: DataFrame, by: list[str]) -> DataFrame:
    """by, n, confidence: parallel edges folded into one, as sure as the least sure of them."""
    return edges.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("confidence", rank(F.col("confidence"))).alias("confidence"))


def crossings(edges: DataFrame) -> DataFrame:
    """column, n: pairs of edges (column, top, bottom) of one column that cross, that is, whose ends are in opposite order.

    Parallel edges are folded first; pairs are counted by running sums over sorted positions, not by meeting.
    """
    a = edges.groupBy("column", "top", "bottom").agg(F.count("*").alias("m"))
    # Two tops differ first at one bit of their ranks: within what is equal above it, the edges with the bit that end at smaller
    # bottoms cross those without it. So each bit takes one running sum over the bottoms of a group of tops.
    ranks = a.select("column", "top").distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy("column").orderBy("top")))
    bits = int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length()
    levels = a.join(ranks, ["column", "top"]).select("column", "bottom", "m", "rank", F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1)))).alias("level"))
    high = F.expr("(rank >> level) & 1")
    sums = levels.groupBy("column", "level", F.expr("rank >> (level + 1)").alias("group"), "bottom").agg(F.sum(F.col("m") * high).alias("ones"), F.sum(F.col("m") * (1 - high)).alias("zeros"))
    before = Window.partitionBy("column", "level", "group").orderBy("bottom").rowsBetween(Window.unboundedPreceding, -1)
    counted = sums.withColumn("n", F.col("zeros") * F.coalesce(F.sum("ones").over(before), F.lit(0))).groupBy("column").agg(F.sum("n").alias("n"))
    return counted.where("n > 0")


def area_of_path(path: Column, containers: tuple[str, ...] = ("apps", "packages", "services", "libs")) -> Column:
    """The area of a module path: its first segment, or its first two below a container folder."""
    parts = F.split(path, "/")
    two = F.lower(parts[0]).isin(*containers) & (F.size(parts) > 1)
    return F.when(two, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(parts[0])


def path_areas(nodes: DataFrame, path: str, containers: tuple[str, ...] = ("apps", "packages", "services", "libs")) -> DataFrame:
    """nodes with `area` by their path; if all would lie in one area, their first two segments tell them apart."""
    one, two = area_of_path(F.col(path), containers), F.concat_ws("/", F.slice(F.split(F.col(path), "/"), 1, 2))
    found = F.broadcast(nodes.agg(F.count_distinct(one).alias("_areas")))  # one row
    return nodes.crossJoin(found).withColumn("area", F.when(F.col("_areas") < 2, two).otherwise(one)).drop("_areas")


def areas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """area, members, internal, crossing, neighbours of nodes (id, area): each crossing edge counts for both its areas."""
    of = nodes.select("id", "area")
    placed = edges.join(of.withColumnsRenamed({"id": "src", "area": "a"}), "src").join(of.withColumnsRenamed({"id": "dst", "area": "b"}), "dst").select("a", "b")
    sides = placed.select(F.explode(F.array_distinct(F.array(F.struct(F.col("a").alias("area"), F.col("b").alias("far")), F.struct(F.col("b").alias("area"), F.col("a").alias("far"))))).alias("s")).select("s.*")
    links = sides.groupBy("area").agg(
        F.count_if(F.col("area") == F.col("far")).alias("internal"),
        F.count_if(F.col("area") != F.col("far")).alias("crossing"),
        F.array_sort(F.collect_set(F.when(F.col("area") != F.col("far"), F.col("far")))).alias("neighbours"),
    )
    counts = of.groupBy("area").agg(F.count("*").alias("members"))
    zero = F.lit(0).cast("long")
    return counts.join(links, "area", "left").select(
        "area", "members", F.coalesce("internal", zero).alias("internal"), F.coalesce("crossing", zero).alias("crossing"), F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours")
    )


def boundary(nodes: DataFrame, edges: DataFrame, area: str) -> DataFrame:
    """node, far_area, direction, n, labels, confidence: what lies outside an area folded to one row for each
    inside node, outside area and direction; as sure as its least sure edge."""
    of = nodes.select("id", "area", "label")
    placed = edges.join(of.withColumnsRenamed({"id": "src", "area": "a", "label": "src_label"}), "src").join(of.withColumnsRenamed({"id": "dst", "area": "b", "label": "dst_label"}), "dst")
    out = placed.where((F.col("a") == area) & (F.col("b") != area)).select(F.col("src").alias("node"), F.col("b").alias("far_area"), F.lit("out").alias("direction"), F.col("dst_label").alias("far"), "confidence")
    into = placed.where((F.col("b") == area) & (F.col("a") != area)).select(F.col("dst").alias("node"), F.col("a").alias("far_area"), F.lit("in").alias("direction"), F.col("src_label").alias("far"), "confidence")
    return out.unionByName(into).groupBy("node", "far_area", "direction").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("far")).alias("labels"), F.min_by("confidence", rank(F.col("confidence"))).alias("confidence")
    )


def longest_path_ranks(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, rank: the longest path to each node of a graph without cycles (loops aside), by relaxing all edges in rounds."""
    current = saved(nodes.select("id", F.lit(0).alias("rank")))
    for _ in range(rounds):
        raised = edges.where("src <> dst").join(current.withColumnsRenamed({"id": "src", "rank": "from"}), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("from") + 1).alias("up"))
        after = saved(current.join(raised, "id", "left").select("id", F.greatest("rank", F.coalesce("up", F.lit(0))).alias("rank"), (F.col("up") > F.col("rank")).alias("_moved")))
        moved = after.where("_moved").isEmpty()
        current = after.select("id", "rank")
        if moved:
            return current
    raise ValueError("the graph has a cycle, or a path longer than the rounds given")
