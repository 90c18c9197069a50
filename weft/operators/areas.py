"""Areas of a data model: groups of entities by path, small ones folded into their parents, large ones split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths
from weft.operators import graph
from weft.operators.reports import frame_pairs, nouns
from weft.operators.rollup import ancestors
from weft.session import saved

#: Groups with fewer members are folded, groups with more are split or called oversized.
SMALL, LARGE = 4, 30


def fold_small(groups: DataFrame, least: int = SMALL, fewest: int = 2) -> DataFrame:
    """area, folded of groups (area: a path, n): a group below `least` joins its parent path, from the deepest level up.

    A group that has grown to `least` on the way stays. A level is left as it is if folding it would leave fewer than
    `fewest` groups. One round for each level of folders, over one row for each group.
    """
    current = saved(groups.groupBy("area").agg(F.sum("n").alias("n")).select("area", F.col("area").alias("folded"), "n"))
    depth = current.agg(F.max(F.size(F.split("area", "/")))).first()[0] or 0
    for level in range(depth, 1, -1):
        sizes = current.groupBy("folded").agg(F.sum("n").alias("_size"))
        small = sizes.where((F.size(F.split("folded", "/")) == level) & (F.col("_size") < least)).select("folded", paths.dirname(F.col("folded")).alias("_up"))
        moved = saved(current.join(small, "folded", "left").select("area", F.coalesce("_up", "folded").alias("folded"), "n"))
        if moved.select("folded").distinct().limit(fewest).count() >= fewest:
            current = moved
    return current.select("area", "folded")


def subject_areas(entities: DataFrame, large: int = LARGE) -> DataFrame:
    """entities with `area` and `oversized`: their schema's folder, folded; an area over `large` is split by the first
    part of its entities' names if all have one and at least two differ."""
    placed = entities.withColumn("_path", F.regexp_replace("file", "/[^/]*\\z", ""))
    folded = fold_small(placed.groupBy(F.col("_path").alias("area")).agg(F.count("*").alias("n")))
    placed = placed.join(folded.select(F.col("area").alias("_path"), F.col("folded").alias("area")), "_path").drop("_path")
    space = F.when(F.col("entity").contains("."), F.split("entity", "\\.")[0])
    sizes = placed.groupBy("area").agg(F.count("*").alias("_n"), F.count_if(space.isNull()).alias("_bare"), F.count_distinct(space).alias("_spaces"))
    split = (F.col("_n") > large) & (F.col("_bare") == 0) & (F.col("_spaces") >= 2)
    named = placed.join(sizes, "area").withColumn("area", F.when(split, F.concat_ws(":", "area", space)).otherwise(F.col("area"))).drop("_n", "_bare", "_spaces")
    after = named.groupBy("area").agg((F.count("*") > large).alias("oversized"))
    return named.join(after, "area")


def area_summary(placed: DataFrame, relations: DataFrame) -> DataFrame:
    """area, members, noun, internal, crossing, neighbours, unresolved, oversized of subject_areas(); each crossing relation counts
    for both its areas."""
    edges = relations.where("target_id IS NOT NULL AND source_id IS NOT NULL").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    counts = graph.areas(placed.select("id", "area"), edges)
    missing = relations.where("target_id IS NULL").join(placed.select(F.col("id").alias("source_id"), "area"), "source_id").groupBy("area").agg(F.count("*").alias("unresolved"))
    large = placed.groupBy("area").agg(F.max("oversized").alias("oversized"))
    named = counts.join(nouns(placed), "area").join(missing, "area", "left").join(large, "area")
    return named.select("area", "members", "noun", "internal", "crossing", "neighbours", F.coalesce("unresolved", F.lit(0)).alias("unresolved"), "oversized")


def area_links(placed: DataFrame, relations: DataFrame) -> DataFrame:
    """a, b, n: relations between two areas, whatever their direction."""
    edges = relations.where("target_id IS NOT NULL").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return frame_pairs(edges, placed.select("id", F.col("area").alias("frame")))


def area_boundary(placed: DataFrame, relations: DataFrame, area: str) -> DataFrame:
    """What the entities of an area have to do with other areas, folded by node, far area and direction; see graph.boundary()."""
    edges = relations.where("target_id IS NOT NULL").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "confidence")
    return graph.boundary(placed.select("id", "area", F.col("entity").alias("label")), edges, area)


def tree(files: DataFrame) -> DataFrame:
    """path, parent, depth, kind, files, bytes of every folder and file; a file's own count is null, not 0."""
    folders = files.select(F.explode(ancestors(F.col("path"))).alias("path"), "size").groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("kind", F.lit("folder"))
    leaves = files.select("path", F.lit(None).cast("long").alias("files"), F.col("size").alias("bytes"), F.lit("file").alias("kind"))
    both = folders.unionByName(leaves)
    return both.select("path", paths.dirname(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), "kind", "files", "bytes")


def tree_rows(rows: DataFrame, query: str = "", limit: int = 6000) -> DataFrame:
    """The rows of a tree in the order in which it is drawn, folders before files; with a query, matching files and the
    folders above them. `left_out` tells how many rows the limit cuts."""
    if query:
        hits = rows.where((F.col("kind") == "file") & F.lower("path").contains(query.lower())).select("path")
        keep = hits.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
        rows = rows.join(keep, "path", "left_semi")
    # A folder sorts before its files at each level: every part but a file's own is marked as a folder's.
    parts = F.split("path", "/")
    order = F.transform(parts, lambda x, i: F.concat(F.when((i + 1 == F.size(parts)) & (F.col("kind") == "file"), "1").otherwise("0"), x))
    total = rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("left_out"))
    return rows.orderBy(order).limit(limit).crossJoin(F.broadcast(total))

