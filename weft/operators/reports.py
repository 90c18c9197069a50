"""Ranked lists, look-ups and counters over a workspace's tables: what a reader asks of graphs, flows, endpoints and data models.

nodes are (id, kind, label, ...), edges (src, dst, ...). All lists are cut by order, so Spark keeps no more than their length.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.functions import ids
from weft.operators import graph, ranking


def hotspots(edges: DataFrame, limit: int = 12) -> DataFrame:
    """id, arriving, leaving: the nodes with the greatest weights (n) of edges to and from others."""
    zero = F.lit(0).cast("long")
    proper = edges.where("src <> dst")
    out = proper.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("leaving")).withColumn("arriving", zero)
    into = proper.groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("arriving")).withColumn("leaving", zero)
    total = out.unionByName(into).groupBy("id").agg(F.sum("arriving").alias("arriving"), F.sum("leaving").alias("leaving"))
    return total.orderBy(F.desc(F.col("arriving") + F.col("leaving")), "id").limit(limit)


def dependencies(imports: DataFrame, limit: int = 12) -> DataFrame:
    """package, n, files: the external packages that are imported most."""
    used = imports.where("package IS NOT NULL")
    return used.groupBy("package").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")).orderBy(F.desc("n"), "package").limit(limit)


def largest_entities(fields: DataFrame, relations: DataFrame, limit: int = 12) -> DataFrame:
    """variant, entity, fields, relations: the entities that most relations lead from or to, then those with most fields."""
    counts = fields.groupBy("variant", "entity").agg(F.count("*").alias("fields"))
    ends = relations.select("variant", F.explode(F.array_distinct(F.array("entity", "target"))).alias("entity")).groupBy("variant", "entity").agg(F.count("*").alias("relations"))
    both = counts.join(ends, ["variant", "entity"], "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    return both.orderBy(F.desc("relations"), F.desc("fields"), "entity", "variant").limit(limit)


def frameworks(endpoints: DataFrame) -> DataFrame:
    """protocol, frameworks: the different ones of each protocol, in order."""
    return endpoints.groupBy("protocol").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))


def nouns(entities: DataFrame, by: str = "area") -> DataFrame:
    """by, noun: whether most of a group's entities are collections or tables; tables if as many."""
    more = F.count_if(F.col("kind").isin("collection", "embedded")) > F.count_if(~F.col("kind").isin("collection", "embedded"))
    return entities.groupBy(by).agg(F.when(more, "collection").otherwise("table").alias("noun"))


# Libraries whose models the database doesn't enforce.
SCHEMALESS = "mongoose typegoose mongoengine beanie spring-data".split()


def schemaless(entities: DataFrame) -> DataFrame:
    """source, entities: the libraries among those of the entities' variants whose declarations a database doesn't enforce."""
    source = F.split("variant", ":")[0]
    return entities.where(source.isin(*SCHEMALESS)).groupBy(source.alias("source")).agg(F.count("*").alias("entities"))


def board(endpoints: DataFrame, ports: DataFrame, query: str = "") -> DataFrame:
    """board, protocol, what, file: the rows of the boards of endpoints and ports that hold a query, all of them without one."""
    what = F.concat_ws(" ", "operation", "address")
    one = endpoints.select(F.lit("endpoints").alias("board"), "protocol", what.alias("what"), "file")
    two = ports.select(F.lit("ports").alias("board"), "protocol", F.concat_ws(" ", "kind", F.col("port").cast("string"), "note").alias("what"), "file")
    both = one.unionByName(two)
    return search(both, query, "protocol", "what", "file") if query else both


def key_columns(fields: DataFrame, relations: DataFrame) -> DataFrame:
    """variant, entity, field: primary keys, and the fields that relations go out from."""
    keys = fields.where("pk").select("variant", "entity", "field")
    return keys.unionByName(relations.select("variant", "entity", "field")).distinct()


def frame_pairs(edges: DataFrame, frames: DataFrame) -> DataFrame:
    """a, b, n: edges between two different frames of frames (id, frame), whatever their direction."""
    of = lambda end: frames.select(F.col("id").alias(f"_{end}"), F.col("frame").alias(end))
    placed = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).join(of("src"), "_src").join(of("dst"), "_dst")
    return graph.undirected_pairs(placed.select("src", "dst"))


def focus_counts(edges: DataFrame, focus: str) -> DataFrame:
    """One row: edges that arrive at a node and that leave it, loops aside."""
    proper = edges.where(F.col("src") != F.col("dst"))
    return proper.agg(F.count_if(F.col("dst") == focus).alias("arriving"), F.count_if(F.col("src") == focus).alias("leaving"))


def module_groups(modules: DataFrame) -> DataFrame:
    """area, modules, files of modules (module, files), by area, those with most files first."""
    area = graph.area_of_path(F.col("module"))
    return modules.groupBy(area.alias("area")).agg(F.count("*").alias("modules"), F.sum("files").alias("files")).orderBy(F.desc("files"), "area")


def scope_counts(scopes: dict[str, tuple[DataFrame, DataFrame]], diagnostics: DataFrame) -> DataFrame:
    """scope, nodes, edges of each named pair of tables, and warnings of all."""
    rows = []
    for name, (nodes, edges) in scopes.items():
        both = nodes.select(F.lit(1).alias("node"), F.lit(0).alias("edge")).unionAll(edges.select(F.lit(0), F.lit(1)))
        rows.append(both.agg(F.coalesce(F.sum("node"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edge"), F.lit(0)).alias("edges")).select(F.lit(name).alias("scope"), "nodes", "edges"))
    warned = diagnostics.agg(F.count_if(F.col("severity") == "warning").alias("warnings"))
    return reduce(DataFrame.unionByName, rows).crossJoin(F.broadcast(warned))  # a row for each scope, times one


def review(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame, limit: int = 20) -> DataFrame:
    """section, item, hidden: the first of the diagnostics, the uncertain links and the isolated nodes, and how many more each has."""
    told = diagnostics.select(F.lit("diagnostics").alias("section"), F.concat_ws(" ", "code", "message").alias("item"))
    unsure = edges.where("confidence <> 'exact'").select(F.lit("links").alias("section"), F.concat_ws(" ", "confidence", "src", "dst").alias("item"))
    alone = graph.isolated(nodes, edges).select(F.lit("isolated").alias("section"), F.col("label").alias("item"))
    return ranking.top_with_hidden(told.unionByName(unsure).unionByName(alone), ["section"], [F.col("item")], limit).drop("rank")


def focus(nodes: DataFrame, edges: DataFrame, preferred: str | None = None) -> DataFrame:
    """One node: the preferred one if it is there, else of those that aren't external the one of highest degree, by label."""
    ranked = nodes.join(graph.degrees(nodes, edges), "id")
    own = F.col("id") == F.lit(preferred) if preferred is not None else F.lit(False)
    return ranked.where(own | (F.col("kind") != "external")).orderBy(F.desc(own), F.desc("degree"), "label", "id").limit(1)


def recommended_flow(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """One unit: with edges and at most so many nodes, most branches, most edges, fewest nodes; if there is none, the one with most edges."""
    counts = nodes.groupBy("unit").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "decision").alias("branches"))
    drawn = counts.join(edges.groupBy("unit").agg(F.count("*").alias("edges")), "unit", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    fits = (F.col("edges") > 0) & (F.col("nodes") <= most)
    return drawn.orderBy(F.desc(fits), F.desc(F.when(fits, F.col("branches"))), F.desc("edges"), "nodes", "unit").limit(1)


@F.pandas_udf(StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def normal(value: Column) -> Column:
    """Text as it is searched: compatibility composed and in lower case. Spark composes plain ASCII for free: it is left as it is."""
    return F.lower(F.when(value.rlike(r"\A\p{ASCII}*\z"), value).otherwise(_composed(value)))


def search(frame: DataFrame, query: str, *columns: str) -> DataFrame:
    """The rows whose columns, one after another, hold the query."""
    import unicodedata

    wanted = unicodedata.normalize("NFKC", query).lower()
    return frame.where(F.contains(normal(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))), F.lit(wanted)))


def suggestions(nodes: DataFrame, query: str = "", limit: int = 8) -> DataFrame:
    """The first nodes by label that hold the query; external ones only if there is a query."""
    found = search(nodes, query, "label") if query else nodes.where("kind <> 'external'")
    return found.orderBy("label", "id").limit(limit)


def legend(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """name, n: the kinds of nodes, the most frequent first."""
    return nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def endpoint_rows(endpoints: DataFrame, limit: int = 60) -> DataFrame:
    """The first endpoints of each protocol by address, with how many more the protocol has, those hidden before included."""
    cut = ranking.top_with_hidden(endpoints.withColumnRenamed("hidden", "_before"), ["protocol"], [F.col("address"), F.col("operation"), F.col("file")], limit)
    return cut.withColumn("hidden", F.col("hidden") + F.col("_before")).drop("_before", "rank")


def lookup(views: dict[str, DataFrame], wanted: str) -> DataFrame:
    """view, id, label: the first view that has a node of that id, in the order given."""
    rows = [frame.where(F.col("id") == wanted).select(F.lit(n).alias("_order"), F.lit(name).alias("view"), "id", "label") for n, (name, frame) in enumerate(views.items())]
    return reduce(DataFrame.unionByName, rows).orderBy("_order", "label").limit(1).drop("_order")


def hand_off(views: dict[str, DataFrame], wanted: str) -> DataFrame:
    """view, id, label, scope: as lookup(), with the area or unit that the view shows the node in; views have `scope`."""
    rows = [frame.where(F.col("id") == wanted).select(F.lit(n).alias("_order"), F.lit(name).alias("view"), "id", "label", "scope") for n, (name, frame) in enumerate(views.items())]
    return reduce(DataFrame.unionByName, rows).orderBy("_order", "scope").limit(1).drop("_order")


def relations_of(nodes: DataFrame, edges: DataFrame, wanted: str) -> DataFrame:
    """direction, far, label, of each edge of a node, with the label of its other end; a loop is there once, as going out."""
    out = edges.where(F.col("src") == wanted).select(F.lit("out").alias("direction"), F.col("dst").alias("far"))
    into = edges.where((F.col("dst") == wanted) & (F.col("src") != wanted)).select(F.lit("in").alias("direction"), F.col("src").alias("far"))
    return out.unionByName(into).join(nodes.select(F.col("id").alias("far"), "label"), "far", "left").select("direction", "far", "label")


def flow_unit(units: DataFrame, wanted: str | None = None) -> DataFrame:
    """The unit of that name, else the first."""
    own = F.col("unit") == F.lit(wanted) if wanted is not None else F.lit(False)
    return units.orderBy(F.desc(own), "unit").limit(1)


def node_ids(files: DataFrame) -> DataFrame:
    """path, module_id, tree_id: the ids by which views know a file, of a table (path, module)."""
    return files.select("path", ids.node_id("module", F.col("module")).alias("module_id"), ids.node_id("file", F.col("path")).alias("tree_id"))


def uses_areas(nodes: DataFrame, more_than: int) -> DataFrame:
    """One row, uses_areas: whether a view of nodes (area) is shown by areas: it has more than so many nodes, and two areas."""
    return nodes.agg(((F.count("*") > more_than) & (F.count_distinct("area") >= 2)).alias("uses_areas"))


def apart(areas: DataFrame, rounds: int = 8) -> DataFrame:
    """area, label: the shortest end of each path that no other of the areas (area: paths) has, of at most `rounds` parts.

    Every area offers its ends of all lengths, equal ones are counted, and each takes its shortest unique one.
    """
    paths = areas.select("area").distinct()
    parts = F.split("area", "/")
    longest = F.least(F.size(parts), F.lit(rounds))
    ends = paths.select("area", F.posexplode(F.transform(F.sequence(F.lit(1), longest), lambda n: F.concat_ws("/", F.slice(parts, F.size(parts) - n + 1, n)))).alias("length", "label"))
    unique = ends.groupBy("label").agg(F.count("*").alias("n"), F.min("area").alias("area"), F.min("length").alias("length")).where("n = 1")
    best = unique.groupBy("area").agg(F.min_by("label", "length").alias("label"))
    return paths.join(best, "area", "left").select("area", F.coalesce("label", "area").alias("label"))


def folder_languages(files: DataFrame) -> DataFrame:
    """folder, language: the most common language of the files (path, language) below each folder; of equal ones the first by name."""
    from weft.operators.rollup import ancestors

    counts = files.select(F.explode(ancestors(F.col("path"))).alias("folder"), "language").groupBy("folder", "language").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_nth", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n"), "language")))
    return ranked.where("_nth = 1").select("folder", "language")
