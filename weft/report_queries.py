"""Queries of what readers ask of graphs, flows, endpoints and data models, over graphs that the tables make, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import fields, ids, paths
from weft.operators import areas, flow, graph, interfaces, layers, modules, reports, schema
from weft.session import use_checkpoints
from weft.sources.files import ALL, scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes: id, kind (a tenth external), label, scope (the brand)."""
    kind = F.when(F.col("p_partkey") % 10 == 0, "external").when(F.col("p_size") % 3 == 0, "service").otherwise("module")
    return table(spark, sf_dir, "part").select(_text("p_partkey").alias("id"), kind.alias("kind"), F.concat_ws(" ", "p_name", _text("p_partkey")).alias("label"), F.col("p_brand").alias("scope"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of parts to the parts that their suppliers stand for, as sure as the supplier's number tells."""
    lines = table(spark, sf_dir, "lineitem")
    sure = F.when(F.col("l_suppkey") % 3 == 0, "exact").when(F.col("l_suppkey") % 3 == 1, "inferred").otherwise("unresolved")
    return lines.select(_text("l_partkey").alias("src"), (F.col("l_suppkey") * 7).cast("string").alias("dst"), sure.alias("confidence"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("id"), F.col("s_name").alias("label"), _text("s_nationkey").alias("scope"))


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"parts": _nodes(spark, sf_dir), "suppliers": _suppliers(spark, sf_dir), "again": _suppliers(spark, sf_dir).withColumn("scope", F.lit("x"))}


def focus_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.focus(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("id", "degree")


def focus_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.focus(_nodes(spark, sf_dir), _edges(spark, sf_dir), "21").select("id", "degree")


def focus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.focus_counts(_edges(spark, sf_dir), "7")


def relations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.relations_of(_nodes(spark, sf_dir), _edges(spark, sf_dir), "7").groupBy("direction", "far", "label").agg(F.count("*").alias("n"))


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frame_pairs(_edges(spark, sf_dir), _nodes(spark, sf_dir).select("id", F.col("scope").alias("frame")))


def legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.legend(_nodes(spark, sf_dir), 2)


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.suggestions(_nodes(spark, sf_dir)).select("id", "label")


def suggestions_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.suggestions(_nodes(spark, sf_dir), "Ring 1").select("id", "label")


def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search(_nodes(spark, sf_dir), "SMALL R", "label", "kind").select("id")


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "nation").select(F.lit("N").alias("code"), F.col("n_name").alias("message"))
    return reports.review(_nodes(spark, sf_dir), _edges(spark, sf_dir).distinct(), told)


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lookup(_views(spark, sf_dir), "s3")


def hand_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hand_off(_views(spark, sf_dir), "s3")


def module_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules are sizes of parts below brands, half of them in a container."""
    top = F.when(F.col("p_size") % 2 == 0, "packages/").otherwise("")
    name = F.concat(top, F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), _text("p_size"))
    return reports.module_groups(table(spark, sf_dir, "part").groupBy(name.alias("module")).agg(F.count("*").alias("files")))


def uses_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.uses_areas(_nodes(spark, sf_dir).withColumnRenamed("scope", "area"), 24)


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "warning").otherwise("info").alias("severity"))
    scopes = {"parts": (_nodes(spark, sf_dir), _edges(spark, sf_dir)), "suppliers": (_suppliers(spark, sf_dir), _edges(spark, sf_dir).limit(0))}
    return reports.scope_counts(scopes, told)


def _url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("path"))


def apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of URLs by the shortest end that no other has."""
    return reports.apart(_url_paths(spark, sf_dir).select(F.regexp_replace("path", "/[^/]*$", "").alias("area")), rounds=3)


def folder_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("n_chars").cast("string").substr(1, 1), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"))
    return reports.folder_languages(docs)


def language_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of each folder's files, whose extensions go by the number of the page."""
    names = F.element_at(F.array(*map(F.lit, "ts kt h yml md scss svg ps1 zzz".split())), (F.col("page_id") % 9 + 1).cast("int"))
    files = _url_paths(spark, sf_dir).select(F.concat("path", F.lit("."), names).alias("path"))
    return reports.folder_languages(files.select("path", modules.bucket(F.col("path")).alias("language")))


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.node_ids(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("path"), F.col("p_brand").alias("module"))).distinct()


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("area"), F.when(F.col("p_size") % 5 < 2, "collection").when(F.col("p_size") % 5 == 2, "embedded").otherwise("table").alias("kind"))


def nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.nouns(_entities(spark, sf_dir))


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields (customers' orders) and relations (orders to statuses) of a data model: entities are customers, variants their segments."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("variant")), "o_custkey")
    entity, field = F.concat(F.lit("C"), _text("o_custkey")).alias("entity"), _text("o_orderkey").alias("field")
    own = orders.select("variant", entity, field, (F.col("o_orderkey") % 4 == 0).alias("pk"))
    linked = orders.where("o_orderkey % 3 = 0").select("variant", entity, field, F.concat(F.lit("C"), (F.col("o_custkey") + 5).cast("string")).alias("target"))
    return own, linked


def key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_columns(*_model(spark, sf_dir))


def largest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest_entities(*_model(spark, sf_dir))


def schemaless(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, "mongoose:a prisma:b django:c beanie:d mongoose:e".split())), (F.col("c_custkey") % 5 + 1).cast("int"))
    return reports.schemaless(table(spark, sf_dir, "customer").select(names.alias("variant")))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("s"), _text("l_suppkey"))).alias("package"), _text("l_partkey").alias("path"))
    return reports.dependencies(lines)


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("protocol"), F.concat(F.lit("/o/"), _text("o_orderkey")).alias("address"), F.col("o_orderstatus").alias("operation"), _text("o_custkey").alias("file"), F.col("o_orderstatus").alias("framework"), F.lit(3).cast("long").alias("hidden")
    )


def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frameworks(_endpoints(spark, sf_dir)).withColumn("frameworks", F.concat_ws(",", "frameworks"))


def endpoint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.endpoint_rows(_endpoints(spark, sf_dir)).select("protocol", "address", "hidden")


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints and ports that hold a query."""
    ports = table(spark, sf_dir, "supplier").select(F.lit("tcp").alias("protocol"), (F.col("s_suppkey") + 8000).cast("int").alias("port"), F.lit("expose").alias("kind"), F.col("s_name").alias("note"), F.lit("f").alias("file"))
    return reports.board(_endpoints(spark, sf_dir), ports, "/O/12").select("board", "protocol", "what", "file")


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows of orders: lines are nodes, decisions by their flag; a line leads to the next one of its order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    unit, node = _text("l_orderkey").alias("unit"), lambda n: F.concat_ws("-", _text("l_orderkey"), n.cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "decision").when(F.col("l_linenumber") == 1, "start").otherwise("step")
    nodes = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    made = nodes.select(unit, node(F.col("l_linenumber")).alias("id"), kind.alias("kind"), F.lit("").alias("label"), F.col("l_linenumber").alias("line"))
    ahead = nodes.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"))
    edges = nodes.join(ahead, ["l_orderkey", "l_linenumber"]).select(unit, node(F.col("l_linenumber")).alias("src"), node(F.col("l_linenumber") + 1).alias("dst"), F.lit("call").alias("kind"), F.lit("").alias("label"))
    return made, edges


def recommended_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recommended_flow(*_flows(spark, sf_dir)).select("unit", "nodes", "branches", "edges")


def flow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.units(*_flows(spark, sf_dir)).select("unit", "routes", "steps", "branches", "edges", "score")


def flow_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the flows begin and end."""
    return flow.degrees_of_flow(*_flows(spark, sf_dir))


def project_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir)[0].select("label", "modules", "files", F.concat_ws(",", "examples").alias("examples"))


def project_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(spark, sf_dir)[1]


def _project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as modules below their regions: more than are shown one by one."""
    nation = table(spark, sf_dir, "nation")
    name = lambda key, region: F.concat(F.lit("src/r"), region.cast("string"), F.lit("/n"), key.cast("string"))
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("files"))
    placed = nation.join(sizes, "n_nationkey").select(name(F.col("n_nationkey"), F.col("n_regionkey")).alias("module"), "files")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a")), "o_custkey")
    drawn = orders.groupBy("a", ((F.col("a") * 3 + F.col("o_orderkey") % 4) % 25).cast("int").alias("b")).agg(F.count("*").alias("n")).where("a <> b")
    of = lambda end: nation.select(F.col("n_nationkey").alias(end), name(F.col("n_nationkey"), F.col("n_regionkey")).alias("src" if end == "a" else "dst"))
    return flow.project_flow(placed, drawn.join(of("a"), "a").join(of("b"), "b").select("src", "dst", "n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a file table: roles by size, imports and lines by numbers."""
    size, key = F.col("p_size"), F.col("p_partkey")
    role = F.when(size % 5 == 0, "test").when(size % 5 == 1, "entry").otherwise("source")
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.when(role == "test", "test_").otherwise(""), F.lit("f"), (key % 97).cast("string"), F.lit("_"), F.lpad(key.cast("string"), 8, "0"), F.lit(".py"))
    stem = F.when(role == "test", F.concat(F.lit("a/test_f"), (key % 50).cast("string"), F.lit(".py"))).otherwise(path)
    return table(spark, sf_dir, "part").select(stem.alias("path"), role.alias("role"), (key % 31).alias("imports"), (key * 7 % 23).alias("imported_by"), (key * 13 % 1009).alias("lines")).dropDuplicates(["path"])


def _listed(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table_ = _files(spark, sf_dir)
        if name == "untested":
            table_ = table_.where("role <> 'source'").unionByName(table(spark, sf_dir, "part").where("p_size % 5 > 1").select(F.concat(F.lit("f"), (F.col("p_partkey") % 97).cast("string"), F.lit(".py")).alias("path"), F.lit("source").alias("role"), F.lit(0).cast("long").alias("imports"), F.lit(0).cast("long").alias("imported_by"), (F.col("p_partkey") % 97 * 3).alias("lines")).distinct())
        return modules.reports(table_.withColumn("lines", F.when(F.col("role") == "test", F.lit(1).cast("long")).otherwise(F.col("lines"))))[name].select("path", "lines")

    query.__name__ = f"files_{name}"
    query.__doc__ = f"The list `{name}` of a file table that parts stand for."
    return query


def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the tree of URLs, folders before files."""
    files = _url_paths(spark, sf_dir).groupBy("path").agg(F.count("*").alias("size"))
    return areas.tree_rows(areas.tree(files), limit=500).select("path", "kind", F.col("depth").cast("long").alias("depth"), "left_out")


def tree_rows_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _url_paths(spark, sf_dir).groupBy("path").agg(F.count("*").alias("size"))
    return areas.tree_rows(areas.tree(files), "/FR/", limit=100_000_000).select("path", "kind")


def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _url_paths(spark, sf_dir)
    globs = {"deep": ["**/fr/**"], "one": ["*/fr/*"], "either": ["**/{fr,en}/?[0-9]"], "none": ["a["], "not": ["**/[!1-5]?*"]}
    return urls.select("page_id", *(paths.matches(F.col("path"), g).alias(name) for name, g in globs.items()))


def http_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", interfaces.http_path(F.concat(F.lit("^/"), F.col("n_name"), F.lit("//")), F.concat(F.lit("/x/"), _text("n_regionkey"), F.lit("/$"))).alias("address"), interfaces.http_path(F.lit(""), F.lit("/")).alias("top"))


def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as fields of a data model, written as text and read again."""
    key = F.col("s_suppkey")
    given = table(spark, sf_dir, "supplier").select("s_suppkey", fields.field_text(F.col("s_name"), F.when(key % 2 == 0, F.lower("s_name")), F.when(key % 5 != 0, F.concat(F.lit("decimal("), _text("s_nationkey"), F.lit(",2)"))), key % 3 == 0, key % 4 == 0, F.when(key % 7 < 3, key % 7 == 0), key % 11 == 0, key % 13 == 0, key % 2 == 1).alias("text"))
    back = fields.parsed_field(F.col("text"))
    return given.select("s_suppkey", "text", back["name"].alias("name"), back["stored"].alias("stored"), back["type"].alias("type"), *(back[c].alias(c) for c in ("pk", "uniq", "nullable", "generated", "related", "inferred")))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.col("p_name"), F.lit(" & ("), F.col("p_brand"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_name", "p_brand", fields.file_name(title).alias("file"), fields.anchor(title).alias("anchor"), fields.mermaid(title).alias("mermaid"), ids.slug(title).alias("slug"), ids.base36(ids.fnv1a(title)).alias("hash")).distinct()


def folded_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of URLs with fewer than four pages, folded into their parents."""
    groups = _url_paths(spark, sf_dir).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("area")).agg(F.count("*").alias("n"))
    return areas.fold_small(groups)


def ranks_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far regions, nations, customers and their orders are from where ways begin; every eighth order comes straight from a region."""
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("c"), F.concat(F.lit("n"), _text("c_nationkey")).alias("n"))
    orders = table(spark, sf_dir, "orders")
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), _text("n_regionkey")).alias("src"), F.concat(F.lit("n"), _text("n_nationkey")).alias("dst"))
    edges = nation.unionByName(customer.select(F.col("n").alias("src"), F.col("c").alias("dst"))).unionByName(orders.select(F.concat(F.lit("c"), _text("o_custkey")).alias("src"), F.concat(F.lit("o"), _text("o_orderkey")).alias("dst")))
    edges = edges.unionByName(orders.where("o_orderkey % 8 = 0").select(F.lit("r1").alias("src"), F.concat(F.lit("o"), _text("o_orderkey")).alias("dst")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.longest_path_ranks(nodes, edges).select("id", F.col("rank").cast("long").alias("rank"))


def resolved_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of parts to suppliers' names, some missing and some ambiguous, in a variant for each brand."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    none = F.lit(None).cast("string")
    entities = supplier.select(F.lit("v").alias("variant"), name(F.col("s_suppkey") % 60).alias("entity"), F.lit("table").alias("kind"), F.concat(F.lit("own.t"), _text("s_suppkey")).alias("physical"), none.alias("alias"), _text("s_suppkey").alias("file"), F.lit(1).alias("line"))
    entities = entities.withColumn("id", F.concat(F.lit("id"), F.col("file")))
    wanted = F.when(F.col("p_size") % 3 == 0, name(F.col("p_size") % 60)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("OWN.T"), _text("p_size"))).otherwise(F.concat(F.lit("t"), _text("p_size")))
    relations = part.select(F.lit("v").alias("variant"), _text("p_partkey").alias("entity"), F.lit("f").alias("file"), F.lit(1).alias("line"), _text("p_partkey").alias("field"), wanted.alias("target"), F.lit("one").alias("kind"), none.alias("name"), F.lit(True).alias("owning"))
    return schema.resolve(entities, relations).select("field", "target", "target_id", "confidence", "state")


def arranged_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations, market segments and order priorities as layers, in an order with few crossings and on level places."""
    nation, customer, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    rows = rows.select(F.col("n_regionkey").alias("component"), F.col("n_name").alias("a"), F.col("c_mktsegment").alias("b"), F.col("o_orderpriority").alias("c"))
    layer = lambda name, n: rows.groupBy("component", F.col(name).alias("id")).agg(F.count("*").alias("n")).select("component", F.lit(n).alias("layer"), "id", F.log10(F.col("n") + 1.0).alias("height"))
    nodes = layer("a", 0).unionByName(layer("b", 1)).unionByName(layer("c", 2))
    edges = rows.selectExpr("component", "a AS src", "b AS dst").unionByName(rows.selectExpr("component", "b AS src", "c AS dst")).distinct()
    return layers.arranged(nodes, edges)


def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, roles and languages of files of nine shapes, below folders of which every other one is a project."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    names = ["src/index.ts", "src/deep/er/main.go", "tests/x{}.py", "x{}.spec.ts", "x{}_test.go", "vite.config.js", "x{}.py", "readme{}.md", "conf{}.yaml"]
    shape = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9 + 1).cast("int"))
    part = table(spark, sf_dir, "part")
    files = part.select(F.concat(F.lit("a"), size, F.lit("/"), F.replace(shape, F.lit("{}"), key)).alias("path")).unionByName(part.where("p_size % 2 = 0").select(F.concat(F.lit("a"), size, F.lit("/package.json")).alias("path")))
    files = files.distinct().select("path", F.lit("x").alias("content"), F.lit(1).cast("long").alias("size"))
    none = spark.createDataFrame([], "path string, specifier string, line int, targets array<string>")
    return modules.file_table(none, files).select("path", "module", "role", "language")


def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON files, a folder for each nation, and scanned again without one of the folders."""
    use_checkpoints(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/scanned-{uuid.uuid4().hex}"
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("k"))
    customer.repartition(4, "k").write.partitionBy("k").json(root)
    found, _ = scan(spark, {"customers": root}, exclude=["k=7/**"], max_files=ALL, max_kb=10_240)
    lines = found.select(F.regexp_extract("path", r"^k=(\d+)/", 1).cast("long").alias("k"), F.explode(F.split("content", "\n")).alias("line"))
    return lines.where("line <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        focus_node, focus_preferred, focus_counts, relations_of, frame_pairs, legend, suggestions, suggestions_of_query, search_names, review, lookup, hand_off, module_groups, uses_areas, scope_counts, apart, folder_languages,
        language_buckets, node_ids, nouns, key_columns, largest_entities, schemaless, dependencies, frameworks, endpoint_rows, board, recommended_flow, flow_scores, flow_ends, project_flow_nodes, project_flow_edges,
        *map(_listed, ("entry_points", "load_bearing", "largest", "unreferenced", "untested")), tree_rows, tree_rows_of_query, glob_matches, http_paths, field_texts, titles, folded_areas, ranks_of_paths, resolved_relations, arranged_layers,
        file_roles, scan_folder,
    )
}

_NODES = "(SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 10 = 0 THEN 'external' WHEN p_size % 3 = 0 THEN 'service' ELSE 'module' END AS kind, p_name || ' ' || p_partkey AS label, p_brand AS scope FROM part)"
_EDGES = "(SELECT l_partkey::VARCHAR AS src, (l_suppkey * 7)::VARCHAR AS dst, CASE l_suppkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS confidence FROM lineitem)"
_DEGREES = f"(SELECT e AS id, count(*) AS degree FROM (SELECT src AS e FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES} WHERE src <> dst) GROUP BY 1)"
_URLS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages)"
_MODEL = """m AS (SELECT c_mktsegment AS variant, 'C' || o_custkey AS entity, o_orderkey::VARCHAR AS field, o_orderkey % 4 = 0 AS pk, o_orderkey % 3 = 0 AS linked, 'C' || (o_custkey + 5) AS target FROM orders JOIN customer ON o_custkey = c_custkey)"""
_FLOWS = """n AS (SELECT l_orderkey AS u, l_linenumber AS i, CASE WHEN min(l_returnflag) = 'R' THEN 'decision' WHEN l_linenumber = 1 THEN 'start' ELSE 'step' END AS kind FROM lineitem GROUP BY 1, 2),
    e AS (SELECT a.u, a.i AS src, b.i AS dst FROM n a JOIN n b ON a.u = b.u AND b.i = a.i + 1),
    k AS (SELECT n.u, count(*) AS nodes, count(*) FILTER (kind = 'start') AS routes, count(*) FILTER (kind = 'step') AS steps, count(*) FILTER (kind = 'decision') AS branches, any_value(coalesce(c, 0)) AS edges
          FROM n LEFT JOIN (SELECT u, count(*) AS c FROM e GROUP BY 1) x ON x.u = n.u GROUP BY 1)"""
_PROJECT = """o AS (SELECT c_nationkey AS a, (c_nationkey * 3 + o_orderkey % 4) % 25 AS b FROM orders JOIN customer ON o_custkey = c_custkey), d AS (SELECT DISTINCT a, b FROM o WHERE a <> b)"""
_FILES = """f AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'a/test_f' || (p_partkey % 50) || '.py' ELSE replace(p_brand, '#', '') || '/f' || (p_partkey % 97) || '_' || lpad(p_partkey::VARCHAR, 8, '0') || '.py' END AS path,
    CASE p_size % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'entry' ELSE 'source' END AS role, p_partkey % 31 AS imports, p_partkey * 7 % 23 AS imported_by, p_partkey * 13 % 1009 AS lines FROM part)"""
_TREE = f"""u AS (SELECT DISTINCT path FROM {_URLS}), v AS (SELECT path, string_split(path, '/') AS s FROM u),
    r AS (SELECT array_to_string(list_slice(s, 1, d), '/') AS path, 'folder' AS kind, d AS depth FROM (SELECT DISTINCT list_slice(s, 1, d) AS s, d FROM (SELECT s, unnest(range(1, len(s))) AS d FROM v)) UNION ALL SELECT path, 'file', len(s) FROM v)"""

ORACLES = {
    "file_roles": """
        WITH x AS (SELECT DISTINCT p_size AS b, p_partkey % 9 AS i, CASE WHEN p_partkey % 9 IN (0, 1, 5) THEN '' ELSE p_partkey::VARCHAR END AS k FROM part)
        SELECT 'a' || b || '/' || replace(['src/index.ts', 'src/deep/er/main.go', 'tests/x{}.py', 'x{}.spec.ts', 'x{}_test.go', 'vite.config.js', 'x{}.py', 'readme{}.md', 'conf{}.yaml'][i + 1], '{}', k) AS path,
               CASE WHEN i < 7 THEN 'a' || b || CASE WHEN b % 2 = 0 AND i < 3 THEN ['/src', '/src/deep', '/tests'][i + 1] ELSE '' END END AS module,
               CASE WHEN i = 0 AND b % 2 = 0 THEN 'entry' ELSE ['source', 'source', 'test', 'test', 'test', 'config', 'source', 'other', 'config'][i + 1] END AS role,
               ['TypeScript', 'Go', 'Python', 'TypeScript', 'Go', 'JavaScript', 'Python', 'Other', 'Other'][i + 1] AS language FROM x
        UNION ALL SELECT DISTINCT 'a' || p_size || '/package.json', NULL, 'config', 'Other' FROM part WHERE p_size % 2 = 0""",
    "scan_folder": """SELECT c_nationkey::BIGINT AS k, '{"c":' || c_custkey || ',"s":"' || c_mktsegment || '"}' AS line FROM customer WHERE c_nationkey <> 7""",
    "focus_node": f"SELECT n.id, coalesce(degree, 0) AS degree FROM {_NODES} n LEFT JOIN {_DEGREES} d ON d.id = n.id WHERE kind <> 'external' ORDER BY degree DESC NULLS LAST, label, n.id LIMIT 1",
    "focus_preferred": f"SELECT n.id, coalesce(degree, 0) AS degree FROM {_NODES} n LEFT JOIN {_DEGREES} d ON d.id = n.id WHERE n.id = '21'",
    "focus_counts": f"SELECT count(*) FILTER (dst = '7') AS arriving, count(*) FILTER (src = '7') AS leaving FROM {_EDGES} WHERE src <> dst",
    "relations_of": f"""
        WITH x AS (SELECT 'out' AS direction, dst AS far FROM {_EDGES} WHERE src = '7' UNION ALL SELECT 'in', src FROM {_EDGES} WHERE dst = '7' AND src <> '7')
        SELECT direction, far, label, count(*) AS n FROM x LEFT JOIN {_NODES} n ON n.id = far GROUP BY 1, 2, 3""",
    "frame_pairs": f"SELECT least(a.scope, b.scope) AS a, greatest(a.scope, b.scope) AS b, count(*) AS n FROM {_EDGES} e JOIN {_NODES} a ON a.id = src JOIN {_NODES} b ON b.id = dst WHERE a.scope <> b.scope GROUP BY 1, 2",
    "legend": f"SELECT kind AS name, count(*) AS n FROM {_NODES} GROUP BY 1 ORDER BY n DESC, name LIMIT 2",
    "suggestions": f"SELECT id, label FROM {_NODES} WHERE kind <> 'external' ORDER BY label, id LIMIT 8",
    "suggestions_of_query": f"SELECT id, label FROM {_NODES} WHERE contains(lower(label), 'ring 1') ORDER BY label, id LIMIT 8",
    "search_names": f"SELECT id FROM {_NODES} WHERE contains(lower(label || ' ' || kind), 'small r')",
    "review": f"""
        WITH x AS (SELECT 'diagnostics' AS section, 'N ' || n_name AS item FROM nation UNION ALL SELECT 'links', confidence || ' ' || src || ' ' || dst FROM (SELECT DISTINCT * FROM {_EDGES}) WHERE confidence <> 'exact'
                   UNION ALL SELECT 'isolated', label FROM {_NODES} WHERE kind <> 'external' AND id NOT IN (SELECT src FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}))
        SELECT section, item, greatest(n - 20, 0) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY item) AS nth, count(*) OVER (PARTITION BY section) AS n FROM x) WHERE nth <= 20""",
    "lookup": "SELECT 'suppliers' AS view, 's3' AS id, s_name AS label FROM supplier WHERE s_suppkey = 3",
    "hand_off": "SELECT 'suppliers' AS view, 's3' AS id, s_name AS label, s_nationkey::VARCHAR AS scope FROM supplier WHERE s_suppkey = 3",
    "module_groups": """
        WITH m AS (SELECT p_size % 2 = 0 AS inner_, replace(p_brand, '#', '') AS b, p_size, count(*) AS files FROM part GROUP BY 1, 2, 3)
        SELECT CASE WHEN inner_ THEN 'packages/' ELSE '' END || b AS area, count(*) AS modules, CAST(sum(files) AS BIGINT) AS files FROM m GROUP BY 1""",
    "uses_areas": "SELECT count(*) > 24 AND count(DISTINCT p_brand) >= 2 AS uses_areas FROM part",
    "scope_counts": f"""
        SELECT 'parts' AS scope, (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS warnings
        UNION ALL SELECT 'suppliers', (SELECT count(*) FROM supplier), 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')""",
    "apart": f"""
        WITH a AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS area FROM {_URLS}), s AS (SELECT area, string_split(area, '/') AS p FROM a),
        e AS (SELECT area, n, array_to_string(list_slice(p, len(p) - n + 1, len(p)), '/') AS label FROM (SELECT area, p, unnest(range(1, least(len(p), 3) + 1)) AS n FROM s)),
        u AS (SELECT label, any_value(area) AS area, any_value(n) AS n FROM e GROUP BY 1 HAVING count(*) = 1), b AS (SELECT area, arg_min(label, n) AS label FROM u GROUP BY 1)
        SELECT area, coalesce(label, area) AS label FROM a LEFT JOIN b USING (area)""",
    "folder_languages": """
        WITH f AS (SELECT source AS s, left(n_chars::VARCHAR, 1) AS c, lang FROM documents), x AS (SELECT s AS folder, lang FROM f UNION ALL SELECT s || '/' || c, lang FROM f)
        SELECT folder, lang AS language FROM (SELECT folder, lang, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, lang) AS nth FROM x GROUP BY 1, 2) WHERE nth = 1""",
    "language_buckets": f"""
        WITH f AS (SELECT string_split(path, '/') AS p, ['ts', 'jvm', 'native', 'config', 'docs', 'style', 'asset', 'shell', 'other'][page_id % 9 + 1] AS lang FROM {_URLS}),
        x AS (SELECT array_to_string(list_slice(p, 1, d), '/') AS folder, lang FROM (SELECT p, lang, unnest(range(1, len(p))) AS d FROM f))
        SELECT folder, lang AS language FROM (SELECT folder, lang, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, lang) AS nth FROM x GROUP BY 1, 2) WHERE nth = 1""",
    "node_ids": "SELECT DISTINCT p_brand || '/' || p_name AS path, 'module:' || replace(p_brand, '#', '%23') AS module_id, 'file:' || replace(p_brand, '#', '%23') || '%2F' || replace(p_name, ' ', '%20') AS tree_id FROM part",
    "nouns": "SELECT p_brand AS area, CASE WHEN count(*) FILTER (p_size % 5 <= 2) > count(*) FILTER (p_size % 5 > 2) THEN 'collection' ELSE 'table' END AS noun FROM part GROUP BY 1",
    "key_columns": f"WITH {_MODEL} SELECT DISTINCT variant, entity, field FROM m WHERE pk OR linked",
    "largest_entities": f"""
        WITH {_MODEL}, f AS (SELECT variant, entity, count(*) AS fields FROM m GROUP BY 1, 2), r AS (SELECT variant, e AS entity, count(*) AS relations FROM (SELECT variant, entity AS e FROM m WHERE linked UNION ALL SELECT variant, target FROM m WHERE linked) GROUP BY 1, 2)
        SELECT variant, entity, fields, coalesce(relations, 0) AS relations FROM f LEFT JOIN r USING (variant, entity) ORDER BY relations DESC, fields DESC, entity, variant LIMIT 12""",
    "schemaless": "SELECT CASE c_custkey % 5 WHEN 3 THEN 'beanie' ELSE 'mongoose' END AS source, count(*) AS entities FROM customer WHERE c_custkey % 5 IN (0, 3, 4) GROUP BY 1",
    "dependencies": "SELECT 's' || l_suppkey AS package, count(*) AS n, count(DISTINCT l_partkey) AS files FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1 ORDER BY n DESC, package LIMIT 12",
    "frameworks": "SELECT o_orderpriority AS protocol, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS frameworks FROM orders GROUP BY 1",
    "endpoint_rows": """
        SELECT protocol, address, greatest(n - 60, 0) + 3 AS hidden FROM (SELECT o_orderpriority AS protocol, '/o/' || o_orderkey AS address, row_number() OVER (PARTITION BY o_orderpriority ORDER BY '/o/' || o_orderkey) AS nth, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE nth <= 60""",
    "board": """
        SELECT 'endpoints' AS board, o_orderpriority AS protocol, o_orderstatus || ' /o/' || o_orderkey AS what, o_custkey::VARCHAR AS file FROM orders WHERE contains(o_orderpriority || ' ' || o_orderstatus || ' /o/' || o_orderkey || ' ' || o_custkey, '/o/12')""",
    "recommended_flow": f"WITH {_FLOWS} SELECT u::VARCHAR AS unit, nodes, branches, edges FROM k ORDER BY edges > 0 AND nodes <= 20 DESC, CASE WHEN edges > 0 AND nodes <= 20 THEN branches END DESC NULLS LAST, edges DESC, nodes, unit LIMIT 1",
    "flow_scores": f"WITH {_FLOWS} SELECT u::VARCHAR AS unit, routes, steps, branches, edges, 12 * routes + 3 * edges + steps AS score FROM k ORDER BY score DESC, unit LIMIT 180",
    "flow_ends": f"""
        WITH {_FLOWS}, p AS (SELECT n.u, n.i, kind, EXISTS (SELECT 1 FROM e WHERE e.u = n.u AND e.dst = n.i) AS arrives, EXISTS (SELECT 1 FROM e WHERE e.u = n.u AND e.src = n.i) AS leaves FROM n)
        SELECT u::VARCHAR AS unit, u || '-' || i AS id, 'start' AS position FROM p WHERE kind = 'start' OR (NOT arrives AND leaves) UNION ALL SELECT u::VARCHAR, u || '-' || i, 'end' FROM p WHERE kind <> 'decision' AND arrives AND NOT leaves""",
    "project_flow_nodes": """
        WITH m AS (SELECT 'src/r' || n_regionkey AS label, 'src/r' || n_regionkey || '/n' || n_nationkey AS module, count(*) AS files FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
        SELECT label, count(*) AS modules, CAST(sum(files) AS BIGINT) AS files, array_to_string(list_slice(list_sort(list(module)), 1, 5), ',') AS examples FROM m GROUP BY 1""",
    "project_flow_edges": f"WITH {_PROJECT} SELECT 'src/r' || x.n_regionkey AS src, 'src/r' || y.n_regionkey AS dst, count(*) AS n FROM d JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey <> y.n_regionkey GROUP BY 1, 2",
    "files_entry_points": f"WITH {_FILES} SELECT path, lines FROM f WHERE role = 'entry' ORDER BY imports DESC, path LIMIT 8",
    "files_load_bearing": f"WITH {_FILES} SELECT path, lines FROM f WHERE imported_by > 0 AND role <> 'test' ORDER BY imported_by DESC, path LIMIT 8",
    "files_largest": f"WITH {_FILES} SELECT path, lines FROM f WHERE role <> 'test' ORDER BY lines DESC, path LIMIT 8",
    "files_unreferenced": f"WITH {_FILES} SELECT path, lines FROM f WHERE role = 'source' AND imported_by = 0 ORDER BY imports, lines DESC, path LIMIT 8",
    "files_untested": """
        SELECT DISTINCT 'f' || (p_partkey % 97) || '.py' AS path, p_partkey % 97 * 3 AS lines FROM part WHERE p_size % 5 > 1 AND p_partkey % 97 NOT IN (SELECT p_partkey % 50 FROM part WHERE p_size % 5 = 0) ORDER BY lines DESC, path LIMIT 8""",
    "tree_rows": f"""
        WITH {_TREE}, o AS (SELECT path, kind, depth, list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: CASE WHEN i = len(string_split(path, '/')) AND kind = 'file' THEN '1' ELSE '0' END || string_split(path, '/')[i]) AS place FROM r)
        SELECT path, kind, CAST(depth AS BIGINT) AS depth, greatest((SELECT count(*) FROM r) - 500, 0) AS left_out FROM o ORDER BY place LIMIT 500""",
    "tree_rows_of_query": f"""
        WITH {_TREE}, h AS (SELECT path FROM r WHERE kind = 'file' AND contains(lower(path), '/fr/'))
        SELECT path, kind FROM r WHERE (kind = 'file' AND path IN (SELECT path FROM h)) OR (kind = 'folder' AND EXISTS (SELECT 1 FROM h WHERE starts_with(h.path, r.path || '/')))""",
    "glob_matches": rf"""
        SELECT page_id, regexp_full_match(path, '(.*/)?fr/.*') AS deep, regexp_full_match(path, '[^/]*/fr/[^/]*') AS one, regexp_full_match(path, '(.*/)?(fr|en)/[^/][0-9]') AS either, false AS "none", regexp_full_match(path, '([^/]+/)*[^/1-5][^/][^/]*') AS "not" FROM {_URLS}""",
    "http_paths": "SELECT n_nationkey, '/' || n_name || '/x/' || n_regionkey AS address, '/' AS top FROM nation",
    "field_texts": """
        WITH s AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) END AS stored, CASE WHEN s_suppkey % 5 <> 0 THEN 'decimal(' || s_nationkey || ',2)' END AS type,
                          list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'PK' END, CASE WHEN s_suppkey % 4 = 0 THEN 'UNIQUE' END, CASE WHEN s_suppkey % 11 = 0 THEN 'GENERATED' END, CASE WHEN s_suppkey % 7 IN (1, 2) THEN 'NOT NULL' END,
                                       CASE WHEN s_suppkey % 7 = 0 THEN 'NULL' END, CASE WHEN s_suppkey % 13 = 0 THEN 'RELATION' END, CASE WHEN s_suppkey % 2 = 1 THEN 'INFERRED' END], lambda x: x IS NOT NULL) AS f FROM supplier)
        SELECT k AS s_suppkey, s_name || coalesce(' -> ' || stored, '') || coalesce(': ' || type, '') || CASE WHEN len(f) > 0 THEN ' [' || array_to_string(f, ', ') || ']' ELSE '' END AS text, s_name AS name, coalesce(stored, s_name) AS stored, type,
               k % 3 = 0 AS pk, k % 4 = 0 AS uniq, CASE WHEN k % 7 < 3 THEN k % 7 = 0 END AS nullable, k % 11 = 0 AS generated, k % 13 = 0 AS related, k % 2 = 1 AS inferred FROM s""",
    "titles": """
        SELECT DISTINCT p_name, p_brand, replace(p_name, ' ', '-') || '-' || replace(lower(p_brand), '#', '-') || '.md' AS file, replace(p_name, ' ', '-') || '--' || replace(lower(p_brand), '#', '') AS anchor,
               replace(p_name, ' ', '_') || '____' || replace(p_brand, '#', '_') || '_' AS mermaid, replace(p_name, ' ', '-') || '-' || replace(lower(p_brand), '#', '-') AS slug,
               lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(1, length(t) + 1), lambda i: CAST(unicode(t[i]) AS UBIGINT))), lambda a, c: xor(a, c) * 16777619 % 4294967296)::BIGINT, 36)) AS hash
        FROM (SELECT *, p_name || ' & (' || p_brand || ')' AS t FROM part)""",
    "ranks_of_paths": """
        SELECT DISTINCT 'r' || n_regionkey AS id, 0::BIGINT AS rank FROM nation UNION SELECT 'r1', 0 UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders""",
    "resolved_relations": """
        WITH e AS (SELECT s_suppkey AS k, 's' || (s_suppkey % 60) AS n FROM supplier), a AS (SELECT n AS alias, count(*) AS n, min('id' || k) AS id FROM e GROUP BY 1 UNION ALL SELECT 'own.t' || k, 1, 'id' || k FROM e UNION ALL SELECT 't' || k, 1, 'id' || k FROM e),
        p AS (SELECT p_partkey::VARCHAR AS field, CASE p_size % 3 WHEN 0 THEN 'S' || (p_size % 60) WHEN 1 THEN 'OWN.T' || p_size ELSE 't' || p_size END AS target FROM part)
        SELECT field, target, CASE WHEN a.n = 1 THEN id END AS target_id, CASE WHEN a.n = 1 THEN 'exact' ELSE 'unresolved' END AS confidence, CASE WHEN a.n = 1 THEN 'resolved' WHEN a.n > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM p LEFT JOIN a ON alias = lower(target)""",
}
