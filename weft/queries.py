"""Queries over the relational tables, one for each operator, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids, paths, text
from weft import language_queries, report_queries, source_queries
from weft.operators import asof, communities, components, cycles, graph, modules, ranking, reports, rollup
from weft.streaming import changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _deliveries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """imports and files of a workspace of deliveries: each line is an import of its supplier's file by its part's file."""
    name = lambda folder, key, tail: F.concat(folder, F.lit("/"), F.col(key).cast("string"), F.lit(tail))
    part = table(spark, sf_dir, "part").select("p_partkey", name(F.replace("p_brand", F.lit("#"), F.lit("")), "p_partkey", ".ts").alias("path"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", name(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")), "s_suppkey", ".go").alias("target"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    placed = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    imports = placed.select("path", F.col("l_suppkey").cast("string").alias("specifier"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.array("target").alias("targets"))
    files = part.select("path").unionByName(supplier.select(F.col("target").alias("path"))).select("path", F.lit("").alias("content"), F.lit(0).cast("long").alias("size"))
    return imports, files


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand to nation edges with their weight, the first five sources, and the first line of the first source."""
    return modules.module_edges(*_deliveries(spark, sf_dir)).withColumn("sources", F.concat_ws(",", "sources"))


def external_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as packages that the parts' files use, with each brand's own first use."""
    part = table(spark, sf_dir, "part")
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(".ts"))
    used = part.select(path.alias("path"), F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("package"), F.lit(1).cast("long").alias("line"))
    return modules.external_uses(used, used.select("path", F.lit("").alias("content"), F.lit(0).cast("long").alias("size")))


def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.file_table(*_deliveries(spark, sf_dir)).select("path", "imports", "imported_by")


def _url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _url_paths(spark, sf_dir).select("page_id", paths.basename(p).alias("name"), paths.dirname(p).alias("folder"), paths.extension(p).alias("extension"), paths.stem(p).alias("stem"))


def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit("./x/../"), F.col("path"), F.lit("/./y/.."))
    return _url_paths(spark, sf_dir).select("page_id", paths.normalised(messy).alias("path"))


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _url_paths(spark, sf_dir)
    roots = pages.select(F.explode(rollup.ancestors(F.col("path"))).alias("root")).groupBy("root").agg(F.count("*").alias("n")).where("n >= 3").select("root")
    return rollup.longest_prefix(pages.select("page_id", "path"), "path", roots, "root").select("page_id", "root")


def subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.subtree_counts(_url_paths(spark, sf_dir), "path").withColumn("depth", F.col("depth").cast("long"))


def first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the first of three candidate suppliers that exists in its nation."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    wanted = customer.select(key, F.array(*(F.concat_ws(":", ((key * m) % 150).cast("string"), F.col("c_nationkey").cast("string")) for m in (3, 7, 1))).alias("candidates"))
    known = table(spark, sf_dir, "supplier").select(F.concat_ws(":", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("target"))
    return rollup.first_candidate(wanted, "c_custkey", "candidates", known, "target")


def left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _moments(spark, sf_dir)
    right = events.where("event_type = 'signup'").groupBy("user_id", "ms").agg(F.min("event_id").alias("signup"))
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ms")
    return asof.asof(left, right, ["user_id"], "ms", ["signup"], within=86_400_000).select("event_id", "signup")


def asof_forward_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _moments(spark, sf_dir)
    right = events.where("event_type = 'purchase'").groupBy("user_id", "ms").agg(F.min("event_id").alias("purchase"))
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ms")
    return asof.asof(left, right, ["user_id"], "ms", ["purchase"], within=3_600_000, forward=True).select("event_id", "purchase")


def lead_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _moments(spark, sf_dir).select("user_id", "ms").distinct()
    return asof.extents(starts, ["user_id"], "ms", F.col("ms"))


def carry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _moments(spark, sf_dir)
    value = F.when(F.col("event_type") == "error", F.col("event_id"))
    return asof.carried(events, ["user_id"], ["ms", "event_id"], value, "last_error", reset=F.col("event_type") == "signup").select("event_id", "last_error")


def dedupe_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _moments(spark, sf_dir)
    return ranking.prefer(events, ["user_id", "event_type"], (F.col("value") > 50).desc_nulls_last(), F.col("event_id")).select("user_id", "event_type", "event_id")


def top_with_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    found = ranking.top_with_hidden(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 12)
    return found.select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"), "hidden")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.composition(table(spark, sf_dir, "documents"), "source", 7)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations: from a supplier's to a customer's, as sure as the order's status tells."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == customer.c_custkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    sure = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "inferred").otherwise("unresolved")
    return joined.select("src", "dst", sure.alias("confidence"))


def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weakest(_trade(spark, sf_dir), ["src", "dst"])


def undirected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected_pairs(_trade(spark, sf_dir))


def neighbour_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _trade(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "confidence")
    return graph.neighbours(edges, "7", 4)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph of parts (a tenth of them external) and customers: each line links its part to the part that its supplier stands
    for; customers have no links."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, "external").otherwise("module").alias("kind"))
    parts = parts.unionByName(table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000_000_000).alias("id"), F.lit("module").alias("kind")))
    linked = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    sure = F.when(F.col("l_suppkey") % 3 == 0, "exact").when(F.col("l_suppkey") % 3 == 1, "inferred").otherwise("unresolved")
    return parts, linked.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst"), sure.alias("confidence")).where("src <> dst")


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_graph(spark, sf_dir))


def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.isolated(*_graph(spark, sf_dir)).select("id")


def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.health(*_graph(spark, sf_dir))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(*_graph(spark, sf_dir), least=45, share=0.001)


def component_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(_graph(spark, sf_dir)[1].select(F.col("src").alias("a"), F.col("dst").alias("b")))


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of parts alone: parts with their brands as areas, and links of which both ends are parts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("area"))
    edges = _graph(spark, sf_dir)[1].select("src", "dst")
    return parts, edges.join(parts.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def mutual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lead to one another along links, by the least of them."""
    return cycles.mutual(_linked(spark, sf_dir)[1])


def condensed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.condensed_ranks(_linked(spark, sf_dir)[1]).withColumn("rank", F.col("rank").cast("long"))


def turned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different links, and which of them to turn so that no cycle is left."""
    return cycles.without_cycles(_linked(spark, sf_dir)[1])


def part_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts by labels passed along links, small ones merged."""
    parts, edges = _linked(spark, sf_dir)
    return communities.merged(communities.communities(parts, edges), edges)


def area_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that tie most brands together, hubs aside."""
    parts, edges = _linked(spark, sf_dir)
    return communities.core(parts, edges, graph.hubs(parts, edges, least=600, share=0.001))


def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = communities.breadth_first(*_linked(spark, sf_dir))
    return found.select("root", "id", F.col("level").cast("long").alias("level"), F.col("nth").cast("long").alias("nth"))


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return graph.crossings(lines.select(F.col("l_linenumber").alias("column"), (F.col("l_partkey") % 40).alias("top"), (F.col("l_suppkey") % 40).alias("bottom")))


def area_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("area"))
    found = graph.areas(nodes, _trade(spark, sf_dir))
    return found.select("area", "members", "internal", "crossing", F.concat_ws(",", "neighbours").alias("neighbours"))


def boundary_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("area"), F.col("n_name").alias("label"))
    found = graph.boundary(nodes, _trade(spark, sf_dir), "1")
    return found.select("node", "far_area", "direction", "n", F.concat_ws(",", "labels").alias("labels"), "confidence")


def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, each closed by 30 minutes without one."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    found = changes.bursts(events, gap="30 minutes", by="user_id")
    return found.select("user_id", F.unix_millis("start").alias("start"), "n", F.concat_ws(",", "paths").alias("paths"))


def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of links, each at the first place where it occurs on its page."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.posexplode(text.located("html", 'href="([^"]*)"')).alias("nth", "link"))
    return found.groupBy("page_id", F.col("link.value").alias("target")).agg(F.min("nth").cast("long").alias("nth"), F.count("*").alias("n"))


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select("conv_id", "turn", text.numbered_lines(F.col("text"))).where("length(line) > 0")
    return lines.select("conv_id", "turn", F.col("number").cast("long").alias("number"), F.length("line").cast("long").alias("length"), text.truncated(F.col("line"), 44).alias("label"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    name = F.col("n_name")
    return nation.select("n_nationkey", ids.node_id("nation", name).alias("id"), ids.fnv1a(name).alias("hash"), text.snake_case(name).alias("snake"), text.plural(F.lower(name)).alias("plural"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over all tables, one row."""
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias(f"n_{t}")) for t in ("orders", "lineitem", "events", "documents", "pages")]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # rows of one row each
    return out


def carried_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot spots: nations by the edges that arrive and leave, loops aside."""
    edges = _trade(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return reports.hotspots(edges, 12)


QUERIES = source_queries.QUERIES | language_queries.QUERIES | report_queries.QUERIES | {
    f.__name__: f
    for f in (
        module_edges, external_topk, fan_in_out, path_parts, normal_paths, longest_prefix, subtree_counts, first_candidate, left_anti, asof_backward,
        asof_forward_limit, lead_extent, carry_state, dedupe_prefer, top_with_hidden, composition, min_confidence, undirected_pairs, neighbour_limit,
        degree, isolated, graph_health, hubs, component_roots, mutual_groups, condensed_ranks, turned_edges, part_communities, area_core, breadth_first, crossings, area_rollup, boundary_folding, session_debounce, regex_extract, line_explode,
        identifiers, stats, carried_ranks,
    )
}

_PAGES = r"(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
_MOMENTS = "(SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, value FROM events)"
_TRADE = """(SELECT s_nationkey AS src, c_nationkey AS dst,
    CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'inferred' ELSE 'unresolved' END AS confidence
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_PARTS = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'external' ELSE 'module' END AS kind FROM part UNION ALL SELECT c_custkey + 1000000000000, 'module' FROM customer)"
_LINKS = """(SELECT l_partkey AS src, l_suppkey * 7 AS dst,
    CASE l_suppkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS confidence
    FROM lineitem WHERE l_partkey <> l_suppkey * 7)"""
_OWN = f"(SELECT src, dst FROM {_LINKS} WHERE dst IN (SELECT p_partkey FROM part))"
_REACH = f"""l AS (SELECT DISTINCT src, dst FROM {_OWN}), r(a, b) AS (SELECT src, dst FROM l UNION SELECT r.a, l.dst FROM r JOIN l ON r.b = l.src),
    g AS (SELECT node, least(node, coalesce(min(x.b) FILTER (y.a IS NOT NULL), node)) AS root FROM (SELECT src AS node FROM l UNION SELECT dst FROM l) n
          LEFT JOIN r x ON x.a = node LEFT JOIN r y ON y.a = x.b AND y.b = node GROUP BY node)"""
_RANK = "CASE confidence WHEN 'exact' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END"
_ABOVE = f"""(SELECT page_id, path, unnest(list_transform(range(1, len(string_split(path, '/'))),
    lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))) AS root FROM {_PAGES})"""

_DELIVERED = """d AS (SELECT replace(p_brand, '#', '') AS src, 'nation' || s_nationkey AS dst, replace(p_brand, '#', '') || '/' || p_partkey || '.ts' AS path,
    'nation' || s_nationkey || '/' || s_suppkey || '.go' AS target, l_orderkey * 8 + l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

ORACLES = source_queries.ORACLES | language_queries.ORACLES | report_queries.ORACLES | {
    "module_edges": f"""
        WITH {_DELIVERED} SELECT src, dst, CAST(count(DISTINCT target || ' ' || path || ' ' || line) AS BIGINT) AS n, array_to_string(list_slice(list_sort(list(DISTINCT path)), 1, 5), ',') AS sources, arg_min(line, path || ' ' || lpad(line::VARCHAR, 19, '0')) AS line FROM d GROUP BY 1, 2""",
    "external_topk": """
        WITH u AS (SELECT p_type || '-' || p_size AS package, replace(p_brand, '#', '') AS module, replace(p_brand, '#', '') || '/' || lpad(p_partkey::VARCHAR, 12, '0') || '.ts' AS path FROM part),
        t AS (SELECT package, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, package LIMIT 18)
        SELECT package, any_value(t.n) AS n, module, count(*) AS module_n, min(path) AS file, CAST(1 AS BIGINT) AS line FROM u JOIN t USING (package) GROUP BY package, module""",
    "fan_in_out": f"""
        WITH {_DELIVERED}, a AS (SELECT replace(p_brand, '#', '') || '/' || p_partkey || '.ts' AS path FROM part UNION ALL SELECT 'nation' || s_nationkey || '/' || s_suppkey || '.go' FROM supplier)
        SELECT a.path, coalesce(o.n, 0) AS imports, coalesce(i.n, 0) AS imported_by FROM a
        LEFT JOIN (SELECT path, count(DISTINCT target) AS n FROM d GROUP BY 1) o ON o.path = a.path LEFT JOIN (SELECT target AS path, count(DISTINCT path) AS n FROM d GROUP BY 1) i ON i.path = a.path""",
    "path_parts": f"""
        SELECT page_id, regexp_extract(path, '[^/]*$') AS name,
               CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder,
               lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\\.([^.]*)$', 1)) AS extension,
               regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM {_PAGES}""",
    "normal_paths": f"SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS path FROM {_PAGES}",
    "longest_prefix": f"""
        WITH known AS (SELECT root FROM {_ABOVE} GROUP BY 1 HAVING count(*) >= 3)
        SELECT p.page_id, b.root FROM {_PAGES} p
        LEFT JOIN (SELECT path, arg_max(root, length(root)) AS root FROM {_ABOVE} WHERE root IN (SELECT root FROM known) GROUP BY 1) b ON p.path = b.path""",
    "subtree_counts": f"SELECT root AS folder, len(string_split(root, '/')) AS depth, count(*) AS n FROM {_ABOVE} GROUP BY 1, 2",
    "first_candidate": """
        WITH tried AS (SELECT c_custkey, nth, CAST(c_custkey * m % 150 AS VARCHAR) || ':' || CAST(c_nationkey AS VARCHAR) AS target
                       FROM customer, (VALUES (0, 3), (1, 7), (2, 1)) v(nth, m))
        SELECT c_custkey, arg_min(t.target, nth) AS target FROM tried t
        JOIN (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) || ':' || CAST(s_nationkey AS VARCHAR) AS target FROM supplier) s ON s.target = t.target GROUP BY 1""",
    "left_anti": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "asof_backward": f"""
        SELECT l.event_id, CASE WHEN l.ms - r.ms <= 86400000 THEN r.signup END AS signup
        FROM (SELECT * FROM {_MOMENTS} WHERE event_type = 'purchase') l
        ASOF LEFT JOIN (SELECT user_id, ms, min(event_id) AS signup FROM {_MOMENTS} WHERE event_type = 'signup' GROUP BY 1, 2) r
        ON l.user_id = r.user_id AND l.ms >= r.ms""",
    "asof_forward_limit": f"""
        SELECT l.event_id, CASE WHEN r.ms - l.ms <= 3600000 THEN r.purchase END AS purchase
        FROM (SELECT * FROM {_MOMENTS} WHERE event_type = 'click') l
        ASOF LEFT JOIN (SELECT user_id, ms, min(event_id) AS purchase FROM {_MOMENTS} WHERE event_type = 'purchase' GROUP BY 1, 2) r
        ON l.user_id = r.user_id AND l.ms <= r.ms""",
    "lead_extent": f"""
        SELECT user_id, ms, coalesce(lead(ms) OVER (PARTITION BY user_id ORDER BY ms) - 1, ms) AS until
        FROM (SELECT DISTINCT user_id, ms FROM {_MOMENTS})""",
    "carry_state": f"""
        WITH e AS (SELECT *, count(*) FILTER (event_type IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS part FROM {_MOMENTS})
        SELECT event_id, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id, part) AS last_error FROM e""",
    "dedupe_prefer": f"""
        SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
            ORDER BY value > 50 DESC NULLS LAST, event_id) AS nth FROM {_MOMENTS}) WHERE nth = 1""",
    "top_with_hidden": """
        SELECT o_orderpriority, o_orderkey, rank, greatest(everything - 12, 0) AS hidden FROM (
            SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank,
                   count(*) OVER (PARTITION BY o_orderpriority) AS everything FROM orders) WHERE rank <= 12""",
    "composition": """
        WITH c AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1),
        k AS (SELECT name FROM c WHERE name <> 'other' ORDER BY n DESC, name LIMIT 7)
        SELECT CASE WHEN name IN (SELECT name FROM k) THEN name ELSE 'other' END AS name, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "min_confidence": f"SELECT src, dst, count(*) AS n, arg_min(confidence, {_RANK}) AS confidence FROM {_TRADE} GROUP BY 1, 2",
    "undirected_pairs": f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM {_TRADE} WHERE src <> dst GROUP BY 1, 2",
    "neighbour_limit": f"""
        WITH e AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, confidence FROM {_TRADE}),
        n AS (SELECT 'out' AS side, dst AS id, arg_max(confidence, {_RANK}) AS confidence FROM e WHERE src = '7' AND dst <> '7' GROUP BY 1, 2
              UNION ALL SELECT 'in', src, arg_max(confidence, {_RANK}) FROM e WHERE dst = '7' AND src <> '7' GROUP BY 1, 2)
        SELECT side, id, confidence, greatest(everything - 4, 0) AS hidden FROM (
            SELECT *, row_number() OVER (PARTITION BY side ORDER BY {_RANK} DESC, id) AS nth, count(*) OVER (PARTITION BY side) AS everything FROM n) WHERE nth <= 4""",
    "degree": f"""
        SELECT id, coalesce(n, 0) AS degree FROM {_PARTS}
        LEFT JOIN (SELECT e AS k, count(*) AS n FROM (SELECT src AS e FROM {_LINKS} UNION ALL SELECT dst FROM {_LINKS}) GROUP BY 1) ON k = id""",
    "isolated": f"SELECT id FROM {_PARTS} WHERE kind <> 'external' AND id NOT IN (SELECT src FROM {_LINKS} UNION ALL SELECT dst FROM {_LINKS})",
    "graph_health": f"""
        SELECT count(*) FILTER (confidence = 'inferred') AS inferred, count(*) FILTER (confidence = 'unresolved') AS unresolved,
               (SELECT count(*) FROM {_PARTS} WHERE kind <> 'external' AND id NOT IN (SELECT src FROM {_LINKS} UNION ALL SELECT dst FROM {_LINKS})) AS isolated
        FROM {_LINKS}""",
    "hubs": f"""
        SELECT id, n AS degree FROM {_PARTS} JOIN (SELECT e AS k, count(*) AS n FROM (SELECT src AS e FROM {_LINKS} UNION ALL SELECT dst FROM {_LINKS}) GROUP BY 1) ON k = id
        WHERE n >= greatest(45, 0.001 * (SELECT count(*) FROM {_PARTS}))""",
    "component_roots": f"""
        WITH RECURSIVE e AS (SELECT DISTINCT src AS a, dst AS b FROM {_LINKS}), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        c(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM n
            UNION (SELECT n.a, min(r.root) FROM c r JOIN n ON n.b = r.node JOIN recurring.c s ON s.node = n.a WHERE r.root < s.root GROUP BY 1))
        SELECT node, root FROM c""",
    "mutual_groups": f"WITH RECURSIVE {_REACH} SELECT node, root FROM g",
    "condensed_ranks": f"""
        WITH RECURSIVE {_REACH}, d AS (SELECT DISTINCT x.root AS a, y.root AS b FROM l JOIN g x ON x.node = src JOIN g y ON y.node = dst WHERE x.root <> y.root),
        p(n, k) AS (SELECT DISTINCT root, 0::BIGINT FROM g UNION SELECT b, k + 1 FROM p JOIN d ON a = n)
        SELECT node, root, max(k) AS rank FROM g JOIN p ON n = root GROUP BY 1, 2""",
    "area_core": f"""
        WITH l AS (SELECT src, dst FROM {_OWN}), e AS (SELECT src AS id, dst AS far FROM l UNION ALL SELECT dst, src FROM l),
        h AS (SELECT id FROM e GROUP BY 1 HAVING count(*) >= greatest(600, 0.001 * (SELECT count(*) FROM part))),
        t AS (SELECT e.id, count(DISTINCT y.p_brand) AS reach FROM e JOIN part x ON x.p_partkey = e.id JOIN part y ON y.p_partkey = far WHERE x.p_brand <> y.p_brand AND e.id NOT IN (SELECT id FROM h) GROUP BY 1),
        c AS (SELECT id, reach FROM t WHERE reach >= 2 ORDER BY reach DESC, id LIMIT 10)
        SELECT id, reach FROM c WHERE (SELECT count(*) FROM part) >= 16 AND (SELECT count(DISTINCT p_brand) FROM part WHERE p_partkey NOT IN (SELECT id FROM c)) >= 3 AND (SELECT count(*) FROM c) >= 2""",
    "breadth_first": f"""
        WITH RECURSIVE l AS (SELECT src AS a, dst AS b FROM {_OWN} UNION ALL SELECT dst, src FROM {_OWN}), e AS (SELECT DISTINCT a, b FROM l),
        d AS (SELECT p_partkey AS id, count(a) AS n FROM part LEFT JOIN l ON a = p_partkey GROUP BY 1),
        c(node, root) USING KEY (node) AS (SELECT id, id FROM d UNION (SELECT e.a, min(r.root) FROM c r JOIN e ON e.b = r.node JOIN recurring.c s ON s.node = e.a WHERE r.root < s.root GROUP BY 1)),
        o AS (SELECT arg_min(id, [-n, id]) AS root FROM d JOIN c ON node = id GROUP BY c.root),
        v(id, root, level) USING KEY (id) AS (SELECT root, root, 0::BIGINT FROM o
            UNION (SELECT e.b, any_value(r.root), min(r.level) + 1 FROM v r JOIN e ON e.a = r.id LEFT JOIN recurring.v s ON s.id = e.b WHERE s.id IS NULL GROUP BY 1)),
        w(id, level, way) AS (SELECT id, level, [-n, id] FROM v JOIN d USING (id) WHERE level = 0
            UNION ALL (SELECT v.id, v.level, list_concat(min(w.way), [-any_value(n), v.id]) FROM w JOIN e ON e.a = w.id JOIN v ON v.id = e.b AND v.level = w.level + 1 JOIN d ON d.id = v.id GROUP BY v.id, v.level))
        SELECT v.root, v.id, v.level, row_number() OVER (PARTITION BY v.root, v.level ORDER BY way) AS nth FROM v JOIN w ON w.id = v.id""",
    "crossings": """
        WITH c AS (SELECT l_linenumber AS k, l_partkey % 40 AS t, l_suppkey % 40 AS b, count(*) AS m FROM lineitem GROUP BY 1, 2, 3)
        SELECT x.k AS "column", CAST(sum(x.m * y.m) AS BIGINT) AS n FROM c x JOIN c y ON x.k = y.k AND x.t < y.t AND x.b > y.b GROUP BY 1""",
    "area_rollup": f"""
        WITH p AS (SELECT CAST(x.n_regionkey AS VARCHAR) AS a, CAST(y.n_regionkey AS VARCHAR) AS b FROM {_TRADE} JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey),
        s AS (SELECT a AS area, b AS far FROM p UNION ALL SELECT b, a FROM p WHERE a <> b)
        SELECT s.area, any_value(m) AS members, count(*) FILTER (s.area = far) AS internal, count(*) FILTER (s.area <> far) AS crossing,
               coalesce(string_agg(DISTINCT far, ',' ORDER BY far) FILTER (s.area <> far), '') AS neighbours
        FROM s JOIN (SELECT CAST(n_regionkey AS VARCHAR) AS area, count(*) AS m FROM nation GROUP BY 1) c ON c.area = s.area GROUP BY 1""",
    "boundary_folding": f"""
        WITH p AS (SELECT src, dst, confidence, CAST(x.n_regionkey AS VARCHAR) AS a, CAST(y.n_regionkey AS VARCHAR) AS b, x.n_name AS s, y.n_name AS d
                   FROM {_TRADE} JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey),
        f AS (SELECT src AS node, b AS far_area, 'out' AS direction, d AS far, confidence FROM p WHERE a = '1' AND b <> '1'
              UNION ALL SELECT dst, a, 'in', s, confidence FROM p WHERE b = '1' AND a <> '1')
        SELECT node, far_area, direction, count(*) AS n, string_agg(DISTINCT far, ',' ORDER BY far) AS labels, arg_min(confidence, {_RANK}) AS confidence FROM f GROUP BY 1, 2, 3""",
    "session_debounce": f"""
        WITH g AS (SELECT user_id, ms, event_type, CASE WHEN ms - lag(ms) OVER w >= 1800000 THEN 1 ELSE 0 END AS new FROM {_MOMENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
        s AS (SELECT user_id, ms, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS part FROM g)
        SELECT user_id, min(ms) AS start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, part""",
    "regex_extract": """
        SELECT page_id, target, min(nth) - 1 AS nth, count(*) AS n FROM (
            SELECT page_id, trim(unnest(x)) AS target, unnest(range(1, len(x) + 1)) AS nth FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)) GROUP BY 1, 2""",
    "line_explode": """
        SELECT conv_id, turn, number, length(line) AS length, CASE WHEN length(line) > 44 THEN left(line, 43) || '…' ELSE line END AS label FROM (
            SELECT conv_id, turn, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS number FROM (SELECT conv_id, turn, string_split_regex(text, '\r?\n') AS x FROM conversations))
        WHERE length(line) > 0""",
    "identifiers": r"""
        SELECT n_nationkey, 'nation:' || replace(n_name, ' ', '%20') AS id,
               list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(unicode(n_name[i]) AS UBIGINT))),
                           lambda a, c: xor(a, c) * 16777619 % 4294967296)::BIGINT AS hash,
               lower(regexp_replace(n_name, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake,
               CASE WHEN regexp_matches(lower(n_name), '[^aeiou]y$') THEN regexp_replace(lower(n_name), 'y$', 'ies')
                    WHEN regexp_matches(lower(n_name), '(s|x|z|ch|sh)$') THEN lower(n_name) || 'es' ELSE lower(n_name) || 's' END AS plural
        FROM nation""",
    "stats": "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM lineitem) AS n_lineitem, (SELECT count(*) FROM events) AS n_events, (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM pages) AS n_pages",
    "carried_ranks": f"""
        WITH e AS (SELECT src AS id, 0 AS i, 1 AS o FROM {_TRADE} WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM {_TRADE} WHERE src <> dst),
        t AS (SELECT id, CAST(sum(i) AS BIGINT) AS arriving, CAST(sum(o) AS BIGINT) AS leaving FROM e GROUP BY 1)
        SELECT id, arriving, leaving FROM t ORDER BY arriving + leaving DESC, id LIMIT 12""",
}
