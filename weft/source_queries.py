"""Queries over a workspace that is written from the tables, one for each view of it, with SQL that says what the tables imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.workspace import Workspace
from weft.workspaces import table_workspace


def _own(spark: SparkSession, sf_dir: str) -> Workspace:
    return Workspace(spark, table_workspace(spark, sf_dir))


def _long(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("long") for c in names})


def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _own(spark, sf_dir).import_targets()
    return _long(found.select("path", "specifier", "line", F.concat_ws(",", "targets").alias("targets"), "package", "unresolved_local"), "line")


def source_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).modules.select("id", "module", "files", F.concat_ws(",", "languages").alias("languages"), F.concat_ws(",", "examples").alias("examples"))


def source_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).module_edges.withColumn("sources", F.concat_ws(",", "sources")), "line")


def source_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).externals, "line")


def source_file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).file_table.drop("bytes")


def source_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).endpoints.select("id", "protocol", "operation", "address", "handler", "confidence", "file", "line", "module", "hidden"), "line", "hidden")


def source_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).ports.select("protocol", "port", "kind", "transport", "note", "file", "line"), "port", "line")


def source_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).flow_nodes.select("unit", "kind", "label", "line"), "line")


def source_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).flow_edges.select("unit", "src", "dst", "kind", "label")


def source_flow_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).flow_list()


def source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).entities.select("variant", "entity", "kind", "physical", "file", "line"), "line")


def source_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).fields.drop("stored"), "pos")


def source_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).relations.select("variant", "entity", "field", "target", "kind", "confidence", "state", "file", F.col("line").cast("long").alias("line"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).tree.select("path", "parent", "depth", "kind", "files"), "depth")


def source_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).technologies


def source_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).area_map().select("area", "members", "internal", "crossing", F.concat_ws(",", "neighbours").alias("neighbours"))


def source_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics with their places and what they say of unresolved relations."""
    found = _own(spark, sf_dir).diagnostics
    return _long(found.select("code", "severity", F.when(F.col("code").startswith("DB_"), F.col("message")).alias("message"), "file", "line"), "line")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).stats()


def source_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one brand's package has to do with others."""
    return _own(spark, sf_dir).area("packages/Brand2").withColumn("labels", F.concat_ws(",", "labels"))


def source_shown_by_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).shown_by_areas()


def source_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the areas of the data model."""
    return _own(spark, sf_dir).subjects.select("entity", "file", "area", "oversized")


def source_schema_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).schema_map()[0].withColumn("neighbours", F.concat_ws(",", "neighbours"))


def source_schema_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that end in a file of another kind; there are none, since names resolve within a file or a project."""
    own = _own(spark, sf_dir)
    return own.schema_map()[1].unionByName(own.schema_area("db").select(F.col("node").alias("a"), F.col("far_area").alias("b"), "n"))


QUERIES = {
    f.__name__: f
    for f in (
        source_imports, source_modules, source_module_edges, source_externals, source_file_table, source_endpoints, source_ports, source_flow_nodes, source_flow_edges, source_flow_units,
        source_entities, source_fields, source_relations, source_tree, source_technologies, source_areas, source_diagnostics, source_stats, source_area,
        source_shown_by_areas, source_subjects, source_schema_map, source_schema_links,
    )
}

_CODE = """b AS (SELECT p_partkey AS p, replace(p_brand, '#', '') AS b, p_size AS z FROM part),
    e AS (SELECT DISTINCT l_partkey AS p, l_suppkey * 7 AS q FROM lineitem),
    i AS (SELECT 'packages/' || x.b || '/src/p' || x.p || '.ts' AS path, x.b AS pb, y.b AS qb, row_number() OVER (PARTITION BY x.p ORDER BY e.q) AS line,
                 CASE WHEN e.q % 3 = 0 OR y.b IS NULL THEN './p' || e.q ELSE '../../' || y.b || '/src/p' || e.q END AS specifier,
                 CASE WHEN y.b IS NOT NULL AND (e.q % 3 <> 0 OR y.b = x.b) THEN 'packages/' || y.b || '/src/p' || e.q || '.ts' END AS target
          FROM b x JOIN e ON e.p = x.p LEFT JOIN b y ON y.p = e.q),
    c AS (SELECT path, count(*) AS n FROM i GROUP BY 1),
    f AS (SELECT 'packages/' || b.b || '/src/p' || b.p || '.ts' AS path, b.p, b.b, b.z, coalesce(n, 0) AS n FROM b LEFT JOIN c ON c.path = 'packages/' || b.b || '/src/p' || b.p || '.ts'),
    k AS (SELECT 'app/models/c' || c_custkey || '.py' AS path, c_custkey AS k, c_nationkey AS n FROM customer)"""
_USED = """u AS (SELECT 'pkg-' || z AS package, 'packages/' || b AS module, path, n + 1 AS line FROM f UNION ALL SELECT 'django', 'app/models', path, 1 FROM k)"""
_MODULES = """m AS (SELECT 'packages/' || b AS module, path, 'TypeScript' AS language FROM f UNION ALL SELECT 'app/models', path, 'Python' FROM k)"""
_PATHS = """a AS (SELECT path FROM f UNION ALL SELECT path FROM k UNION ALL SELECT 'db/s' || s_suppkey || '.sql' FROM supplier UNION ALL SELECT 'deploy/n' || n_nationkey || '/Dockerfile' FROM nation)"""
_EDGES = """g AS (SELECT 'packages/' || pb AS src, 'packages/' || qb AS dst, count(*) AS n FROM i WHERE target IS NOT NULL AND pb <> qb GROUP BY 1, 2)"""
_SHOW = "'callable:' || replace(path, '/', '%2F') || ':' || (n + 3)"

_NAMED = "n AS (SELECT c_nationkey AS k, count(*) FILTER (c_custkey % 3 = 0) AS n FROM customer GROUP BY 1)"
_ENTITIES = """y AS (SELECT 't' || s_suppkey AS entity, 'db/s' || s_suppkey || '.sql' AS file, 'db' AS area FROM supplier UNION ALL SELECT 'n' || s_nationkey, 'db/s' || s_suppkey || '.sql', 'db' FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT 'C' || c_custkey, 'app/models/c' || c_custkey || '.py', 'app/models' FROM customer UNION ALL SELECT 'N' || c_nationkey, 'app/models/c' || c_custkey || '.py', 'app/models' FROM customer WHERE c_custkey % 3 = 0),
    z AS (SELECT area, count(*) AS members, count(*) > 30 AS oversized FROM y GROUP BY 1)"""

ORACLES = {
    "source_stats": f"""
        WITH {_CODE}, {_USED}, {_EDGES}, {_NAMED}, {_ENTITIES}, t AS (SELECT package FROM u GROUP BY 1 ORDER BY count(*) DESC, package LIMIT 18)
        SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS files, (SELECT count(DISTINCT b) + 1 FROM f) AS modules,
               (SELECT count(*) FROM f) + (SELECT count(*) FROM k) AS code_files, (SELECT count(*) FROM g) AS module_edges, (SELECT count(*) FROM g) + (SELECT count(DISTINCT package || ' ' || module) FROM u JOIN t USING (package)) AS dependencies,
               1 + (SELECT count(DISTINCT b) FROM f) + least(180, (SELECT count(*) FROM f)) AS flow_units,
               (SELECT count(*) FROM y) + (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1) + (SELECT count(*) FROM n WHERE n <> 1) AS entities, 1 AS protocols, (SELECT count(*) FROM f) AS endpoints, 50 AS ports, 50 AS bound""",
    "source_area": f"""
        WITH {_CODE}, {_EDGES} SELECT 'module:packages%2FBrand2' AS node, dst AS far_area, 'out' AS direction, count(*) AS n, dst AS labels, 'inferred' AS confidence FROM g WHERE src = 'packages/Brand2' GROUP BY dst
        UNION ALL SELECT 'module:packages%2FBrand2', src, 'in', count(*), src, 'inferred' FROM g WHERE dst = 'packages/Brand2' GROUP BY src""",
    "source_shown_by_areas": f"WITH {_CODE}, {_ENTITIES} SELECT 'modules' AS view, count(DISTINCT b) + 1 > 24 AS uses_areas FROM f UNION ALL SELECT 'entities', (SELECT count(*) FROM y) > 30",
    "source_subjects": f"WITH {_ENTITIES} SELECT entity, file, y.area, oversized FROM y JOIN z ON y.area = z.area",
    "source_schema_map": f"""
        WITH {_NAMED}, {_ENTITIES}, r AS (SELECT 'db' AS area, s_suppkey % 2 = 0 AS found FROM supplier UNION ALL SELECT 'app/models', n = 1 FROM customer JOIN n ON k = c_nationkey)
        SELECT z.area, any_value(members) AS members, 'table' AS noun, count(*) FILTER (found) AS internal, CAST(0 AS BIGINT) AS crossing, '' AS neighbours, count(*) FILTER (NOT found) AS unresolved, any_value(oversized) AS oversized FROM z JOIN r ON r.area = z.area GROUP BY 1""",
    "source_schema_links": "SELECT '' AS a, '' AS b, CAST(0 AS BIGINT) AS n WHERE false",
    "source_imports": f"""
        WITH {_CODE} SELECT path, specifier, line, coalesce(target, '') AS targets, CAST(NULL AS VARCHAR) AS package, target IS NULL AS unresolved_local FROM i
        UNION ALL SELECT path, 'pkg-' || z, n + 1, '', 'pkg-' || z, false FROM f UNION ALL SELECT path, 'django.db', 1, '', 'django', false FROM k""",
    "source_modules": f"""
        WITH {_CODE}, {_MODULES} SELECT 'module:' || replace(module, '/', '%2F') AS id, module, count(*) AS files, string_agg(DISTINCT language, ',') AS languages,
               array_to_string(list_slice(list_sort(list(path)), 1, 5), ',') AS examples FROM m GROUP BY module""",
    "source_module_edges": f"""
        WITH {_CODE} SELECT 'packages/' || pb AS src, 'packages/' || qb AS dst, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT path)), 1, 5), ',') AS sources,
               arg_min(line, path || ' ' || lpad(line::VARCHAR, 9, '0')) AS line FROM i WHERE target IS NOT NULL AND pb <> qb GROUP BY 1, 2""",
    "source_externals": f"""
        WITH {_CODE}, {_USED}, t AS (SELECT package, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, package LIMIT 18)
        SELECT package, any_value(t.n) AS n, module, count(*) AS module_n, min(path) AS file, arg_min(line, path) AS line FROM u JOIN t USING (package) GROUP BY package, module""",
    "source_file_table": f"""
        WITH {_CODE}, {_PATHS}, o AS (SELECT path, count(DISTINCT target) AS x FROM i WHERE target IS NOT NULL AND target <> path GROUP BY 1), r AS (SELECT target AS path, count(DISTINCT path) AS y FROM i WHERE target <> path GROUP BY 1)
        SELECT f.path, 'packages/' || b AS module, 'source' AS role, 'TypeScript' AS language, n + 7 AS lines, coalesce(x, 0) AS imports, coalesce(y, 0) AS imported_by FROM f LEFT JOIN o ON o.path = f.path LEFT JOIN r ON r.path = f.path
        UNION ALL SELECT path, 'app/models', 'source', 'Python', CASE WHEN k % 3 = 0 THEN 8 ELSE 5 END, 0, 0 FROM k
        UNION ALL SELECT 'db/s' || s_suppkey || '.sql', NULL, 'other', 'Other', CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 5 END, NULL, NULL FROM supplier
        UNION ALL SELECT 'deploy/n' || n_nationkey || '/Dockerfile', NULL, 'config', 'Other', 2, NULL, NULL FROM nation""",
    "source_endpoints": f"""
        WITH {_CODE} SELECT 'endpoint:http:GET:%2Fparts%2F' || p || ':' || replace(path, '/', '%2F') AS id, 'http' AS protocol, 'GET' AS operation, '/parts/' || p AS address, 'show' || p AS handler, 'exact' AS confidence, path AS file, n + 2 AS line,
               'packages/' || b AS module, greatest((SELECT count(*) FROM f) - 400, 0) AS hidden FROM f ORDER BY '/parts/' || p LIMIT 400""",
    "source_ports": """
        WITH x AS (SELECT 8000 + n_nationkey AS port, n_nationkey AS k, CAST(NULL AS VARCHAR) AS transport FROM nation UNION ALL SELECT 9092, n_nationkey, 'tcp' FROM nation)
        SELECT CASE port WHEN 8000 THEN 'http' WHEN 9092 THEN 'kafka' ELSE 'tcp' END AS protocol, CAST(port AS BIGINT) AS port, 'expose' AS kind, transport,
               CASE port WHEN 8000 THEN 'HTTP' WHEN 9092 THEN 'Kafka broker' END AS note, 'deploy/n' || k || '/Dockerfile' AS file, CAST(2 AS BIGINT) AS line FROM x ORDER BY port, file LIMIT 80""",
    "source_flow_nodes": f"""
        WITH {_CODE} SELECT path AS unit, 'step' AS kind, 'show' || p AS label, n + 3 AS line FROM f UNION ALL SELECT path, 'decision', 'id', n + 4 FROM f
        UNION ALL SELECT path, 'io', 'db.query', n + 5 FROM f UNION ALL SELECT path, 'start', 'GET /parts/' || p, n + 2 FROM f""",
    "source_flow_edges": f"""
        WITH {_CODE}, d AS (SELECT *, replace(path, '/', '%2F') AS q FROM f)
        SELECT path AS unit, {_SHOW} AS src, 'decision:' || q || ':' || (n + 4) AS dst, 'fork' AS kind, '' AS label FROM d
        UNION ALL SELECT path, 'decision:' || q || ':' || (n + 4), 'io:' || q || ':db.query', 'io', 'Yes' FROM d
        UNION ALL SELECT path, 'route:' || q || ':GET%20%2Fparts%2F' || p, {_SHOW}, 'dispatch', '' FROM d""",
    "source_flow_units": f"""
        WITH {_CODE}, {_MODULES}, {_EDGES} SELECT 'project' AS kind, 'project' AS unit, (SELECT count(*) FROM m) AS files, (SELECT count(DISTINCT module) FROM m) AS nodes, (SELECT count(*) FROM g) AS edges
        UNION ALL SELECT 'service', 'packages/' || b, count(*), 4 * least(count(*), 16), 3 * least(count(*), 16) FROM f GROUP BY b
        UNION ALL SELECT * FROM (SELECT 'file', path, 1, 4, 3 FROM f ORDER BY path LIMIT 180)""",
    "source_entities": """
        SELECT 'sql:db/s' || s_suppkey || '.sql' AS variant, 't' || s_suppkey AS entity, 'table' AS kind, 't' || s_suppkey AS physical, 'db/s' || s_suppkey || '.sql' AS file, CAST(1 AS BIGINT) AS line FROM supplier
        UNION ALL SELECT 'sql:db/s' || s_suppkey || '.sql', 'n' || s_nationkey, 'table', 'n' || s_nationkey, 'db/s' || s_suppkey || '.sql', 6 FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'django:.', 'C' || c_custkey, 'table', 'c' || c_custkey, 'app/models/c' || c_custkey || '.py', 3 FROM customer
        UNION ALL SELECT 'django:.', 'N' || c_nationkey, 'table', 'n' || c_nationkey, 'app/models/c' || c_custkey || '.py', 7 FROM customer WHERE c_custkey % 3 = 0""",
    "source_fields": """
        WITH s AS (SELECT 'sql:db/s' || s_suppkey || '.sql' AS v, 'db/s' || s_suppkey || '.sql' AS f, 't' || s_suppkey AS t, 'n' || s_nationkey AS n, s_suppkey % 2 = 0 AS pair FROM supplier),
        c AS (SELECT 'django:.' AS v, 'app/models/c' || c_custkey || '.py' AS f, 'C' || c_custkey AS c, 'N' || c_nationkey AS n, c_custkey % 3 = 0 AS pair FROM customer)
        SELECT v AS variant, f AS file, t AS entity, CAST(0 AS BIGINT) AS pos, 'id' AS field, 'bigint' AS type, true AS pk, false AS uniq, false AS nullable, false AS generated, false AS related, CAST(NULL AS BOOLEAN) AS inferred FROM s
        UNION ALL SELECT v, f, t, 1, 'nation', 'int', false, false, false, false, true, NULL FROM s UNION ALL SELECT v, f, t, 2, 'name', 'varchar(25)', false, true, NULL, false, false, NULL FROM s
        UNION ALL SELECT v, f, n, 0, 'id', 'int', false, false, NULL, false, false, NULL FROM s WHERE pair
        UNION ALL SELECT v, f, c, 0, 'id', 'AutoField', true, true, false, true, NULL, true FROM c UNION ALL SELECT v, f, c, 4, 'name', 'CharField', false, true, NULL, NULL, false, NULL FROM c
        UNION ALL SELECT v, f, c, 5, 'nation', 'ForeignKey', false, NULL, NULL, NULL, true, NULL FROM c UNION ALL SELECT v, f, n, 8, 'code', 'IntegerField', true, NULL, NULL, NULL, false, NULL FROM c WHERE pair""",
    "source_relations": """
        WITH n AS (SELECT c_nationkey AS k, count(*) FILTER (c_custkey % 3 = 0) AS n FROM customer GROUP BY 1)
        SELECT 'sql:db/s' || s_suppkey || '.sql' AS variant, 't' || s_suppkey AS entity, 'nation' AS field, 'n' || s_nationkey AS target, 'one' AS kind,
               CASE WHEN s_suppkey % 2 = 0 THEN 'exact' ELSE 'unresolved' END AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'resolved' ELSE 'missing' END AS state, 'db/s' || s_suppkey || '.sql' AS file, CAST(3 AS BIGINT) AS line FROM supplier
        UNION ALL SELECT 'django:.', 'C' || c_custkey, 'nation', 'N' || c_nationkey, 'one', CASE n WHEN 1 THEN 'exact' ELSE 'unresolved' END, CASE n WHEN 1 THEN 'resolved' WHEN 0 THEN 'missing' ELSE 'ambiguous' END,
               'app/models/c' || c_custkey || '.py', 5 FROM customer JOIN n ON k = c_nationkey""",
    "source_tree": f"""
        WITH {_CODE}, {_PATHS}, w AS (SELECT path, string_split(path, '/') AS s FROM a), l AS (SELECT array_to_string(list_slice(s, 1, d), '/') AS path, d, count(*) AS n FROM (SELECT s, unnest(range(1, len(s))) AS d FROM w) GROUP BY 1, 2)
        SELECT path, CASE WHEN d = 1 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, CAST(d AS BIGINT) AS depth, 'folder' AS kind, n AS files FROM l
        UNION ALL SELECT path, regexp_replace(path, '/[^/]*$', ''), len(s), 'file', NULL FROM w""",
    "source_technologies": "SELECT unnest(['TypeScript', 'Python', 'Django', 'SQL', 'Docker']) AS technology",
    "source_areas": f"""
        WITH {_CODE}, {_EDGES}, s AS (SELECT src AS area, dst AS far FROM g UNION ALL SELECT dst, src FROM g)
        SELECT area, CAST(1 AS BIGINT) AS members, CAST(0 AS BIGINT) AS internal, count(*) AS crossing, string_agg(DISTINCT far, ',' ORDER BY far) AS neighbours FROM s GROUP BY 1
        UNION ALL SELECT 'packages/' || b, 1, 0, 0, '' FROM b WHERE 'packages/' || b NOT IN (SELECT area FROM s) GROUP BY b UNION ALL SELECT 'app', 1, 0, 0, ''""",
    "source_diagnostics": f"""
        WITH {_CODE}, n AS (SELECT c_nationkey AS k, count(*) FILTER (c_custkey % 3 = 0) AS n FROM customer GROUP BY 1), none AS (SELECT CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS line)
        SELECT 'LOCAL_IMPORTS_UNRESOLVED' AS code, 'info' AS severity, message, file, line FROM none WHERE EXISTS (SELECT * FROM i WHERE target IS NULL)
        UNION ALL SELECT 'DB_RELATION_UNRESOLVED', 'info', 't' || s_suppkey || '.nation names n' || s_nationkey || ' which is missing', 'db/s' || s_suppkey || '.sql', 3 FROM supplier WHERE s_suppkey % 2 = 1
        UNION ALL SELECT 'DB_RELATION_UNRESOLVED', 'info', 'C' || c_custkey || '.nation names N' || c_nationkey || ' which is ' || CASE n WHEN 0 THEN 'missing' ELSE 'ambiguous' END, 'app/models/c' || c_custkey || '.py', 5
        FROM customer JOIN n ON k = c_nationkey WHERE n <> 1
        UNION ALL SELECT 'FLOW_STATIC_HEURISTIC', 'info', * FROM none UNION ALL SELECT 'FLOW_FILE_LIMIT', 'info', * FROM none WHERE (SELECT count(*) FROM f) > 180
        UNION ALL SELECT 'EXTERNAL_DEPENDENCY_LIMIT', 'info', * FROM none WHERE (SELECT count(DISTINCT z) + 1 FROM f) > 18""",
}
