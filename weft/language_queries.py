"""Queries over a workspace in many languages that is written from the tables, with SQL that says what the tables imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import interfaces, schema
from weft.plans.workspace import Workspace
from weft.workspaces import interface_workspace, language_workspace


def _own(spark: SparkSession, sf_dir: str) -> Workspace:
    return Workspace(spark, language_workspace(spark, sf_dir))


def _long(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("long") for c in names})


def language_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports in eleven languages: the file that each means, or the symbol of several."""
    found = _own(spark, sf_dir).imports
    return _long(found.select("path", "grp", "specifier", "line", F.concat_ws(",", "targets").alias("targets"), "symbol", "package", "unresolved_local"), "line")


def language_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).symbol_files


def language_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).module_edges.withColumn("sources", F.concat_ws(",", "sources")), "line")


def language_file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).file_table.drop("bytes")


def language_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).entities.select("variant", "entity", "kind", "physical", "file", "line"), "line")


def language_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).fields.select("variant", "entity", "file", F.col("pos").cast("long").alias("pos"), "field", "stored", "type", "pk", "uniq", "nullable", "generated", "related", "inferred")


def language_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_own(spark, sf_dir).relations.select("variant", "entity", "file", "line", "field", "target", "kind", "name", "confidence", "state"), "line")


def language_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.placeholders(_own(spark, sf_dir).relations).select("variant", "entity")


def language_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the Go files: a call on one branch of a decision, input and output on the other."""
    return _own(spark, sf_dir).flow_edges.where("unit LIKE 'go/%'").select("unit", "src", "dst", "kind", "label")


def language_module_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules on cycles of imports as one, with the longest ways to them."""
    return _long(_own(spark, sf_dir).module_ranks(), "rank")


def language_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the flows of the Go files begin and end."""
    nodes, edges = _own(spark, sf_dir).flow_with_boundaries()
    return edges.where("unit LIKE 'go/%' AND kind IN ('starts', 'finishes')").select("unit", "src", "dst", "kind")


def _offered(spark: SparkSession, sf_dir: str) -> Workspace:
    return Workspace(spark, interface_workspace(spark, sf_dir))


def interface_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of eight kinds with their handlers."""
    found = _offered(spark, sf_dir).endpoints
    return _long(found.select("protocol", "operation", "address", "handler", "framework", "confidence", "file", "line", "hidden"), "line")


def interface_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_offered(spark, sf_dir).ports, "port", "host_port", "line")


def interface_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _offered(spark, sf_dir)
    return interfaces.summary(own.endpoints, own.ports)


QUERIES = {
    f.__name__: f
    for f in (
        language_imports, language_symbols, language_module_edges, language_file_table, language_entities, language_fields, language_relations, language_placeholders, language_flow_edges, language_module_ranks, language_boundaries,
        interface_endpoints, interface_ports, interface_summary,
    )
}

_TABLES = """c AS (SELECT c_custkey AS k, c_nationkey AS n, (c_nationkey + 1) % 25 AS m, 'jv/n' || c_nationkey || '/C' || c_custkey || '.java' AS path FROM customer),
    p AS (SELECT p_partkey AS k, p_size % 7 AS n, (p_size + 1) % 7 AS m, 'services/g' || (p_size % 7) || '/P' || p_partkey || '.cs' AS path FROM part),
    s AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_nationkey + 1) % 25 AS m, 'go/n' || s_nationkey || '/s' || s_suppkey || '.go' AS path FROM supplier),
    t AS (SELECT n_nationkey AS k, (n_nationkey + 1) % 25 AS m, n_regionkey AS r, (n_regionkey + 1) % 5 AS q FROM nation),
    y AS (SELECT 'jvm' AS grp, 'shop.n' || n || '.*' AS name, path AS target FROM c UNION ALL SELECT 'jvm', 'shop.*', path FROM c
          UNION ALL SELECT 'jvm', 'shop.n' || n || '.C' || k, path FROM c UNION ALL SELECT 'cs', 'Shop.G' || n, path FROM p UNION ALL SELECT 'go', 'ex.org/shop/n' || n, path FROM s
          UNION ALL SELECT 'php', 'App\\N\\C' || k, 'php/C' || k || '.php' FROM t UNION ALL SELECT 'swift', 'M' || r, 'sw/Sources/M' || r || '/s' || k || '.swift' FROM t),
    z AS (SELECT grp, name, count(*) AS n, min(target) AS target FROM y GROUP BY 1, 2)"""
_FACTS = """f(path, grp, specifier, line, one, name, package, lost) AS (
    SELECT path, 'jvm', 'java.util.List', 2, NULL, NULL, NULL, false FROM c UNION ALL SELECT path, 'jvm', 'shop.n' || m || '.*', 3, NULL, 'shop.n' || m || '.*', 'shop.n' || m, false FROM c
    UNION ALL SELECT path, 'jvm', 'org.acme.lib' || (k % 3) || '.Tool', 4, NULL, NULL, 'org.acme.lib' || (k % 3), false FROM c
    UNION ALL SELECT path, 'cs', 'System.Text', 1, NULL, NULL, NULL, false FROM p UNION ALL SELECT path, 'cs', 'Shop.G' || m, 2, NULL, 'Shop.G' || m, 'Shop.G' || m, false FROM p
    UNION ALL SELECT path, 'cs', 'Newton.Json.L' || (k % 4), 3, NULL, NULL, 'Newton.Json', false FROM p
    UNION ALL SELECT path, 'go', 'fmt', 4, NULL, NULL, NULL, false FROM s UNION ALL SELECT path, 'go', 'ex.org/shop/n' || m, 5, NULL, 'ex.org/shop/n' || m, 'ex.org/shop/n' || m, false FROM s
    UNION ALL SELECT path, 'go', 'github.com/acme/lib' || (k % 3) || '/sub', 6, NULL, NULL, 'github.com/acme/lib' || (k % 3), false FROM s UNION ALL SELECT path, 'go', 'gorm.io/gorm', 7, NULL, NULL, 'gorm.io/gorm', false FROM s
    UNION ALL SELECT 'rust/src/n' || k || '.rs', 'rs', 'crate::n' || m || '::Thing', 1, 'rust/src/n' || m || '.rs', NULL, NULL, false FROM t UNION ALL SELECT 'rust/src/n' || k || '.rs', 'rs', 'serde::Ser', 2, NULL, NULL, 'serde', false FROM t
    UNION ALL SELECT 'rust/src/n' || k || '.rs', 'rs', 'std::io', 3, NULL, NULL, NULL, false FROM t UNION ALL SELECT 'rust/src/n' || k || '.rs', 'rs', 'self::sub', 4, NULL, NULL, NULL, true FROM t
    UNION ALL SELECT 'c/m' || k || '.c', 'c', './h' || m || '.h', 1, 'c/include/h' || m || '.h', NULL, NULL, false FROM t UNION ALL SELECT 'c/m' || k || '.c', 'c', 'boost/asio.hpp', 3, NULL, NULL, 'boost', false FROM t
    UNION ALL SELECT 'c/m' || k || '.c', 'c', 'stdio.h', 4, NULL, NULL, NULL, false FROM t
    UNION ALL SELECT 'php/C' || k || '.php', 'php', 'App\\N\\C' || m, 3, 'php/C' || m || '.php', NULL, NULL, false FROM t UNION ALL SELECT 'php/C' || k || '.php', 'php', './x.php', 4, NULL, NULL, NULL, true FROM t
    UNION ALL SELECT 'rb/lib/f' || k || '.rb', 'rb', './f' || m, 1, 'rb/lib/f' || m || '.rb', NULL, NULL, false FROM t UNION ALL SELECT 'rb/lib/f' || k || '.rb', 'rb', 'json', 2, NULL, NULL, NULL, false FROM t
    UNION ALL SELECT 'rb/lib/f' || k || '.rb', 'rb', 'active_support/core', 3, NULL, NULL, 'active_support', false FROM t
    UNION ALL SELECT 'sw/Sources/M' || r || '/s' || k || '.swift', 'swift', 'Foundation', 1, NULL, NULL, NULL, false FROM t UNION ALL SELECT 'sw/Sources/M' || r || '/s' || k || '.swift', 'swift', 'M' || q, 2, NULL, 'M' || q, NULL, false FROM t
    UNION ALL SELECT 'sw/Sources/M' || r || '/s' || k || '.swift', 'swift', 'Alamofire', 3, NULL, NULL, 'Alamofire', false FROM t
    UNION ALL SELECT 'da/lib/d' || k || '.dart', 'dart', 'package:shop/d' || m || '.dart', 1, 'da/lib/d' || m || '.dart', NULL, NULL, false FROM t UNION ALL SELECT 'da/lib/d' || k || '.dart', 'dart', 'package:flutter/m.dart', 2, NULL, NULL, 'flutter', false FROM t
    UNION ALL SELECT 'da/lib/d' || k || '.dart', 'dart', 'dart:io', 3, NULL, NULL, NULL, false FROM t UNION ALL SELECT 'da/lib/d' || k || '.dart', 'dart', 'package:drift/drift.dart', 4, NULL, NULL, 'drift', false FROM t
    UNION ALL SELECT 'web/e' || k || '.ts', 'js', 'typeorm', 1, NULL, NULL, 'typeorm', false FROM t UNION ALL SELECT 'doc/m' || k || '.js', 'js', 'mongoose', 1, NULL, NULL, 'mongoose', false FROM t
    UNION ALL SELECT 'py/m' || k || '.py', 'py', 'mongoengine', 1, NULL, NULL, 'mongoengine', false FROM t UNION ALL SELECT 'py/m' || k || '.py', 'py', '.m' || m, 2, 'py/m' || m || '.py', NULL, NULL, false FROM t),
    i AS (SELECT path, f.grp, specifier, line, coalesce(one, CASE z.n WHEN 1 THEN z.target END) AS target, CASE WHEN z.n > 1 THEN f.grp || ':' || f.name END AS symbol, CASE WHEN z.n IS NULL AND one IS NULL THEN package END AS package, lost
          FROM f LEFT JOIN z ON z.grp = f.grp AND z.name = f.name)"""
#: Where files lie: the module of each code file, and all files.
_PLACES = """a(path, module, language, lines) AS (SELECT path, 'jv/n' || n, 'Java', 18 FROM c UNION ALL SELECT path, 'services/g' || n, 'C#', 6 FROM p UNION ALL SELECT path, 'go/n' || n, 'Go', 25 FROM s
    UNION ALL SELECT 'rust/src/n' || k || '.rs', 'rust/src', 'Rust', 4 FROM t UNION ALL SELECT 'c/m' || k || '.c', 'c', 'C', 4 FROM t UNION ALL SELECT 'c/include/h' || k || '.h', 'c', 'C', 1 FROM t
    UNION ALL SELECT 'php/C' || k || '.php', 'php', 'PHP', 4 FROM t UNION ALL SELECT 'rb/lib/f' || k || '.rb', 'rb', 'Ruby', 3 FROM t UNION ALL SELECT 'sw/Sources/M' || r || '/s' || k || '.swift', 'sw', 'Swift', 3 FROM t
    UNION ALL SELECT 'da/lib/d' || k || '.dart', 'da/lib', 'Dart', 8 FROM t UNION ALL SELECT 'web/e' || k || '.ts', 'web', 'TypeScript', 10 FROM t UNION ALL SELECT 'doc/m' || k || '.js', 'doc', 'JavaScript', 8 FROM t
    UNION ALL SELECT 'py/m' || k || '.py', 'py', 'Python', 6 FROM t)"""
_REACHED = """x AS (SELECT path, specifier, line, target FROM i WHERE target IS NOT NULL UNION ALL SELECT path, specifier, line, y.target FROM i JOIN y ON i.symbol = y.grp || ':' || y.name)"""
_EDGES = """e AS (SELECT o.module AS src, d.module AS dst, count(DISTINCT x.path || ' ' || specifier || ' ' || line) AS n, array_to_string(list_slice(list_sort(list(DISTINCT x.path)), 1, 5), ',') AS sources, arg_min(line, x.path) AS line
    FROM x JOIN a o ON o.path = x.path JOIN a d ON d.path = x.target WHERE o.module <> d.module GROUP BY 1, 2)"""
_NONE = "CAST(NULL AS VARCHAR)"
_YES, _NO, _OPEN = "true", "false", "CAST(NULL AS BOOLEAN)"

_OFFERED = """k AS (SELECT s_suppkey AS k FROM supplier), o(protocol, operation, address, handler, framework, file, line) AS (
    SELECT 'http', 'GET', '/s' || k || '/:id', 'find' || k, 'NestJS', 'api/s' || k || '.controller.ts', 3 FROM k UNION ALL SELECT 'http', 'POST', '/j' || k || '/x', 'make' || k, 'Spring MVC', 'jv/S' || k || '.java', 3 FROM k
    UNION ALL SELECT 'kafka', 'consume', 't' || k, 'on' || k, 'Spring Kafka', 'jv/S' || k || '.java', 6 FROM k UNION ALL SELECT 'http', unnest(['GET', 'PUT']), '/p' || k, 'p' || k, 'Python route', 'py/s' || k || '.py', 1 FROM k
    UNION ALL SELECT 'grpc', 'rpc', 'p' || k || '.G/Hello', NULL, 'Protocol Buffers', 'proto/s' || k || '.proto', 4 FROM k UNION ALL SELECT 'graphql', 'query', 'u' || k, NULL, 'GraphQL schema', 'gq/s' || k || '.graphql', 2 FROM k
    UNION ALL SELECT 'http', 'GET', '/o' || k, NULL, 'OpenAPI', 'oa/s' || k || '.yaml', 4 FROM k UNION ALL SELECT 'http', 'DELETE', '/o' || k, NULL, 'OpenAPI', 'oa/s' || k || '.yaml', 6 FROM k
    UNION ALL SELECT 'http', 'GET', '/n' || k, NULL, 'Next.js', 'web/app/(g)/n' || k || '/route.ts', 1 FROM k UNION ALL SELECT 'websocket', 'on', 'm' || k, 'f' || k, 'Socket', 'ws/s' || k || '.ts', 2 FROM k
    UNION ALL SELECT 'websocket', 'emit', 'e' || k, NULL, 'Socket', 'ws/s' || k || '.ts', 3 FROM k UNION ALL SELECT 'sse', 'stream', 'sse/s' || k || '.py', NULL, 'Event stream', 'sse/s' || k || '.py', 1 FROM k),
    e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY address, operation, file) AS nth, greatest(count(*) OVER (PARTITION BY protocol) - 400, 0) AS hidden FROM o) WHERE nth <= 400)"""
_PORTS = """n AS (SELECT n_nationkey AS k FROM nation), p(protocol, port, host_port, declared_as, kind, transport, note, file, line, place) AS (
    SELECT 'tcp', 6000 + k, NULL, NULL, 'listen', NULL, NULL, 'srv/n' || k || '.js', 1, 1 FROM n UNION ALL SELECT 'tcp', 7000 + k, NULL, 'containerPort', 'listen', NULL, NULL, 'k8s/n' || k || '.yaml', 2, 1 FROM n
    UNION ALL SELECT 'http', 80, 8000 + k, NULL, 'published', NULL, 'HTTP', 'compose/n' || k || '/compose.yml', 4, 3 FROM n UNION ALL SELECT 'tcp', 9000 + k, NULL, 'server.port', 'config', NULL, NULL, 'cfg/n' || k || '.properties', 1, 4 FROM n),
    q AS (SELECT * EXCLUDE (place) FROM p ORDER BY place, port, file LIMIT 80)"""

ORACLES = {
    "interface_endpoints": f"WITH {_OFFERED} SELECT protocol, operation, address, handler, framework, 'exact' AS confidence, file, CAST(line AS BIGINT) AS line, hidden FROM e",
    "interface_ports": f"WITH {_PORTS} SELECT * REPLACE (CAST(port AS BIGINT) AS port, CAST(host_port AS BIGINT) AS host_port, CAST(line AS BIGINT) AS line, CAST(transport AS VARCHAR) AS transport) FROM q",
    "interface_summary": f"WITH {_OFFERED}, {_PORTS} SELECT (SELECT count(DISTINCT protocol) FROM o) AS protocols, (SELECT count(*) FROM o) AS endpoints, (SELECT count(*) FROM q) AS ports, (SELECT count(*) FROM q WHERE kind IN ('listen', 'expose')) AS bound",
    "language_imports": f"WITH {_TABLES}, {_FACTS} SELECT path, grp, specifier, CAST(line AS BIGINT) AS line, coalesce(target, '') AS targets, symbol, package, lost AS unresolved_local FROM i",
    "language_symbols": f"WITH {_TABLES} SELECT grp || ':' || name AS symbol, target FROM y",
    "language_module_edges": f"WITH {_TABLES}, {_FACTS}, {_PLACES}, {_REACHED}, {_EDGES} SELECT src, dst, n, sources, CAST(line AS BIGINT) AS line FROM e",
    "language_file_table": f"""
        WITH {_TABLES}, {_FACTS}, {_PLACES}, {_REACHED}, w AS (SELECT DISTINCT path, target FROM x WHERE path <> target), g AS (SELECT path, count(*) AS n FROM w GROUP BY 1), h AS (SELECT target AS path, count(*) AS n FROM w GROUP BY 1)
        SELECT a.path, module, 'source' AS role, language, CAST(lines AS BIGINT) AS lines, coalesce(g.n, 0) AS imports, coalesce(h.n, 0) AS imported_by FROM a LEFT JOIN g ON g.path = a.path LEFT JOIN h ON h.path = a.path
        UNION ALL SELECT 'pr/p' || k || '.prisma', NULL, 'other', 'Other', 14, NULL, NULL FROM t
        UNION ALL SELECT unnest(['jv/pom.xml', 'go/go.mod', 'rust/Cargo.toml', 'da/pubspec.yaml', 'web/package.json', 'doc/package.json']), NULL, 'config', 'Other', 1, NULL, NULL""",
    "language_entities": f"""
        WITH {_TABLES} SELECT 'jpa:jv' AS variant, 'C' || k AS entity, 'table' AS kind, 'c_' || k AS physical, path AS file, CAST(7 AS BIGINT) AS line FROM c
        UNION ALL SELECT 'gorm:go', 'S' || k, 'table', 's' || k || 's', path, 10 FROM s UNION ALL SELECT 'drift:da', 'D' || k, 'table', 'd' || k || 's', 'da/lib/d' || k || '.dart', 5 FROM t
        UNION ALL SELECT 'typeorm:web', 'E' || k, 'table', 'e_' || k, 'web/e' || k || '.ts', 3 FROM t UNION ALL SELECT 'mongoose:doc', 'M' || k, 'collection', 'c' || k, 'doc/m' || k || '.js', 2 FROM t
        UNION ALL SELECT 'mongoengine:.', 'W' || k, 'collection', 'w' || k, 'py/m' || k || '.py', 4 FROM t UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'Kind', 'enum', 'Kind', 'pr/p' || k || '.prisma', 1 FROM t
        UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'P' || k, 'model', 'p_' || k, 'pr/p' || k || '.prisma', 5 FROM t UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'Q' || k, 'model', 'Q' || k, 'pr/p' || k || '.prisma', 11 FROM t""",
    "language_fields": f"""
        WITH {_TABLES}, o(variant, entity, file, pos, field, stored, type, pk, uniq, nullable, generated, related, inferred) AS (
        SELECT 'jpa:jv', 'C' || k, path, 10, 'id', {_NONE}, 'Long', {_YES}, {_OPEN}, {_OPEN}, {_YES}, {_NO}, {_NO} FROM c UNION ALL SELECT 'jpa:jv', 'C' || k, path, 11, 'name', NULL, 'String', {_NO}, NULL, NULL, {_NO}, {_NO}, {_YES} FROM c
        UNION ALL SELECT 'jpa:jv', 'C' || k, path, 13, 'nation', NULL, 'N' || n, {_NO}, NULL, NULL, {_NO}, {_YES}, {_NO} FROM c UNION ALL SELECT 'jpa:jv', 'C' || k, path, 15, 'balance', 'b_' || k, 'int', {_NO}, NULL, {_NO}, {_NO}, {_NO}, {_NO} FROM c
        UNION ALL SELECT 'gorm:go', 'S' || k, path, 11, v.f, NULL, v.t, v.f = 'ID', NULL, NULL, {_YES}, NULL, NULL FROM s, (VALUES ('ID', 'uint'), ('CreatedAt', 'time.Time'), ('UpdatedAt', 'time.Time'), ('DeletedAt', 'gorm.DeletedAt')) v(f, t)
        UNION ALL SELECT 'gorm:go', 'S' || k, path, 12, 'Name', 'nm', 'string', {_NO}, NULL, {_NO}, {_NO}, {_NO}, NULL FROM s UNION ALL SELECT 'gorm:go', 'S' || k, path, 13, 'Pals', NULL, '[]S' || k, {_NO}, NULL, NULL, {_NO}, {_YES}, NULL FROM s
        UNION ALL SELECT 'drift:da', 'D' || k, 'da/lib/d' || k || '.dart', 6, 'code', NULL, 'IntColumn', {_YES}, NULL, NULL, {_NO}, {_YES}, NULL FROM t
        UNION ALL SELECT 'typeorm:web', 'E' || k, 'web/e' || k || '.ts', 5, 'id', NULL, 'number', {_YES}, NULL, NULL, {_YES}, {_NO}, {_NO} FROM t UNION ALL SELECT 'typeorm:web', 'E' || k, 'web/e' || k || '.ts', 7, 'code', NULL, 'string', {_NO}, {_YES}, NULL, {_NO}, {_NO}, {_NO} FROM t
        UNION ALL SELECT 'typeorm:web', 'E' || k, 'web/e' || k || '.ts', 9, 'next', NULL, 'E' || m, {_NO}, NULL, NULL, {_NO}, {_YES}, {_NO} FROM t
        UNION ALL SELECT 'mongoose:doc', 'M' || k, 'doc/m' || k || '.js', v.p, v.f, NULL, v.t, {_NO}, NULL, CASE v.f WHEN 'name' THEN {_NO} END, NULL, v.f = 'next', NULL FROM t,
                  (VALUES (1, 'name', 'String'), (2, 'place', 'object'), (3, 'place.town', 'object'), (4, 'place.town.code', 'Number'), (5, 'tags', 'String[]'), (6, 'next', 'ObjectId')) v(p, f, t)
        UNION ALL SELECT 'mongoengine:.', 'W' || k, 'py/m' || k || '.py', 5, 'title', NULL, 'StringField', {_NO}, {_YES}, NULL, NULL, {_NO}, NULL FROM t UNION ALL SELECT 'mongoengine:.', 'W' || k, 'py/m' || k || '.py', 6, 'next', NULL, 'ReferenceField', {_NO}, NULL, NULL, NULL, {_YES}, NULL FROM t
        UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'Kind', 'pr/p' || k || '.prisma', v.p, v.f, NULL, 'enum value', NULL, NULL, NULL, NULL, NULL, NULL FROM t, (VALUES (2, 'A'), (3, 'B')) v(p, f)
        UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'P' || k, 'pr/p' || k || '.prisma', v.p, v.f, NULL, v.t || CASE v.f WHEN 'kids' THEN k || '[]' ELSE '' END, v.f = 'id', {_NO}, {_NO}, v.f = 'id', v.f <> 'id', NULL FROM t, (VALUES (6, 'id', 'Int'), (7, 'kind', 'Kind'), (8, 'kids', 'Q')) v(p, f, t)
        UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'Q' || k, 'pr/p' || k || '.prisma', 12, 'id', NULL, 'Int', {_YES}, {_NO}, {_NO}, {_NO}, {_NO}, NULL FROM t UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'Q' || k, 'pr/p' || k || '.prisma', 13, 'top', NULL, 'P' || k, {_NO}, {_NO}, {_YES}, {_NO}, {_YES}, NULL FROM t)
        SELECT * REPLACE (CAST(pos AS BIGINT) AS pos) FROM o""",
    "language_relations": f"""
        WITH {_TABLES} SELECT 'jpa:jv' AS variant, 'C' || k AS entity, path AS file, CAST(13 AS BIGINT) AS line, 'nation' AS field, 'N' || n AS target, 'one' AS kind, {_NONE} AS name, 'unresolved' AS confidence, 'missing' AS state FROM c
        UNION ALL SELECT 'gorm:go', 'S' || k, path, 13, 'Pals', 'S' || k, 'many', NULL, 'exact', 'resolved' FROM s UNION ALL SELECT 'drift:da', 'D' || k, 'da/lib/d' || k || '.dart', 6, 'code', 'D' || m, 'one', NULL, 'exact', 'resolved' FROM t
        UNION ALL SELECT 'typeorm:web', 'E' || k, 'web/e' || k || '.ts', 9, 'next', 'E' || m, 'one', NULL, 'exact', 'resolved' FROM t UNION ALL SELECT 'mongoose:doc', 'M' || k, 'doc/m' || k || '.js', 6, 'next', 'M' || m, 'one', NULL, 'exact', 'resolved' FROM t
        UNION ALL SELECT 'mongoengine:.', 'W' || k, 'py/m' || k || '.py', 6, 'next', 'W' || m, 'one', NULL, 'exact', 'resolved' FROM t UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'P' || k, 'pr/p' || k || '.prisma', 7, 'kind', 'Kind', 'one', NULL, 'exact', 'resolved' FROM t
        UNION ALL SELECT 'prisma:pr/p' || k || '.prisma', 'Q' || k, 'pr/p' || k || '.prisma', 13, 'top', 'P' || k, 'one', 'k', 'exact', 'resolved' FROM t""",
    "language_placeholders": "SELECT DISTINCT 'jpa:jv' AS variant, 'N' || c_nationkey AS entity FROM customer",
    "language_flow_edges": f"""
        WITH {_TABLES}, u AS (SELECT k, path, replace(path, '/', '%2F') AS q FROM s)
        SELECT path AS unit, 'callable:' || q || ':16' AS src, 'decision:' || q || ':17' AS dst, 'fork' AS kind, '' AS label FROM u UNION ALL SELECT path, 'decision:' || q || ':17', 'callable:' || q || ':24', 'call', 'Yes' FROM u
        UNION ALL SELECT path, 'decision:' || q || ':17', 'io:' || q || ':db.Query', 'io', 'No' FROM u""",
    "language_module_ranks": f"""
        WITH RECURSIVE {_TABLES}, {_FACTS}, {_PLACES}, {_REACHED}, {_EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
        g AS (SELECT node, least(node, coalesce(min(r1.b) FILTER (r2.a IS NOT NULL), node)) AS root FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) l LEFT JOIN r r1 ON r1.a = node LEFT JOIN r r2 ON r2.a = r1.b AND r2.b = node GROUP BY node),
        d AS (SELECT DISTINCT v.root AS a, w.root AS b FROM e JOIN g v ON v.node = src JOIN g w ON w.node = dst WHERE v.root <> w.root), o(n, k) AS (SELECT DISTINCT root, 0::BIGINT FROM g UNION SELECT b, k + 1 FROM o JOIN d ON a = n)
        SELECT node, root, max(k) AS rank FROM g JOIN o ON n = root GROUP BY 1, 2""",
    "language_boundaries": f"""
        WITH {_TABLES}, u AS (SELECT path, replace(path, '/', '%2F') AS q FROM s)
        SELECT path AS unit, 'boundary:' || q || ':start' AS src, 'callable:' || q || ':16' AS dst, 'starts' AS kind FROM u UNION ALL SELECT path, 'callable:' || q || ':24', 'boundary:' || q || ':end', 'finishes' FROM u
        UNION ALL SELECT path, 'io:' || q || ':db.Query', 'boundary:' || q || ':end', 'finishes' FROM u""",
}
