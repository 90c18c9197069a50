"""Ranked lists, look-ups, counters and field texts on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import fields
from weft.operators import flow, graph, modules, reports
from weft.sources.files import FILES


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("a", "module", "Alpha", "x"), ("b", "module", "beta", "x"), ("c", "module", "Gamma", "y"), ("d", "module", "Delta", "y"), ("p", "external", "pack", "y")]
    return spark.createDataFrame(rows, "id string, kind string, label string, area string")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "exact", 3), ("b", "a", "inferred", 1), ("a", "a", "exact", 9), ("b", "c", "unresolved", 2), ("a", "p", "exact", 5)]
    return spark.createDataFrame(rows, "src string, dst string, confidence string, n long")


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_lists(spark, nodes, edges):
    assert rows(reports.hotspots(edges, 2)) == [("a", 1, 8), ("b", 3, 3)]
    uses = spark.createDataFrame([("f", "q"), ("g", "q"), ("g", "r"), ("g", None)], "path string, package string")
    assert rows(reports.dependencies(uses)) == [("q", 2, 2), ("r", 1, 1)]
    assert rows(reports.legend(nodes)) == [("module", 4), ("external", 1)]
    assert [r.label for r in reports.suggestions(nodes, limit=3).collect()] == ["Alpha", "Delta", "Gamma"]
    assert [r.label for r in reports.suggestions(nodes, "PAC").collect()] == ["pack"]
    assert [r.id for r in reports.search(nodes, "\uff22eta", "label", "kind").collect()] == ["b"]  # a wide B
    assert reports.focus(nodes, edges).first().id == "a" and reports.focus(nodes, edges, "p").first().id == "p"
    assert rows(reports.focus_counts(edges, "a")) == [(1, 2)]
    assert sorted(rows(reports.relations_of(nodes, edges, "a"))) == [("in", "b", "beta"), ("out", "a", "Alpha"), ("out", "b", "beta"), ("out", "p", "pack")]
    frames = nodes.select("id", F.col("area").alias("frame"))
    assert rows(reports.frame_pairs(edges, frames)) == [("x", "y", 2)]
    views = {"one": nodes.where("id = 'c'").withColumn("scope", F.col("area")), "two": nodes.withColumn("scope", F.lit("whole"))}
    assert rows(reports.lookup(views, "c")) == [("one", "c", "Gamma")] and rows(reports.hand_off(views, "a")) == [("two", "a", "Alpha", "whole")]
    told = spark.createDataFrame([("CODE", "warning", "text")], "code string, severity string, message string")
    assert sorted(rows(reports.review(nodes, edges, told, limit=1))) == [("diagnostics", "CODE text", 0), ("isolated", "Delta", 0), ("links", "inferred b a", 1)]
    assert sorted(rows(reports.scope_counts({"s": (nodes, edges), "t": (nodes, edges.limit(0))}, told))) == [("s", 5, 5, 1), ("t", 5, 0, 1)]
    assert [reports.uses_areas(nodes, n).first()[0] for n in (4, 5)] == [True, False]


def test_models_and_flows(spark):
    entities = spark.createDataFrame([("x", "table"), ("x", "collection"), ("y", "collection"), ("y", "embedded"), ("y", "table")], "area string, kind string")
    assert sorted(rows(reports.nouns(entities))) == [("x", "table"), ("y", "collection")]
    own = spark.createDataFrame([("v", "E", "id", True), ("v", "E", "to", False), ("v", "T", "id", True)], "variant string, entity string, field string, pk boolean")
    links = spark.createDataFrame([("v", "E", "to", "T")], "variant string, entity string, field string, target string")
    assert sorted(rows(reports.key_columns(own, links))) == [("v", "E", "id"), ("v", "E", "to"), ("v", "T", "id")]
    assert rows(reports.largest_entities(own, links)) == [("v", "E", 2, 1), ("v", "T", 1, 1)]
    ends = spark.createDataFrame([("http", "Spring"), ("http", "Express"), ("http", "Spring")], "protocol string, framework string")
    assert rows(reports.frameworks(ends)) == [("http", ["Express", "Spring"])]
    table = spark.createDataFrame([("http", f"/{i}", "GET", "f", 2) for i in range(5)], "protocol string, address string, operation string, file string, hidden long")
    assert {(r.address, r.hidden) for r in reports.endpoint_rows(table, 3).collect()} == {("/0", 4), ("/1", 4), ("/2", 4)}
    nodes = spark.createDataFrame([("u", "1", "decision"), ("u", "2", "step"), ("w", "3", "step"), ("w", "4", "step")], "unit string, id string, kind string")
    drawn = spark.createDataFrame([("u", "1", "2"), ("w", "3", "4"), ("w", "4", "3")], "unit string, src string, dst string")
    assert reports.recommended_flow(nodes, drawn).first().unit == "u" and reports.recommended_flow(nodes, drawn, most=1).first().unit == "w"
    units = flow.units(nodes, drawn)
    assert reports.flow_unit(units, "w").first().unit == "w" and reports.flow_unit(units, "none").first().unit == "u"
    found = spark.createDataFrame([("a/b/db", ), ("c/b/db",), ("x/z",), ("db",)], "area string")
    assert dict(rows(reports.apart(found))) == {"a/b/db": "a/b/db", "c/b/db": "c/b/db", "x/z": "z", "db": "db"}
    files = spark.createDataFrame([("s/a.ts", "TypeScript"), ("s/b.py", "Python"), ("s/t/c.py", "Python"), ("q/a.py", "Python"), ("q/b.go", "Go")], "path string, language string")
    assert dict(rows(reports.folder_languages(files))) == {"s": "Python", "s/t": "Python", "q": "Go"}
    placed = spark.createDataFrame([("apps/a/x.ts", "apps/a")], "path string, module string")
    assert rows(reports.node_ids(placed)) == [("apps/a/x.ts", "module:apps%2Fa", "file:apps%2Fa%2Fx.ts")]
    sizes = spark.createDataFrame([("apps/a", 3), ("apps/b", 1), ("lib", 9)], "module string, files long")
    assert rows(reports.module_groups(sizes)) == [("lib", 1, 9), ("apps/a", 1, 3), ("apps/b", 1, 1)]


def test_fields_as_text_and_back(spark):
    given = [("id", "id", "int", True, False, False), ("name", "full_name", "varchar(9)", False, True, None), ("x", None, None, False, False, True), ("y", "y", "a: b", False, False, None)]
    frame = spark.createDataFrame(given, "name string, stored string, type string, pk boolean, uniq boolean, nullable boolean")
    text = fields.field_text(*(F.col(c) for c in frame.columns))
    got = rows(frame.select(text.alias("t")))
    assert [t for t, in got] == ["id: int [PK, NOT NULL]", "name -> full_name: varchar(9) [UNIQUE]", "x [NULL]", "y: a: b"]
    back = rows(frame.select(fields.parsed_field(text).alias("f")).select("f.*"))
    assert back == [(n, s or n, k, p, u, m, False, False, False) for n, s, k, p, u, m in given]
    told = {"a: int [PK, GENERATED, RELATION, INFERRED]": ("a", "a", "int", True, False, None, True, True, True), "b: char [10]": ("b", "b", "char [10]", False, False, None, False, False, False), "": ("", "", None, False, False, None, False, False, False)}
    texts = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r.t: tuple(r.f) for r in texts.select("t", fields.parsed_field(F.col("t")).alias("f")).collect()} == told
    one = spark.range(1)
    assert one.select(fields.file_name(F.lit("My Schema (v2)"))).first()[0] == "my-schema-v2.md" and one.select(fields.file_name(F.lit("--"))).first()[0] == "schema.md"
    assert one.select(fields.anchor(F.lit("Orders & Items (2)"))).first()[0] == "orders--items-2" and one.select(fields.mermaid(F.lit("a.b c"))).first()[0] == "a_b_c"
    maps = [F.create_map(F.lit("a"), F.lit("1"), F.lit("Fields"), F.lit("")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit(""))]
    assert one.select(fields.told(*maps)).first()[0] == {"a": "2", "Fields": ""}


def test_flow_of_a_project_and_its_ends(spark):
    sizes = spark.createDataFrame([(f"src/{a}/{i}", 2) for a in "ab" for i in range(10)], "module string, files long")
    links = spark.createDataFrame([("src/a/1", "src/b/1", 4), ("src/a/2", "src/b/1", 1), ("src/a/1", "src/a/2", 7)], "src string, dst string, n long")
    nodes, edges = flow.project_flow(sizes, links)
    assert {(r.label, r.modules, r.files) for r in nodes.collect()} == {("src/a", 10, 20), ("src/b", 10, 20)}
    assert rows(edges) == [("src/a", "src/b", 2)]
    few = flow.project_flow(sizes.where("module LIKE 'src/a%'"), links)
    assert few[0].count() == 10 and rows(few[1]) == [("src/a/1", "src/a/2", 7)]
    drawn = spark.createDataFrame([("u", "1", "2", "call", ""), ("u", "2", "3", "call", "")], "unit string, src string, dst string, kind string, label string")
    own = spark.createDataFrame([("u", str(i), k, str(i), i) for i, k in ((1, "step"), (2, "step"), (3, "io"), (4, "step"), (5, "entry"))], "unit string, id string, kind string, label string, line int")
    places = {(r.id, r.position) for r in flow.degrees_of_flow(own, drawn).collect()}
    assert places == {("1", "start"), ("5", "start"), ("3", "end")}
    more_nodes, more_edges = flow.with_boundaries(own, drawn)
    assert {r.kind for r in more_nodes.collect()} >= {"flow-start", "flow-end"} and more_edges.count() == 5
    units = {(r.kind, r.unit): r.files for r in flow.all_units(own, drawn, spark.createDataFrame([("u", "m")], "path string, module string"), "p", (sizes.limit(1), links.select("src", "dst"))).collect()}
    assert units == {("project", "p"): 2, ("service", "m"): 1, ("file", "u"): 1}
    assert [r.code for r in flow.diagnostics(own, limit=0).collect()] == ["FLOW_STATIC_HEURISTIC", "FLOW_FILE_LIMIT"]


def test_areas_by_path_and_crossings(spark):
    one = spark.createDataFrame([("src/a",), ("src/b",)], "path string")
    assert {r.area for r in graph.path_areas(one, "path").collect()} == {"src/a", "src/b"}
    two = spark.createDataFrame([("src/a",), ("apps/b/c",)], "path string")
    assert {r.area for r in graph.path_areas(two, "path").collect()} == {"src", "apps/b"}
    rng = random.Random(3)
    given = [(rng.randrange(3), rng.randrange(70), rng.randrange(70)) for _ in range(200)]
    expected = {c: sum(a[1] < b[1] and a[2] > b[2] for a in given for b in given if a[0] == b[0] == c) for c in range(3)}
    assert {r.column: r.n for r in graph.crossings(spark.createDataFrame(given, "column int, top int, bottom int")).collect()} == expected


def test_technologies(spark):
    files = {
        "go.mod": "module x\nrequire github.com/labstack/echo/v4 v4\n", "app/pubspec.yaml": "dependencies:\n  flutter_bloc: 1\n  flutter:\n    sdk: flutter\n", "Cargo.toml": "", "pom.xml": "",
        "package.json": '{"workspaces": ["a"]}', "Dockerfile.dev": "", "q.sql": "", "a.py": "import fastapi\nfrom sqlalchemy import x\n", "M.java": "import jakarta.persistence.Id;\n",
    }
    frame = spark.createDataFrame([(p, c, len(c)) for p, c in files.items()], FILES)
    needs = spark.createDataFrame([("p", "drizzle-orm"), ("p", "left-pad")], "path string, dependency string")
    assert {r.technology for r in modules.technologies(frame, needs).collect()} == {
        "Go modules", "Echo", "Bloc", "Flutter", "Cargo", "JVM build", "JavaScript monorepo", "Docker", "SQL", "Python", "FastAPI", "SQLAlchemy", "Java", "JPA", "Drizzle ORM",
    }
