from __future__ import annotations

import pytest

from weft.fixture import SOURCES, workspace_files
from weft.operators import areas, flow, imports, interfaces, modules, schema
from weft.plans.schema_document import cell, schema_document, write_schema_document
from weft.plans.workspace import Workspace
from weft.sources import files as source_files
from weft.sources.files import FILES


@pytest.fixture(scope="module")
def workspace(spark):
    return Workspace(spark, workspace_files(spark))


def table(spark, sources: dict[str, str]):
    return spark.createDataFrame([(p, c, len(c.encode())) for p, c in sources.items()], FILES)


def resolved(spark, sources):
    frame = table(spark, sources)
    found = imports.resolved(imports.imports(frame), frame)
    return {(r.path, r.specifier): r for r in imports.expanded(found, imports.symbol_files(frame)).collect()}


def test_imports_of_the_fixture(workspace):
    found = {(r.path, r.specifier): r for r in workspace.import_targets().collect()}
    assert found["src/ui/Deck.tsx", "../api/ships"].targets == ["src/api/ships.ts"]
    assert found["src/ui/Deck.tsx", "../api/ships"].line == 4  # the specifier's own line
    assert found["src/api/ships.ts", "./gone"].unresolved_local
    assert found["src/ui/Deck.tsx", "react"].package == "react"
    assert found["go/cmd/api/main.go", "example.com/shop/internal/store"].targets == ["go/internal/store/store.go"]
    assert found["go/cmd/api/main.go", "github.com/gin-gonic/gin"].package == "github.com/gin-gonic/gin"
    assert found["go/cmd/api/main.go", "fmt"].package is None
    assert found["app/views.py", ".models"].targets == ["app/models.py"]


def test_module_edges_and_inventory(workspace):
    edges = {(r.src, r.dst): r.n for r in workspace.module_edges.collect()}
    assert edges == {("src/ui", "src/api"): 1, ("src/api", "src/domain"): 1, ("go/cmd/api", "go/internal/store"): 1}
    ids = {r.id: r for r in workspace.modules.collect()}
    assert "module:src%2Fapi" in ids and ids["module:app"].languages == ["Python"] and ids["module:app"].files == 3
    uses = {(r.package, r.module): r.module_n for r in workspace.externals.collect()}
    assert uses["django", "app"] == 1 and uses["mongoose", "src/documents"] == 1


def test_file_table_and_reports(workspace):
    rows = {r.path: r for r in workspace.file_table.collect()}
    assert rows["app/test_views.py"].role == "test" and rows["package.json"].role == "config"
    assert rows["go/cmd/api/main.go"].role == "source"  # three folders below its project
    assert rows["src/api/ships.ts"].imported_by == 1 and rows["package.json"].imports is None
    assert rows["src/domain/ship.ts"].lines == 1
    lists = modules.reports(workspace.file_table)
    assert [r.path for r in lists["load_bearing"].collect()][0] == "app/models.py"
    assert "app/views.py" not in {r.path for r in lists["untested"].collect()}


def test_other_languages(spark):
    found = resolved(
        spark,
        {
            "jv/src/a/C.java": "package a;\nimport a.b.*;\nimport java.util.List;\nimport org.springframework.boot.App;\n",
            "jv/src/a/b/D.java": "package a.b;\n", "jv/src/a/b/c/E.kt": "package a.b.c\n",
            "rs/src/main.rs": "mod store;\nuse crate::store::Thing;\nuse serde::Deserialize;\nuse std::io;\n", "rs/src/store.rs": "",
            "c/include/k/v.h": "", "c/m.c": '#include <vector>\n// #include "no.h"\n#include "k/v.h"\n#include <boost/asio.hpp>\n',
            "d/pubspec.yaml": "name: dd\n", "d/lib/x.dart": "import 'package:dd/y.dart';\nimport 'package:flutter/m.dart';\n", "d/lib/y.dart": "",
            "Sources/Core/a.swift": "import Foundation\nimport Alamofire\n", "Sources/App/b.swift": "@testable import Core\n",
            "x.cs": "using System.Text;\nusing My.Ns;\nusing Newton.Json.Linq;\n", "y.cs": "namespace My.Ns;\n",
            "p/a.php": "<?php\nuse R\\S\\T;\nrequire './b.php';\n", "p/b.php": "<?php\n", "p/T.php": "<?php\nnamespace R\\S;\n",
            "r/lib/foo.rb": "require_relative 'bar'\nrequire 'json'\nrequire 'active_support/core'\n", "r/lib/bar.rb": "",
        },
    )
    targets = {k[1]: r.targets for k, r in found.items() if r.targets}
    assert targets["a.b.*"] == ["jv/src/a/b/D.java", "jv/src/a/b/c/E.kt"]
    assert targets["self::store"] == targets["crate::store::Thing"] == ["rs/src/store.rs"]
    assert targets["./k/v.h"] == ["c/include/k/v.h"] and targets["package:dd/y.dart"] == ["d/lib/y.dart"]
    assert targets["Core"] == ["Sources/Core/a.swift"] and targets["My.Ns"] == ["y.cs"]
    assert targets["R\\S\\T"] == ["p/T.php"] and targets["./b.php"] == ["p/b.php"] and targets["./bar"] == ["r/lib/bar.rb"]
    packages = {r.package for r in found.values() if r.package}
    assert packages == {"org.springframework.boot", "serde", "boost", "flutter", "Alamofire", "Newton.Json", "active_support"}
    assert "./no.h" not in {k[1] for k in found}


def test_order_of_files_does_not_matter(spark):
    frame = workspace_files(spark)
    turned = frame.orderBy("path", ascending=False).repartition(5)
    for make in (imports.imports, lambda f: schema.data_model(f)[0], interfaces.endpoints):
        assert sorted(map(repr, make(frame).collect())) == sorted(map(repr, make(turned).collect()))


def test_endpoints_and_ports(workspace):
    rows = {(r.operation, r.address): r for r in workspace.endpoints.collect()}
    assert rows["GET", "/ships/:id"].handler == "find"
    assert rows["GET", "/crews"].handler == "crews" and rows["GET", "/ping"].handler == "ping"
    assert rows["rpc", "Greeter/Hello"].protocol == "grpc"
    ports = {(r.port, r.kind): r for r in workspace.ports.collect()}
    assert ports[5432, "expose"].note == "PostgreSQL" and ports[9092, "expose"].protocol == "kafka"
    assert ports[80, "published"].host_port == 8080


def test_handlers_have_a_limit(spark):
    far = "@app.get('/far')\n" + "\n" * 7 + "def far():\n  pass\n"
    rows = interfaces.endpoints(table(spark, {"a.py": far, "b.py": "@app.get('/near')\ndef near():\n  pass\n"})).collect()
    assert {r.address: r.handler for r in rows} == {"/far": None, "/near": "near"}


def test_a_path_above_a_class_is_a_prefix(spark):
    text = '@RequestMapping("/api")\npublic class A {\n  @GetMapping("/x")\n  public String x() {\n  }\n}\n'
    assert [r.address for r in interfaces.endpoints(table(spark, {"A.java": text})).collect()] == ["/api/x"]


def test_a_port_takes_the_protocol_of_its_file(spark):
    frame = table(spark, {"a.js": "app.get('/x', x);\napp.listen(5432);\n", "b.js": "srv.listen(6000);\n"})
    rows = {r.port: r for r in interfaces.ports(frame, interfaces.endpoints(frame)).collect()}
    assert rows[5432].protocol == "http" and rows[5432].note == "PostgreSQL"
    assert rows[6000].protocol == "tcp"


def test_flow_forks_only_where_a_call_is_drawn(workspace):
    nodes = [r for r in workspace.flow_nodes.collect() if r.unit == "src/api/ships.ts"]
    assert {(r.kind, r.label) for r in nodes} == {("step", "load"), ("step", "fail"), ("decision", "id"), ("io", "db.query")}
    edges = {(r.kind, r.label) for r in workspace.flow_edges.collect() if r.unit == "src/api/ships.ts"}
    assert edges == {("fork", ""), ("io", "Yes"), ("call", "No")}
    assert workspace.flow_units.first().unit == "src/api/ships.ts" or workspace.flow_units.count() > 3


def test_extents_and_decisions(spark):
    frame = table(spark, {"a.js": "function one() {\n  if (x) {\n  two();\n  }\n}\nfunction two() {\n}\n"})
    rows = interfaces.lines(frame)
    assert {(r.name, r.start, r.until) for r in flow.extents_of(rows).collect()} == {("one", 1, 5), ("two", 6, 8)}
    assert [(r.label, r.name) for r in flow.decisions(rows).collect()] == [("x", "one")]


def test_data_model_of_the_fixture(workspace):
    entities = {r.entity: r for r in workspace.entities.collect()}
    assert set(entities) == {"Ship", "Cargo", "orders", "customers", "Crew", "Sailor", "Voyage", "Berth"}
    assert entities["Ship"].physical == "ships" and entities["Voyage"].physical == "voyage_book" and entities["Berth"].kind == "embedded"
    fields = {(r.entity, r.field): r for r in workspace.fields.collect()}
    assert fields["Ship", "email"].nullable and fields["Ship", "email"].uniq and fields["orders", "price"].nullable is False
    assert fields["customers", "id"].pk and fields["customers", "name"].nullable is None and fields["Crew", "id"].pk
    state = {(r.entity, r.field): (r.target, r.state) for r in workspace.relations.collect()}
    assert state["orders", "customer_id"] == ("customers", "resolved") and state["Sailor", "crew"] == ("Crew", "resolved")
    assert state["Voyage", "harbour"] == ("Harbour", "missing") and state["Voyage", "where"] == ("berth", "resolved")
    assert [r.entity for r in schema.placeholders(workspace.relations).collect()] == ["Harbour"]


def test_names_that_several_entities_answer_to_are_ambiguous(spark):
    frame = table(spark, {"a.sql": "create table a.t (id int);\ncreate table b.t (id int);\ncreate table u (x int references t(id), y int references a.t(id));\n"})
    rows = {r.field: r.state for r in schema.data_model(frame)[2].collect()}
    assert rows == {"x": "ambiguous", "y": "resolved"}


def test_inverse_relations_are_suppressed(spark, workspace):
    kept = {(r.entity, r.field) for r in schema.without_inverses(workspace.relations).collect()}
    assert ("Cargo", "carrier") in kept and ("Ship", "cargoes") not in kept


def test_readers_of_classes_and_structs(spark):
    entities, fields, relations = schema.data_model(
        table(
            spark,
            {
                "u.ts": "import { Entity } from 'typeorm';\n@Entity('people')\nexport class Person {\n  @PrimaryColumn()\n  id: number;\n  @OneToMany(() => Pet, (p) => p.owner)\n  pets: Pet[];\n}\n@Entity()\nclass Pet {\n  @ManyToOne(() => Person)\n  owner: Person;\n}\nclass Other {\n  x: number;\n}\n",
                "B.java": '@Entity\n@Table(name = "books")\npublic class Book {\n  @Id\n  private Long id;\n  @ManyToOne\n  private Author author;\n}\n',
                "m.go": 'package m\nimport "gorm.io/gorm"\ntype Shop struct {\n\tID uint `gorm:"primaryKey"`\n\tItems []Item\n}\ntype Item struct {\n\tName *string\n}\n',
                "t.dart": "import 'package:drift/drift.dart';\nclass Todos extends Table {\n  IntColumn get cat => integer().references(Cats, #id)();\n}\n",
                "e.py": "from mongoengine import Document, StringField\nclass Page(Document):\n    title = StringField(required=True)\n    owner = ReferenceField('User')\n",
            },
        )
    )
    assert {(r.entity, r.physical) for r in entities.collect()} == {("Person", "people"), ("Pet", "pet"), ("Book", "books"), ("Shop", "shops"), ("Item", "items"), ("Todos", "todoses"), ("Page", "page")}
    assert {(r.entity, r.field, r.target, r.kind) for r in relations.collect()} == {
        ("Person", "pets", "Pet", "many"), ("Pet", "owner", "Person", "one"), ("Book", "author", "Author", "one"), ("Shop", "Items", "Item", "many"), ("Todos", "cat", "Cats", "one"), ("Page", "owner", "User", "one"),
    }
    assert {(r.entity, r.field) for r in fields.where("pk").collect()} == {("Person", "id"), ("Book", "id"), ("Shop", "ID")}


def test_small_areas_fold_and_two_remain(spark):
    fold = lambda sizes: {r.area: r.folded for r in areas.fold_small(spark.createDataFrame(list(sizes.items()), "area string, n long")).collect()}
    assert set(fold({"a/b": 1, "a/b/c": 2, "a/b/d": 2, "a": 5}).values()) == {"a", "a/b"}
    grown = fold({"a/b": 3, "a/b/c": 1, "z": 9, "y": 9})
    assert grown["a/b/c"] == "a/b" and grown["a/b"] == "a/b"
    assert fold({"x/y": 1, "x/z": 1}) == {"x/y": "x/y", "x/z": "x/z"}


def test_tree_rows(spark, workspace):
    rows = areas.tree_rows(workspace.tree).collect()
    paths = [r.path for r in rows]
    assert paths.index("src") < paths.index("src/api") < paths.index("src/api/ships.ts") < paths.index("package.json")
    assert {r.path: r.files for r in rows}["src"] == 5
    found = areas.tree_rows(workspace.tree, "SHIPS").collect()
    assert [r.path for r in found] == ["src", "src/api", "src/api/ships.controller.ts", "src/api/ships.ts"]
    assert areas.tree_rows(workspace.tree, limit=3).first().left_out == len(rows) - 3


def test_document_and_views(spark, workspace, tmp_path):
    texts = schema_document(workspace.entities, workspace.fields, workspace.relations)
    whole = "\n".join(r.markdown for r in texts.collect())
    assert "### orders" in whole and "| price | decimal(10,2) | NOT NULL |" in whole and "→ Harbour (one, missing)" in whole
    assert spark.range(1).select(cell(__import__("pyspark").sql.functions.lit("a|b\nc"))).first()[0] == "a\\|b c"
    write_schema_document(texts, str(tmp_path / "doc"))
    assert "### orders" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "doc")).collect())
    with pytest.raises(ValueError):
        write_schema_document(texts.limit(0), str(tmp_path / "none"))
    parts = {(r.part, r.area): r.markdown for r in workspace.document().collect()}
    assert parts[0, None].startswith("# Data model\n\n8 entities in ") and "](#" in parts[0, None]
    assert "Voyage.harbour → Harbour (missing)" in parts[3, None] and "Voyage.harbour names Harbour" in parts[4, None]
    assert any('Sailor }o--|| Crew : "crew"' in text for (part, _), text in parts.items() if part == 2)
    assert {r.view: r.uses_areas for r in workspace.shown_by_areas().collect()} == {"modules": False, "entities": False}
    assert workspace.query("SELECT count(*) AS n FROM module_edges").first().n == 3
    one = workspace.stats().first()
    assert one.files == len(SOURCES) and one.entities == 9 and one.modules == 7
    assert {"Django", "React", "TypeScript", "Prisma", "Mongoose"} <= {r.technology for r in workspace.technologies.collect()}
    assert {r.code for r in workspace.diagnostics.collect()} == {"LOCAL_IMPORTS_UNRESOLVED", "DB_RELATION_UNRESOLVED", "FLOW_STATIC_HEURISTIC"}
    assert {r.area: r.internal for r in workspace.area_map().collect()}["src"] == 2


def test_scan_reads_what_it_should(spark, tmp_path, monkeypatch):
    for path, text in {"a.py": "x = 1\n", "b/.env.local": "S=1", "b/c.txt": "no", "node_modules/m.js": "no", "big.sql": "x" * 20_000, "Dockerfile.dev": "FROM x\n", "skip/me.py": ""}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    files, told = source_files.scan(spark, {"w": f"file://{tmp_path}"}, ["skip/**"], max_kb=16)
    assert {(r.path, r.content, r.size) for r in files.collect()} == {("a.py", "x = 1\n", 6), ("big.sql", "", 20_000), ("Dockerfile.dev", "FROM x\n", 7)}
    assert [r.code for r in told.collect()] == ["FILE_SIZE_LIMIT"]
    paths = files.select("path")
    assert source_files.unreadable(paths, paths.where("path <> 'a.py'")).first().code == "UNREADABLE_FILE"
    monkeypatch.setattr(source_files, "MAX_FILES", (1, 2, 2))
    files, told = source_files.scan(spark, {"w": f"file://{tmp_path}", "v": f"file://{tmp_path}"})
    assert [r.path for r in files.orderBy("path").collect()] == ["v/Dockerfile.dev", "v/a.py"]
    assert "SCAN_LIMIT_REACHED" in {r.code for r in told.collect()}
    again = Workspace.read(spark, f"file://{tmp_path}")
    assert again.files.count() == 2
    every, told = source_files.scan(spark, {"w": f"file://{tmp_path}", "v": f"file://{tmp_path}"}, max_files=source_files.ALL)
    assert every.count() == 6 and "SCAN_LIMIT_REACHED" not in {r.code for r in told.collect()}
    monkeypatch.setattr(source_files, "MAX_FILES", (1, 10_000, 20_000))


def test_only_kept_files_are_opened(spark, tmp_path):
    for path in ("a.ts", "b.TS", "c.bin", "sub/Dockerfile", "sub/dockerfile.dev", "z/GO.MOD", "x.env"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(path)
    files, _ = source_files.scan(spark, {"w": f"file://{tmp_path}"}, max_files=source_files.ALL)
    assert {r.content for r in files.collect()} == {"a.ts", "b.TS", "sub/Dockerfile", "sub/dockerfile.dev", "z/GO.MOD"}
    few, _ = source_files.scan(spark, {"w": f"file://{tmp_path}"}, max_files=100)
    plan = few._jdf.queryExecution().toString()
    assert few.count() == 5 and "c.bin" not in plan
    (tmp_path / "a.ts").unlink()
    listed, told = source_files.scan(spark, {"w": f"file://{tmp_path}"})
    (tmp_path / "b.TS").unlink()
    assert [r.message for r in told.collect()] == ["1 files could not be read."]


def test_manifests_in_json(spark):
    given = {"package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2", "a": "1"}}', "x/composer.json": '{"require": {"p/q": "1"}, "dependencies": {"no": "1"}}', "y/package.json": "{broken", "z/deno.json": '{"imports": {"std": "s"}}'}
    got = {(r.path, r.dependency) for r in source_files.manifests(table(spark, given)).collect()}
    assert got == {("package.json", "a"), ("package.json", "b"), ("x/composer.json", "p/q"), ("z/deno.json", "std")}


def test_every_go_module_is_known(spark):
    n = 100_200
    mods = spark.range(n).selectExpr("concat('r', id, '/go.mod') AS path", "concat('module example.com/r', id, '\\n') AS content")
    code = spark.range(n).selectExpr("concat('r', id, '/pkg/a.go') AS path", "'package pkg\\n' AS content")
    found = imports.symbols(mods.unionByName(code)).where("grp = 'go'")
    assert found.count() == n
    assert found.where("target = 'r77/pkg/a.go'").first().name == "example.com/r77/pkg"


def test_models_are_found_at_any_depth(spark, workspace):
    classes = ["from django.db import models", "class A0(models.Model):", "    name = models.CharField(max_length=9)"]
    for i in range(1, 9):
        classes += [f"class A{i}(A{i - 1}):", f"    f{i} = models.IntegerField()"]
    classes += ["class Other(Thing):", "    x = models.IntegerField()"]
    entities, fields, _ = schema.data_model(table(spark, {"m.py": "\n".join(reversed_pairs(classes)) + "\n"}))
    assert {r.entity for r in entities.collect()} == {f"A{i}" for i in range(9)}
    assert {r.field for r in fields.collect()} == {"name", "id", *(f"f{i}" for i in range(1, 9))}


def reversed_pairs(lines: list[str]) -> list[str]:
    """The first line and then the classes of two lines each, last one first."""
    return lines[:1] + [x for i in range(len(lines) - 2, 0, -2) for x in lines[i : i + 2]]


def test_the_workspace_suppresses_inverses(workspace):
    kept = {(r.entity, r.field) for r in workspace.relations.collect()}
    assert ("Cargo", "carrier") in kept and ("Ship", "cargoes") not in kept


def test_more_readers(spark):
    entities, fields, relations = schema.data_model(
        table(
            spark,
            {
                "b.py": "from beanie import Document, Link\nfrom typing import Optional, List\n\nclass Base(Document):\n    id: int\n\nclass Tour(Base):\n    title: Indexed(str, unique=True)\n    guide: Optional[Link[\"Guide\"]] = None\n    stops: List[Link[Stop]]\n\n    class Settings:\n        name = \"tours\"\n\nclass Stop(Document):\n    at: str\n\nclass Plain(BaseModel):\n    x: int\n",
                "K.kt": "import jakarta.persistence.*\n@Entity\n@Table(name = \"boats\")\nclass Boat(\n  @Id\n  val id: Long,\n  @ManyToOne\n  val owner: Owner?,\n)\n",
                "g.go": "package m\nimport \"gorm.io/gorm\"\ntype Lamp struct {\n\tgorm.Model\n\tRooms []Room `gorm:\"many2many:lamp_rooms\"`\n}\ntype Room struct {\n\tID uint `gorm:\"primaryKey\"`\n}\nfunc (Lamp) TableName() string { return \"old_lamps\" }\n",
                "d.dart": "import 'package:drift/drift.dart';\nclass Seats extends Table {\n  IntColumn get rowNo => integer()();\n  Set<Column> get primaryKey => {rowNo};\n}\n",
                "t.ts": "import { prop } from '@typegoose/typegoose';\nclass Kept {\n  @prop()\n  name: string;\n}\nclass Other {\n  x: number;\n}\n",
                "p.prisma": "model A {\n  id Int @id\n  name String @db.VarChar(9) @map(\"n\")\n  b B?\n  @@map(\"as\")\n  @@schema(\"own\")\n}\nmodel B {\n  id Int @id\n  a A @relation(fields: [id], references: [id])\n}\n",
            },
        )
    )
    physical = {(r.entity, r.physical) for r in entities.collect()}
    assert physical == {("Base", "Base"), ("Tour", "tours"), ("Stop", "Stop"), ("Boat", "boats"), ("Lamp", "old_lamps"), ("Room", "rooms"), ("Seats", "seatses"), ("Kept", "kept"), ("A", "own.as"), ("B", "B")}
    own = {(r.entity, r.field): r for r in fields.collect()}
    assert own["Tour", "title"].uniq and own["Tour", "guide"].nullable and own["Base", "id"].pk and own["Boat", "id"].pk and own["Boat", "owner"].type == "Owner?"
    assert own["Lamp", "ID"].pk and own["Lamp", "DeletedAt"].type == "gorm.DeletedAt" and own["Seats", "rowNo"].pk and own["A", "name"].type == "VarChar(9)"
    links = {(r.entity, r.field): (r.target, r.kind, r.state) for r in relations.collect()}
    assert links["Tour", "guide"] == ("Guide", "one", "missing") and links["Tour", "stops"] == ("Stop", "many", "resolved") and links["Lamp", "Rooms"] == ("Room", "many", "resolved")
    assert links["Boat", "owner"][:2] == ("Owner", "one")
    kept = {(r.entity, r.field) for r in schema.without_inverses(relations).collect()}
    assert ("B", "a") in kept and ("A", "b") not in kept
