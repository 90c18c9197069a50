"""Flows and links between modules without what they don't need."""

from __future__ import annotations

from weft.operators import flow, imports, interfaces, modules
from weft.plans.workspace import Workspace

FILES = {
    "packages/a/x.ts": "import { y } from '../b/y';\nimport z from '../b/z';\nimport q from 'pkg';\n",
    "packages/a/w.ts": "import { y } from '../b/y';\nimport q from 'pkg';\n",
    "packages/b/y.ts": "import { x } from '../a/x';\nimport r from 'other';\n",
    "packages/b/z.ts": "app.get('/z', show);\nfunction show(id) {\n  if (id) {\n    return db.query(id);\n  }\n}\n",
    "go/go.mod": "module ex.org/m\n",
    "go/k/a.go": "package k\nfunc A() {\n}\n",
    "go/k/b.go": "package k\nfunc B() {\n}\n",
    "go/l/c.go": "package l\nimport (\n\t\"ex.org/m/k\"\n)\nfunc C() {\n\tk.A()\n}\n",
    "api/s.ts": "@Controller('s')\nexport class S {\n  @Get(':id')\n  async find(id: string) {\n    return 1;\n  }\n}\n",
    "py/p.py": "@app.route('/p', methods=['GET', 'PUT'])\ndef p():\n  pass\n",
    "ws/s.ts": "import { io } from 'socket.io-client';\nsocket.on('m', f);\n",
}


def files(spark):
    return spark.createDataFrame([(p, c, len(c)) for p, c in FILES.items()], "path string, content string, size long")


def test_links_are_counted_without_the_statements(spark, monkeypatch):
    own = Workspace(spark, files(spark))
    edges = {(r.src, r.dst): r.n for r in own.module_edges.collect()}
    used = {(r.package, r.module): r.module_n for r in own.externals.collect()}
    monkeypatch.setattr(imports, "resolved", None)
    own = Workspace(spark, files(spark))
    assert {(r.src, r.dst): r.n for r in own.module_links.collect()} == edges and len(edges) >= 3
    assert {(r.package, r.module): r.module_n for r in modules.external_links(own.meant, own.files).collect()} == used and len(used) >= 3
    assert own.project_flow()[1].count() == len(edges)


def test_only_files_with_annotations_look_for_handlers_below(spark, monkeypatch):
    expected = {(r.path, r.operation, r.address, r.handler, r.distance) for r in interfaces.declared(files(spark)).collect()}
    assert expected == {
        ("packages/b/z.ts", "GET", "/z", "show", 0), ("api/s.ts", "GET", "/s/:id", "find", 1), ("py/p.py", "GET", "/p", "p", 1), ("py/p.py", "PUT", "/p", "p", 1), ("ws/s.ts", "on", "m", "f", 0),
    }
    http = {(r.path, r.operation, r.address, r.handler, r.distance) for r in interfaces.handled(files(spark), offers="http").collect()}
    assert http == {x for x in expected if x[0] != "ws/s.ts"}
    looked, all_of = [], interfaces.callables
    monkeypatch.setattr(interfaces, "callables", lambda rows: looked.append({r.path for r in rows.select("path").distinct().collect()}) or all_of(rows))
    interfaces.declared(files(spark))
    assert looked == [{"api/s.ts", "py/p.py"}]
    assert {r.label for r in flow.flow_graph(files(spark))[0].where("kind = 'start'").collect()} == {"GET /z", "GET /s/:id", "GET /p", "PUT /p"}
