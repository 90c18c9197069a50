"""Diagnostics are told without drawing flows or joining statements with what they mean."""

from __future__ import annotations

from weft.operators import flow, modules
from weft.plans.workspace import Workspace

FILES = [
    ("src/a.ts", "import b from './b';\nimport c from './gone';\nimport d from './gone';\napp.get('/x', show);\nfunction show(id) {\n  if (id) {\n    db.query(id);\n  }\n}\n"),
    ("src/b.ts", "import c from './gone';\nimport z from 'pkg';\nexport const n = 1;\n"),
    ("src/c.py", "import os\nimport numpy\n# def no(x):\n"),
    ("src/d.go", "package d\n\nfunc Run() {\n\thelp()\n}\n\nfunc help() {\n}\n"),
    ("src/e.ts", "app.get('/y', lost);\nif (x) {\n  db.query(x);\n}\n"),
    ("f.sql", "CREATE TABLE t (id int REFERENCES u(id));\nCREATE TABLE v (id int"),
    ("g.md", "function show(id) {\n}\n"),
    ("src/h.ts", ""),
]


def test_diagnostics_draw_no_flow_and_join_no_statement(spark):
    own = Workspace(spark, spark.createDataFrame([(p, c, len(c)) for p, c in FILES], "path string, content string, size long"))
    found = {r.code: r.message for r in own.diagnostics.collect()}
    assert not {"_flow", "imports"} & set(own.__dict__)
    assert set(found) == {"LOCAL_IMPORTS_UNRESOLVED", "DB_RELATION_UNRESOLVED", "DB_PARSE_PARTIAL", "FLOW_STATIC_HEURISTIC"}
    assert found["LOCAL_IMPORTS_UNRESOLVED"].startswith(f"{own.imports.where('unresolved_local').count()} ") and found["LOCAL_IMPORTS_UNRESOLVED"].startswith("3 ")
    assert sorted(r.unit for r in flow.units_of(own.files).collect()) == sorted({r.unit for r in own.flow_nodes.collect()}) == ["src/a.ts", "src/d.go"]
    assert flow.diagnostics(flow.units_of(own.files), 1).collect() == flow.diagnostics(own.flow_nodes, 1).collect()
    assert modules.diagnostics(own.meant, 0).collect() == modules.diagnostics(own.imports, 0).collect()
