"""Roots of projects are looked for once for a folder, and lines of models are kept for all that reads them."""

from __future__ import annotations

from weft.operators import schema


def test_a_folder_stands_for_its_files(spark, monkeypatch):
    model = "from django.db import models\n\nclass A{0}(models.Model):\n    name = models.CharField(max_length=9)\n"
    paths = [f"x/src/app/m{i}.py" for i in range(4)] + ["y/m.py", "y/z/m.py", "top.py"]
    rows = [(p, model.format(i)) for i, p in enumerate(paths)] + [("y/manage.py", ""), ("d.sql", "CREATE TABLE t (id int);")]
    asked, roots = [], schema.schema_roots
    monkeypatch.setattr(schema, "schema_roots", lambda placed, files: asked.append(placed.count()) or roots(placed, files))
    entities, fields, _ = schema.declared(spark.createDataFrame(rows, "path string, content string"))
    assert asked == [4]  # folders, not files
    of = {p: "django:x" for p in paths[:4]} | {"y/m.py": "django:y", "y/z/m.py": "django:y", "top.py": "django:.", "d.sql": "sql:d.sql"}
    assert {r.file: r.variant for r in entities.collect()} == of
    assert sorted((r.file, r.variant, r.field) for r in fields.collect()) == sorted((p, v, f) for p, v in of.items() for f in (("id",) if v.startswith("sql") else ("id", "name")))
