from __future__ import annotations

from weft.operators import modules


def rows(spark, data, columns):
    return spark.createDataFrame(data, columns).coalesce(1)


def test_statements_of_a_module_pair_are_added_up_before_they_are_shuffled(spark):
    files = rows(spark, [(f"{m}/d{i % 3}/f{i}.ts", "", 0) for m in ("a", "b", "c") for i in range(9)] + [("b/package.json", "{}", 2), ("top.ts", "", 0)], "path string, content string, size long")
    found = rows(
        spark,
        [("a/d0/f0.ts", "x", 1, ["b/d0/f0.ts", "b/d0/f3.ts", "b/d1/f1.ts", "c/d1/f1.ts"]), ("a/d0/f0.ts", "y", 2, ["b/d2/f2.ts"]), ("a/d2/f2.ts", "y", 9, ["b/d2/f2.ts"]), ("top.ts", "y", 1, ["a/d0/f0.ts"]), ("a/d1/f1.ts", "z", 3, [])],
        "path string, specifier string, line int, targets array<string>",
    )
    took = lambda frame, **how: {(r.src, r.dst): (r.n, r.sources, r.line) for r in modules.module_edges(frame, files, **how).collect()}
    edges = took(found, once=True)
    # Three targets of one statement lie in two folders of b, which are two modules; those in one folder count once.
    assert edges == {
        ("a", "b/d0"): (1, ["a/d0/f0.ts"], 1), ("a", "b/d1"): (1, ["a/d0/f0.ts"], 1), ("a", "b/d2"): (2, ["a/d0/f0.ts", "a/d2/f2.ts"], 2), ("a", "c"): (1, ["a/d0/f0.ts"], 1), ("(root)", "a"): (1, ["top.ts"], 1),
    }
    assert took(found.unionByName(found)) == edges
    plan = modules.module_edges(found, files, once=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_files_of_a_module_are_chosen_before_the_shuffle(spark):
    files = rows(spark, [(f"m/f{i:02}.{'py' if i % 2 else 'ts'}", "", 0) for i in range(30)], "path string, content string, size long")
    found = modules.inventory(files)
    assert [(r.module, r.files, r.languages, len(r.examples), r.examples[0]) for r in found.collect()] == [("m", 30, ["Python", "TypeScript"], 5, "m/f00.ts")]
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()


def test_modules_beyond_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    files = rows(spark, [(f"m{i % 4}/f{i}.ts", "", 0) for i in range(40)], "path string, content string, size long")
    near = sorted(map(tuple, modules.with_modules(files).select("path", "root", "module").collect()))
    monkeypatch.setattr(modules, "FOLDERS", 1)
    far = modules.with_modules(files).select("path", "root", "module")
    assert sorted(map(tuple, far.collect())) == near and "broadcast" not in far._jdf.queryExecution().optimizedPlan().toString()
