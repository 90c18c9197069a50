from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from weft.operators import imports
from weft.plans import incremental
from weft.sources.files import FILES
from weft.streaming import changes


def table(spark, files: dict[str, str]):
    return spark.createDataFrame([(p, c, len(c.encode())) for p, c in files.items()], FILES)


def rows(frame):
    return sorted(map(repr, frame.select(sorted(frame.columns)).collect()))


def test_only_changed_files_are_read_again(spark, tmp_path):
    first = {"a.ts": "import './b';\nfunction one() {\n}\n", "b.ts": "import 'x';\n", "c.py": "def f():\n  pass\n", "empty.ts": ""}
    uri, read = str(tmp_path / "store"), []

    def counted(files):
        read.append(sorted(r.path for r in files.select("path").collect()))
        return imports.imports(files)

    extractors = incremental.EXTRACTORS | {"imports": counted}
    assert sorted(r.path for r in incremental.refresh(spark, table(spark, first), uri, 1, extractors).collect()) == sorted(first)
    second = {**first, "b.ts": "import 'y';\nimport './a';\n", "d.py": "import os\n"}
    del second["c.py"]
    changed = incremental.refresh(spark, table(spark, second), uri, 2, extractors)
    assert sorted(r.path for r in changed.collect()) == ["b.ts", "d.py"]
    assert read == [sorted(first), ["b.ts", "d.py"]]
    for name, extract in incremental.EXTRACTORS.items():
        assert rows(incremental.facts(spark, uri, name)) == rows(extract(table(spark, second)))
    # A revision that is run again is the same; one of the first files again reads what differs from the second.
    incremental.refresh(spark, table(spark, second), uri, 2)
    assert rows(incremental.facts(spark, uri, "imports")) == rows(imports.imports(table(spark, second)))
    assert sorted(r.path for r in incremental.refresh(spark, table(spark, first), uri, 3).collect()) == ["b.ts", "c.py"]
    assert rows(incremental.facts(spark, uri, "imports")) == rows(imports.imports(table(spark, first)))
    with pytest.raises(Exception):
        incremental.facts(spark, str(tmp_path / "none"), "imports").collect()


def test_a_lone_burst_is_emitted_without_a_later_event(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("who string, path string, ts timestamp").json(str(folder))
    query = changes.quiet_bursts(stream, "who", gap=1500).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    line = '{{"who": "{}", "path": "a.ts", "ts": "2024-01-01T00:00:0{}.000Z"}}\n'
    try:
        (folder / "1.json").write_text(line.format("u", 1) + line.format("u", 2) + line.format("v", 5))
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("quiet").count() < 2:
            time.sleep(0.5)
        got = {(r.who, r.n, r.seconds) for r in spark.table("quiet").withColumn("seconds", F.unix_seconds("until") - F.unix_seconds("start")).collect()}
        assert got == {("u", 2, 1), ("v", 1, 0)}
        (folder / "2.json").write_text(line.format("u", 9))
        while time.time() < deadline and spark.table("quiet").count() < 3:
            time.sleep(0.5)
        assert spark.table("quiet").where("who = 'u'").agg(F.sum("n")).first()[0] == 3
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
