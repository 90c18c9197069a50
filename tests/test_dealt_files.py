from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import schema
from weft.plans.workspace import Workspace


def rows(spark, data, columns):
    return spark.createDataFrame(data, columns).coalesce(1)


def test_files_of_one_partition_are_dealt_to_all_tasks(spark):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = Workspace(spark, rows(spark, [(f"m/C{i}.java", "@Entity\nclass A {\n}\n" * 20, 100) for i in range(400)], "path string, content string, size long"))
        sizes = [r[0] for r in own.files.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) > 1 and max(sizes) < 250
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_entities_are_read_without_fields_and_relations(spark):
    own = Workspace(spark, rows(spark, [("a.sql", "CREATE TABLE t (id int PRIMARY KEY, n int REFERENCES u(id));\nCREATE TABLE u (id int);\n", 90)], "path string, content string, size long"))
    assert sorted(r.entity for r in own.entities.collect()) == ["t", "u"]
    assert not {"fields", "relations"} & set(own.__dict__)
    assert [(r.target, r.state) for r in own.relations.collect()] == [("u", "resolved")] and own.fields.count() == 3
    assert [x.count() for x in schema.data_model(own.files)] == [2, 3, 1]
