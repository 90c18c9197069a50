"""The data model as Markdown: one text for each area, rendered where its rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.fields import anchor, flags, mermaid
from weft.operators.areas import area_links, area_summary, subject_areas


def cell(value: Column) -> Column:
    """Text that stays within a cell of a table."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "\r?\n", " "), "([|\\\\])", "\\\\$1")


def _flags() -> Column:
    return F.replace(flags(*map(F.col, ("pk", "uniq", "nullable", "generated", "related", "inferred"))), F.lit(","), F.lit(""))


def schema_document(entities: DataFrame, fields: DataFrame, relations: DataFrame) -> DataFrame:
    """area, markdown: a heading, a section with a table of fields for each entity, and a list of relations."""
    placed = subject_areas(entities)
    rows = fields.select("variant", "entity", "pos", F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.col("field")), cell(F.col("type")), _flags()), F.lit(" |")).alias("row"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field_or_row"))), lambda x: x.field_or_row), c)
    tables = rows.withColumnRenamed("row", "field_or_row").groupBy("variant", "entity").agg(in_order("\n").alias("rows"))
    links = relations.select("variant", "entity", F.col("field").alias("pos"), F.concat(F.lit("- "), cell(F.col("field")), F.lit(" → "), cell(F.col("target")), F.lit(" ("), F.concat_ws(", ", "kind", "state"), F.lit(")")).alias("field_or_row"))
    lists = links.groupBy("variant", "entity").agg(in_order("\n").alias("links"))
    told = placed.join(tables, ["variant", "entity"], "left").join(lists, ["variant", "entity"], "left")
    head = F.concat(F.lit("### "), F.col("entity"), F.lit("\n\n"), F.col("kind"), F.lit(" `"), F.col("physical"), F.lit("`, "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    table = F.when(F.col("rows").isNotNull(), F.concat(F.lit("\n\n| field | type | flags |\n| --- | --- | --- |\n"), F.col("rows"))).otherwise("")
    section = F.concat(head, table, F.when(F.col("links").isNotNull(), F.concat(F.lit("\n\n"), F.col("links"))).otherwise(""))
    parts = told.select("area", F.struct("entity", "file", "line", section.alias("section")).alias("s"))
    texts = parts.groupBy("area").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.section), "\n\n").alias("body"))
    title = F.concat(F.lit("## "), F.when(F.col("area") == "", "(root)").otherwise(F.col("area")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return texts.select("area", F.concat(title, F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("markdown"))


#: An area's diagram names its relations if it has no more than this.
LABELLED = 40


def _listed(rows: DataFrame, line: Column, by: list[str], name: str = "text") -> DataFrame:
    """Lines of a group, in order, as one text."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias(name))


def diagrams(placed: DataFrame, relations: DataFrame) -> DataFrame:
    """area, markdown: a Mermaid diagram of the relations within each area that isn't oversized."""
    of = lambda end: placed.select(F.col("id").alias(f"{end}_id"), F.col("area").alias(f"_{end}"), "oversized") if end == "source" else placed.select(F.col("id").alias(f"{end}_id"), F.col("area").alias(f"_{end}"))
    inside = relations.where("target_id IS NOT NULL").join(of("source"), "source_id").join(of("target"), "target_id").where("_source = _target AND NOT oversized")
    inside = inside.withColumn("_n", F.count("*").over(Window.partitionBy("_source")))
    sign = F.when(F.col("kind").rlike("many"), F.lit(" }o--o{ ")).otherwise(F.lit(" }o--|| "))
    label = F.when(F.col("_n") <= LABELLED, F.col("field")).otherwise(F.lit(" "))
    line = F.concat(F.lit("  "), mermaid(F.col("entity")), sign, mermaid(F.col("target")), F.lit(' : "'), label, F.lit('"'))
    texts = _listed(inside, line, ["_source"])
    return texts.select(F.col("_source").alias("area"), F.concat(F.lit("```mermaid\nerDiagram\n"), F.col("text"), F.lit("\n```\n")).alias("markdown"))


def whole_document(placed: DataFrame, fields: DataFrame, relations: DataFrame, notes: DataFrame, title: str = "Data model") -> DataFrame:
    """part, area, markdown in order: a summary with an index of areas, relations between areas, each area with its diagram,
    relations that lead nowhere, and notes (code, message) on the data model."""
    shown = lambda c: F.when(F.col(c) == "", "(root)").otherwise(F.col(c))
    areas = area_summary(placed, relations)
    none = F.lit(None).cast("string")
    index = F.concat(F.lit("- ["), shown("area"), F.lit("](#"), anchor(F.concat(shown("area"), F.lit(" ("), F.col("members").cast("string"), F.lit(")"))), F.lit("): "), F.col("members").cast("string"), F.lit(" "), F.col("noun"), F.lit("s"))
    head = areas.agg(F.count("*").alias("n"), F.sum("members").alias("m"), F.sum("unresolved").alias("u"), F.array_join(F.array_sort(F.collect_list(index)), "\n").alias("index")).where("n > 0")
    summary = F.concat(F.lit(f"# {title}\n\n"), F.col("m").cast("string"), F.lit(" entities in "), F.col("n").cast("string"), F.lit(" areas, "), F.col("u").cast("string"), F.lit(" relations that lead nowhere\n\n"), F.col("index"), F.lit("\n"))
    links = area_links(placed, relations).select(F.concat(F.lit("- "), shown("a"), F.lit(" ↔ "), shown("b"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    missing = relations.where("target_id IS NULL").select(F.concat(F.lit("- "), F.concat_ws(".", cell(F.col("entity")), cell(F.col("field"))), F.lit(" → "), cell(F.col("target")), F.lit(" ("), F.col("state"), F.lit(")")).alias("line"))
    told = notes.where(F.col("code").startswith("DB_")).select(F.concat(F.lit("- "), cell(F.col("message"))).alias("line"))
    section = lambda rows, name, part: _listed(rows, F.col("line"), []).where("text <> ''").select(F.lit(part).alias("part"), none.alias("area"), F.concat(F.lit(f"## {name}\n\n"), F.col("text"), F.lit("\n")).alias("markdown"))
    own = schema_document(placed.drop("area", "oversized"), fields, relations).join(diagrams(placed, relations).withColumnRenamed("markdown", "_d"), "area", "left")
    parts = [
        head.select(F.lit(0).alias("part"), none.alias("area"), summary.alias("markdown")), section(links, "Between areas", 1),
        own.select(F.lit(2).alias("part"), "area", F.concat_ws("\n", "markdown", "_d").alias("markdown")), section(missing, "Leading nowhere", 3), section(told, "Notes", 4),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_schema_document(document: DataFrame, uri: str) -> None:
    """Writes the areas' texts in order; an empty model is refused."""
    if document.isEmpty():
        raise ValueError("the workspace declares no data model")
    document.orderBy(*(c for c in ("part", "area") if c in document.columns)).select(F.col("markdown").alias("value")).write.text(uri)
