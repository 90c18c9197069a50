"""Data models declared in source files: entities, fields and relations, resolved by joins on names.

Declarations of classes and blocks are read line by line: a window numbers the block that a line lies in, and block and field facts are
separate tables. SQL statements and nested literals come from the table of bracketed parts (lexer). All facts share one shape:

entities (variant, entity, kind, physical, alias, file, line), fields (variant, entity, file, pos, field, stored, type, pk, uniq, nullable,
generated, related, inferred), relations (variant, entity, file, line, field, target, kind, name, owning). Booleans are null where the
source says nothing. Names resolve within a variant: a file for SQL and Prisma, the project that holds the file for all others.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids, paths, text
from weft.operators import ranking
from weft.operators.lexer import lexed
from weft.operators.rollup import ancestors
from weft.session import saved

ENTITY = "variant entity kind physical alias file line".split()
FIELD = "variant entity file pos field stored type pk uniq nullable generated related inferred".split()
RELATION = "variant entity file line field target kind name owning".split()
_KINDS = {"stored": "string", "name": "string", "alias": "string", "line": "int"}
PRISMA_SCALARS = "String Boolean Int BigInt Float Decimal DateTime Json Bytes Unsupported".split()


def _tables(source: str, entities: DataFrame, fields: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables in their shape; what a reader doesn't tell is null. The variant is completed later."""

    def shaped(frame: DataFrame, columns: list[str]) -> DataFrame:
        frame = frame.withColumn("variant", F.lit(source))
        return frame.select(*(F.col(c) if c in frame.columns else F.lit(None).cast(_KINDS.get(c, "boolean")).alias(c) for c in columns))

    return shaped(entities, ENTITY), shaped(fields, FIELD), shaped(relations, RELATION)


def _blocks(files: DataFrame, extensions: list[str], gate: str, opening: str, closing: str | None) -> DataFrame:
    """path, number, line, block (the number of the line that opened it), head: the lines of blocks in files that pass the gate.

    closing is a pattern of the line that ends a block; without one a block reaches to the next.
    """
    chosen = files.where(paths.extension(F.col("path")).isin(*extensions) & F.col("content").rlike(gate))
    rows = chosen.select("path", text.numbered_lines(F.col("content")))
    window = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("line").rlike(opening), F.struct(F.col("number").alias("block"), F.col("line").alias("head")))
    nothing = F.struct(F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("head"))
    state = F.coalesce(opened, F.when(F.col("line").rlike(closing), nothing)) if closing else opened
    return rows.withColumn("_b", F.last(state, ignorenulls=True).over(window)).select("path", "number", "line", "_b.*").where("block IS NOT NULL")


def prisma(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, views and enums of Prisma schemas; a field of a type that isn't scalar is a relation. Of the relations between two entities
    under one name the side that names its fields stays, else the first."""
    rows = _blocks(files, ["prisma"], "(?m)^\\s*(?:model|view|enum)\\s", r"^\s*(?:model|view|enum|type|generator|datasource)\s+\w+\s*\{", r"^\s*\}")
    head = r"^\s*(model|view|enum)\s+(\w+)"
    rows = rows.where(F.col("head").rlike(head)).select("*", F.col("path").alias("file"), F.regexp_extract("head", head, 2).alias("entity"), F.regexp_extract("head", head, 1).alias("kind"))
    option = lambda name: F.max(F.when(F.col("line").rlike(f"@@{name}\\("), F.regexp_extract("line", f"@@{name}\\(\\s*(?:name:\\s*)?\"([^\"]*)\"", 1)))
    stored = F.concat_ws(".", option("schema"), F.coalesce(option("map"), F.col("entity")))
    entities = rows.groupBy("file", "entity", "kind", F.col("block").alias("line")).agg(stored.alias("physical"))
    inside = rows.where((F.col("number") > F.col("block")) & ~F.col("line").rlike(r"^\s*(?://|@@)"))
    values = inside.where("kind = 'enum'").select("file", "entity", F.col("number").alias("pos"), F.regexp_extract("line", r"^\s*(\w+)", 1).alias("field"), F.lit("enum value").alias("type")).where("field <> ''")
    column = r"^\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$"
    body = inside.where((F.col("kind") != "enum") & F.col("line").rlike(column)).select(
        "file", "entity", F.col("number").alias("pos"), *(F.regexp_extract("line", column, i).alias(n) for i, n in enumerate(("field", "type", "many", "maybe", "rest"), 1))
    )
    key = F.max(F.when(F.col("line").rlike("@@id"), F.regexp_extract("line", r"@@id\(\s*\[([^\]]*)\]", 1)))
    body = body.join(rows.groupBy("file", "entity").agg(F.split(key, r"\s*,\s*").alias("_keys")), ["file", "entity"])
    rest = F.col("rest")
    pk = rest.rlike(r"@id\b") | F.coalesce(F.array_contains("_keys", F.col("field")), F.lit(False))
    native = F.nullif(F.regexp_extract(rest, r"@db\.(\w+(?:\([^)]*\))?)", 1), F.lit(""))
    told = F.concat(F.coalesce(native, F.col("type")), "many")
    linked = ~F.col("type").isin(*PRISMA_SCALARS)
    fields = body.select(
        "file", "entity", "pos", "field", F.nullif(F.regexp_extract(rest, r"(?<!@)@map\(\s*(?:name:\s*)?\"([^\"]*)\"", 1), F.lit("")).alias("stored"), told.alias("type"), pk.alias("pk"), rest.rlike(r"@unique\b").alias("uniq"),
        (F.col("maybe") == "?").alias("nullable"), rest.rlike(r"@default\(\s*(?:auto|autoincrement|cuid|uuid|now)\s*\(").alias("generated"), linked.alias("related"),
    )
    name = F.coalesce(*(F.nullif(F.regexp_extract(rest, p, 1), F.lit("")) for p in (r"@relation\(\s*\"([^\"]*)\"", r"@relation\([^)]*\bname:\s*\"([^\"]*)\"")))
    pairs = body.where(linked).select(
        "file", "entity", F.col("pos").alias("line"), "field", F.col("type").alias("target"), F.when(F.col("many") != "", "many").otherwise("one").alias("kind"), name.alias("name"), rest.rlike(r"@relation\([^)]*fields:").alias("owning")
    )
    a, b = F.lower("entity"), F.lower("target")
    pairs = pairs.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).withColumn("_name", F.coalesce("name", F.lit("")))
    chosen = ranking.prefer(pairs, ["file", "_a", "_b", "_name"], F.desc("owning"), F.col("entity"), F.col("field"))
    return _tables("prisma", entities, fields.unionByName(values, allowMissingColumns=True), chosen)


#: A name in SQL: plain or in one of three kinds of quotes; and names joined by dots.
_WORD = "(?:\"[^\"]++\"|`[^`]++`|\\[[^\\]]++\\]|[A-Za-z_$][\\w$]*+)"
_NAME = _WORD + "(?:\\s*\\.\\s*" + _WORD + ")*+"
CREATED = rf"(?i)\bcreate\s+(?:unlogged\s+|temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*$"
#: What may follow a column's type.
_AFTER = "not\\s+null|null|default|primary\\s+key|unique|references|check|constraint|generated|collate|auto_increment|autoincrement|identity|on\\s+update|comment"


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[\"`\\[\\]]", ""), "\\s*\\.\\s*", ".")


def _line_of(head: str, pattern: str, opened: str) -> Column:
    """The line where a match that ends at a bracket begins."""
    return (F.col(opened) - F.length(F.regexp_replace(F.regexp_extract(head, pattern, 0), "[^\n]", ""))).alias("line")


def sql_ddl(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of CREATE TABLE, with their columns, keys and foreign keys, and foreign keys that ALTER TABLE adds."""
    plain = files.where((paths.extension(F.col("path")) == "sql") & F.col("content").rlike("(?i)\\b(?:create|alter)\\s+table\\b"))
    made = CREATED
    altered = rf"(?i)\balter\s+table\s+(?:only\s+)?(?:if\s+exists\s+)?({_NAME})\s"
    groups = lexed(plain, "dash").where((F.col("bracket") == "(") & F.col("head").rlike(made) & F.col("closed") | ((F.col("bracket") == "") & F.col("text").rlike(altered)))
    rows = saved(groups.withColumnRenamed("path", "file"))
    tables = rows.where("bracket = '('").withColumn("entity", _unquoted(F.regexp_extract("head", made, 1)))
    entities = tables.groupBy("file", "entity", _line_of("head", made, "opened")).agg(F.lit("table").alias("kind")).withColumn("physical", F.col("entity"))
    part = tables.where("text <> ''").select("file", "entity", F.col("part").alias("pos"), "line", F.regexp_replace(F.regexp_replace("text", r"\s+", " "), rf"(?i)^constraint {_WORD} ", "").alias("part"))
    keys = part.where(F.col("part").rlike(r"(?i)^(?:primary key|unique|foreign key|check|exclude)\b"))
    listed = lambda word: F.transform(F.split(F.regexp_extract("part", rf"(?i)^{word}[^(]*\(([^)]*)\)", 1), r"\s*,\s*"), lambda x: F.lower(_unquoted(F.trim(x))))
    of = lambda word, name: keys.where(F.col("part").rlike(rf"(?i)^{word}\b")).groupBy("file", "entity").agg(F.flatten(F.collect_list(listed(word))).alias(name))
    column = rf"^({_WORD})(.*)$"
    rest = rf"(?i)^(.*?)(?:\s+((?:{_AFTER})\b.*))?$"
    columns = part.where(~F.col("part").rlike(r"(?i)^(?:primary key|unique|foreign key|check|exclude)\b") & F.col("part").rlike(column)).select(
        "file", "entity", "pos", "line", _unquoted(F.regexp_extract("part", column, 1)).alias("field"), F.regexp_extract("part", column, 2).alias("_rest")
    )
    columns = columns.select("*", F.trim(F.regexp_extract("_rest", rest, 1)).alias("type"), F.regexp_extract("_rest", rest, 2).alias("told"))
    columns = columns.join(of("primary key", "_pk"), ["file", "entity"], "left").join(of("unique", "_uq"), ["file", "entity"], "left")
    member = lambda c: F.coalesce(F.array_contains(c, F.lower("field")), F.lit(False))
    told = F.lower("told")
    pk = told.contains("primary key") | member("_pk")
    nullable = F.when(told.rlike(r"\bnot null\b") | pk, False).when(told.rlike(r"\bnull\b"), True)
    linked = told.rlike(r"\breferences\b")
    fields = columns.select(
        "file", "entity", "pos", "field", F.when(F.col("type") == "", "unknown").otherwise(F.col("type")).alias("type"), pk.alias("pk"), (told.rlike(r"\bunique\b") | member("_uq")).alias("uniq"), nullable.alias("nullable"),
        told.rlike(r"\b(?:generated|identity|auto_increment|autoincrement)\b").alias("generated"), linked.alias("related"),
    )
    inline = columns.where(linked).select("file", "entity", "line", "field", _unquoted(F.regexp_extract("told", rf"(?i)\breferences\s+({_NAME})", 1)).alias("target"))
    foreign = rf"(?i)\bforeign\s+key\s*\(([^)]*)\)\s*references\s+({_NAME})"
    outer = keys.where(F.col("part").rlike(foreign)).select("file", "entity", "line", _unquoted(F.regexp_extract("part", foreign, 1)).alias("field"), _unquoted(F.regexp_extract("part", foreign, 2)).alias("target"))
    added = rows.where("bracket = ''").where(F.col("text").rlike(foreign)).select(
        "file", "line", _unquoted(F.regexp_extract("text", altered, 1)).alias("entity"), _unquoted(F.regexp_extract("text", foreign, 1)).alias("field"), _unquoted(F.regexp_extract("text", foreign, 2)).alias("target")
    )
    relations = inline.unionByName(outer).unionByName(added).withColumn("kind", F.lit("one"))
    return _tables("sql", entities, fields, relations)


def _python_classes(files: DataFrame, gate: str) -> DataFrame:
    """_blocks of Python classes, with entity and bases; a line at the left margin ends a class."""
    head = r"^class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:"
    rows = _blocks(files, ["py"], gate, head, r"^\S(?!.*^class)")
    return rows.select("*", F.regexp_extract("head", head, 1).alias("entity"), F.split(F.regexp_extract("head", head, 2), r"\s*,\s*").alias("bases"))


def _derived(classes: DataFrame, roots: str) -> DataFrame:
    """path, entity of classes that derive, at any depth, from a base matching `roots`, over classes of the same file."""
    known = classes.groupBy("path").agg(F.collect_set(F.struct("entity", "bases")).alias("_all"))
    names = lambda rows: F.transform(rows, lambda c: c.entity)
    step = lambda found, grown: F.struct(found.alias("found"), grown.alias("grown"))
    direct = names(F.filter("_all", lambda c: F.exists(c.bases, lambda b: b.rlike(roots))))

    def wider(state: Column, _: Column) -> Column:
        more = names(F.filter("_all", lambda c: F.array_contains(state.found, c.entity) | F.arrays_overlap(c.bases, state.found)))
        return F.when(state.grown, step(more, F.size(more) > F.size(state.found))).otherwise(state)

    # Each step reaches one class deeper, and a file has no longer chain than it has classes; without growth nothing is left to do.
    found = F.aggregate("_all", step(direct, F.lit(True)), wider)
    return known.select("path", F.explode(found.found).alias("entity"))


def django(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Django models with their fields; an implicit id where no field is the primary key."""
    rows = _python_classes(files, r"(?m)^\s*(?:from|import)\s+django\b")
    return _python_models(rows, "django", r"(?:^|\.)Model$", r"^    (\w+)\s*=\s*(?:models\.)?(\w*(?:Field|ForeignKey))\((.*)$", r"^(?:ForeignKey|OneToOneField|ManyToManyField)$", "table", r"^\s+db_table\s*=\s*['\"]([^'\"]*)")


def mongoengine(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _python_classes(files, r"(?m)^\s*(?:from|import)\s+mongoengine\b")
    return _python_models(rows, "mongoengine", r"(?:^|\.)(?:Dynamic|Embedded)?Document$", r"^    (\w+)\s*=\s*(?:\w+\.)?(\w+Field)\((.*)$", r"Reference|Embedded", "collection", r"^\s+meta\s*=.*['\"]collection['\"]\s*:\s*['\"]([^'\"]*)")


def _python_models(rows: DataFrame, name: str, roots: str, field: str, links: str, kind: str, physical: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = saved(rows.join(_derived(rows, roots), ["path", "entity"]).withColumnRenamed("path", "file"))  # read for entities, twice for fields, and for relations
    stored = F.max(F.when(F.col("line").rlike(physical), F.regexp_extract("line", physical, 1)))
    entities = own.groupBy("entity", "file", F.col("block").alias("line")).agg(F.coalesce(stored, text.snake_case(F.col("entity"))).alias("physical")).withColumn("kind", F.lit(kind))
    body = own.where(F.col("line").rlike(field)).select("file", "entity", F.col("number").alias("pos"), *(F.regexp_extract("line", field, i).alias(n) for i, n in enumerate(("field", "type", "rest"), 1)))
    truth = lambda word: F.when(F.col("rest").rlike(rf"\b{word}\s*=\s*True"), True).when(F.col("rest").rlike(rf"\b{word}\s*=\s*False"), False)
    linked = F.col("type").rlike(links) | F.col("rest").rlike(r"^\s*(?:Reference|EmbeddedDocument)Field\(")
    column = F.nullif(F.regexp_extract("rest", r"\bdb_(?:column|field)\s*=\s*['\"]([^'\"]*)", 1), F.lit(""))
    fields = body.select("file", "entity", "pos", "field", column.alias("stored"), "type", F.coalesce(truth("primary_key"), F.lit(False)).alias("pk"), truth("unique").alias("uniq"), truth("null").alias("nullable"), linked.alias("related"))
    if name == "django":
        keyed = fields.where("pk").select("file", "entity")
        implied = entities.join(keyed, ["file", "entity"], "left_anti").select(
            "file", "entity", F.lit(0).alias("pos"), F.lit("id").alias("field"), F.lit("AutoField").alias("type"), F.lit(True).alias("pk"), F.lit(True).alias("uniq"), F.lit(False).alias("nullable"), F.lit(True).alias("generated"), F.lit(True).alias("inferred")
        )
        fields = fields.unionByName(implied, allowMissingColumns=True)
    target = F.regexp_extract("rest", r"^\s*(?:\w+Field\(\s*)?['\"]?([\w.]+)", 1)
    target = F.when(target == "self", F.col("entity")).otherwise(F.element_at(F.split(target, "\\."), -1))
    many = F.col("type").rlike("Many|List")
    relations = body.where(linked).select("file", "entity", F.col("pos").alias("line"), "field", target.alias("target"), F.when(many, "many").otherwise("one").alias("kind"))
    return _tables(name, entities, fields, relations)


def beanie(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Beanie documents: annotated attributes, links to other documents, the collection that a nested Settings class names."""
    rows = _python_classes(files, r"(?m)^\s*(?:from|import)\s+beanie\b")
    own = rows.join(_derived(rows, r"(?:^|\.)(?:Document|UnionDoc)$"), ["path", "entity"]).withColumnRenamed("path", "file")
    line = F.col("line")
    named = r"^\s{8,}name\s*=\s*['\"]([^'\"]+)"
    stored = F.max(F.when(line.rlike(named), F.regexp_extract("line", named, 1)))
    entities = own.groupBy("entity", "file", F.col("block").alias("line")).agg(F.coalesce(stored, F.col("entity")).alias("physical")).withColumn("kind", F.lit("collection"))
    shape = r"^    (\w+)\s*:\s*((?:[^=#()]++|\([^()]*+\))+?)\s*(?:=\s*(.*))?$"
    body = own.where(line.rlike(shape)).select("file", "entity", F.col("number").alias("pos"), *(F.regexp_extract("line", shape, i).alias(n) for i, n in enumerate(("field", "type", "rest"), 1)))
    empty = F.col("type").rlike(r"\bOptional\[|\bNone\b")
    unique = F.when(F.col("type").rlike(r"\bIndexed\(.*unique\s*=\s*True") | F.col("rest").rlike(r"unique\s*=\s*True"), True)
    target = r"\b(?:Back)?Link\[\s*['\"]?(?:\w+\.)*(\w+)"
    fields = body.select("file", "entity", "pos", "field", F.trim("type").alias("type"), (F.col("field") == "id").alias("pk"), unique.alias("uniq"), F.when(empty, True).alias("nullable"), F.col("type").rlike(target).alias("related"))
    many = F.col("type").rlike(r"(?i)\b(?:list|set|sequence)\[")
    relations = body.where(F.col("type").rlike(target)).select("file", "entity", F.col("pos").alias("line"), "field", F.regexp_extract("type", target, 1).alias("target"), F.when(many, "many").otherwise("one").alias("kind"), (~F.col("type").contains("BackLink[")).alias("owning"))
    return _tables("beanie", entities, fields, relations)


class Classes(NamedTuple):
    """How a library marks its classes and members with annotations."""

    source: str
    kind: str
    gate: str  # what a file has to hold
    mark: str  # annotations of a class that counts
    link: str  # annotations of a member that relates
    target: str  # an entity named by them
    physical: str  # a name for what stores the class
    of_members: str = ""  # instead of a mark: a class counts if one of its members has this
    convention: bool = False  # members without annotation are fields too


def _decorated(files: DataFrame, of: Classes, extensions: list[str], class_: str, members: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes under an annotation, their members, and relations that annotations above a member tell of. `members` are patterns with the
    order of name and type in them: "nt", "tn", or "gt" for a method that gives a type and whose name says what it gets."""
    chosen = files.where(paths.extension(F.col("path")).isin(*extensions) & F.col("content").rlike(of.gate))
    rows = chosen.select(F.col("path").alias("file"), text.numbered_lines(F.col("content")))
    line = F.col("line")
    running = Window.partitionBy("file").orderBy("number")
    is_class = line.rlike(class_)

    def member(pattern: str, order: str) -> Column:
        name, kind = F.regexp_extract(line, pattern, order.index("n") + 1 if "n" in order else 2), F.regexp_extract(line, pattern, order.index("t") + 1 if "n" in order else 1)
        name = name if "n" in order else F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))
        return F.when(line.rlike(pattern), F.struct(name.alias("field"), F.trim(kind).alias("type"), F.lit("n" not in order).alias("getter")))

    # Annotations count for the next class or member: all lines since the last one are its annotations.
    found = F.when(~is_class, F.coalesce(*(member(p, o) for p, o in members)))
    rows = rows.withColumn("_class", is_class).withColumn("_member", found)
    taker = F.col("_class") | F.col("_member").isNotNull()
    rows = rows.withColumn("_taker", taker)
    rows = rows.withColumn("_group", F.coalesce(F.sum(F.when(F.col("_taker"), 1).otherwise(0)).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    notes = rows.where(line.rlike(r"^\s*(?:@|\))|=>")).groupBy("file", "_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x.line), "\n").alias("notes"))
    taken = rows.where("_taker").join(notes, ["file", "_group"], "left").withColumn("notes", F.coalesce("notes", F.lit("")))
    header = F.when(F.col("_class"), F.struct(F.regexp_extract("line", class_, 1).alias("entity"), F.col("notes").rlike(of.mark).alias("marked"), F.col("number").alias("class_line")))
    taken = taken.withColumn("_h", F.last(header, ignorenulls=True).over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select("*", "_h.*").where("marked")
    if of.of_members:
        own = F.max(F.when(~F.col("_class"), F.col("notes").rlike(of.of_members))).over(Window.partitionBy("file", "class_line"))
        taken = taken.withColumn("_own", own).where("_own").drop("_own")
    note = F.col("notes")
    stored = F.regexp_extract(note, of.physical, 1)
    kind = F.when(note.rlike(r"@(?:\w+\.)?ViewEntity\b"), "view").when(note.rlike(r"@MappedSuperclass\b"), "abstract-entity").otherwise(of.kind)
    entities = taken.where("_class").select("entity", kind.alias("kind"), F.when(stored != "", stored).otherwise(text.snake_case(F.col("entity"))).alias("physical"), "file", F.col("number").alias("line"))
    body = taken.where("NOT _class").select("file", "entity", F.col("number").alias("pos"), "_member.*", "notes", "line")
    bare = ~note.rlike(r"@\w")
    # A getter counts if it is annotated; of a member named twice the first stays; constants and transient members are no fields.
    body = body.where(~(F.col("getter") & bare) & ~note.rlike(r"@(?:\w+\.)?Transient\b") & ~F.col("line").rlike(r"\b(?:static|transient)\s"))
    body = body.where(~bare) if not of.convention else body
    body = ranking.prefer(body, ["file", "entity", "field"], bare, F.col("pos"))
    flag = lambda yes, no: F.when(note.rlike(yes), True).when(note.rlike(no), False)
    pk = note.rlike(r"@(?:\w+[.:])*(?:Id|EmbeddedId|PrimaryColumn|PrimaryGeneratedColumn|ObjectIdColumn)\b")
    column = F.nullif(F.regexp_extract(note, r"@(?:\w+[.:])*(?:Column|Field|prop)\(\s*(?:\{?\s*(?:name|alias|value)\s*[:=]\s*)?[\"']([^\"']+)[\"']", 1), F.lit(""))
    linked = note.rlike(of.link)
    fields = body.select(
        "file", "entity", "pos", "field", column.alias("stored"), "type", pk.alias("pk"), flag(r"unique\s*[:=]\s*true", r"unique\s*[:=]\s*false").alias("uniq"),
        F.coalesce(flag(r"nullable\s*[:=]\s*true", r"nullable\s*[:=]\s*false"), F.when(note.rlike(r"\brequired\s*:\s*true"), False)).alias("nullable"),
        note.rlike(r"@(?:\w+[.:])*(?:PrimaryGeneratedColumn|GeneratedValue|CreateDateColumn|UpdateDateColumn|Generated)\b").alias("generated"), linked.alias("related"), (bare & F.lit(of.source == "jpa")).alias("inferred"),
    )
    named = F.regexp_extract(note, of.target, 1)
    plain = F.regexp_extract("type", r"(\w+)\??(?:>|\[\])?\??\s*$", 1)
    many = note.rlike("(?:OneToMany|ManyToMany|ElementCollection)") | F.col("type").rlike(r"^(?:List|Set|Collection|Array|MutableList|MutableSet)<|\[\]$")
    inverse = note.rlike(r"\bmappedBy\b|@(?:\w+[.:])*OneToMany\b")
    relations = body.where(linked).select("file", "entity", F.col("pos").alias("line"), "field", F.when(named != "", named).otherwise(plain).alias("target"), F.when(many, "many").otherwise("one").alias("kind"), (~inverse).alias("owning"))
    return _tables(of.source, entities, fields, relations)


_INLINE = r"^\s*(?:@[\w.:]+(?:\([^)]*\))?\s+)*"
_TS_CLASS = r"^\s*(?:@[\w.]+\([^)]*\)\s+)*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
_TS_MEMBERS = [(r"^\s*(?:@[\w.]+\(.*\)\s+)?(?:(?:public|private|protected|readonly|declare)\s+)*(\w+)[?!]?\s*:\s*([\w<>\[\]|., ]+?)\s*(?:=[^>].*)?;?\s*$", "nt")]
_JAVA_CLASS = _INLINE + r"(?:(?:public|abstract|final|open|data)\s+)*class\s+(\w+)"
_JAVA_MEMBERS = [
    (_INLINE + r"(?:(?:private|protected|public|final|volatile|static|transient)\s+)+([\w<>\[\]., ?]+?)\s+(\w+)\s*(?:=.*)?;\s*$", "tn"),
    (_INLINE + r"(?:(?:private|protected|public|abstract|final|synchronized)\s+)*([\w<>\[\]., ?]+?)\s+(?:get|is)([A-Z]\w*)\s*\(\s*\)", "gt"),
    (r"^\s*(?:@[\w.:]+(?:\([^)]*\))?\s+)+([\w<>\[\]., ?]+?)\s+(\w+)\s*(?:=.*)?;\s*$", "tn"),
]
_KOTLIN_CLASS = _INLINE + r"(?:(?:public|abstract|final|open|data)\s+)*class\s+(\w+)"
_KOTLIN_MEMBERS = [(r"^\s*(?:@\S+\s+)*(?:(?:private|protected|public|override|open|lateinit)\s+)*(?:val|var)\s+(\w+)\s*:\s*([\w<>., ?]+?)\s*(?:=.*)?,?\s*\)?\s*\{?$", "nt")]


def typeorm(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = Classes("typeorm", "table", r"['\"]typeorm['\"]", r"@(?:\w+\.)?(?:View)?Entity\(", r"@(?:\w+\.)?(?:OneToOne|OneToMany|ManyToOne|ManyToMany)\(", r"To(?:One|Many)\(\s*\(?\w*\)?\s*=>\s*(\w+)", r"Entity\(\s*(?:\{\s*name:\s*)?['\"]([^'\"]+)")
    return _decorated(files, of, ["ts", "js"], _TS_CLASS, _TS_MEMBERS)


def typegoose(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes with a @prop member. One that is stored in another and of which its file makes no model is embedded."""
    of = Classes("typegoose", "collection", r"['\"]@typegoose/typegoose['\"]", r".*", r"@prop\([^)]*(?:ref|type)\s*:\s*\(?\)?\s*(?:=>\s*)?[A-Z]", r"(?:ref|type)\s*:\s*(?:\(\)\s*=>\s*)?\[?(\w+)", r"collection\s*:\s*['\"]([^'\"]+)", of_members=r"@prop\(")
    entities, fields, relations = _decorated(files, of, ["ts", "js"], _TS_CLASS, _TS_MEMBERS)
    # A member typed as another document class of its file, without a ref, holds that document.
    name = F.regexp_extract("type", r"(\w+)(?:\[\])?\s*$", 1)
    held = fields.where("NOT related").select("file", "entity", F.col("pos").alias("line"), "field", name.alias("target"), F.when(F.col("type").endswith("[]"), "embeds-many").otherwise("embeds").alias("kind"))
    held = held.join(entities.select("file", F.col("entity").alias("target")).distinct(), ["file", "target"])
    made = files.where(F.col("content").contains("@typegoose/typegoose")).select(F.col("path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(?:getModelForClass|getDiscriminatorModelForClass|buildSchema|addModelToTypegoose)\s*\(\s*(\w+)"), F.lit(1)))).alias("entity"), F.lit(True).alias("_made"))
    inside = held.select("file", F.col("target").alias("entity"), F.lit(True).alias("_held")).distinct()
    placed = entities.join(made, ["file", "entity"], "left").join(inside, ["file", "entity"], "left")
    embedded = F.col("_held").isNotNull() & F.col("_made").isNull()
    entities = placed.withColumn("kind", F.when(embedded, "embedded").otherwise(F.col("kind"))).withColumn("physical", F.when(embedded, F.col("entity")).otherwise(F.col("physical")))
    return _tables("typegoose", entities, fields, relations.unionByName(held, allowMissingColumns=True))


def _jvm(files: DataFrame, of: Classes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both languages of the platform: members of Java have their type first, properties of Kotlin behind a colon."""
    java = _decorated(files, of, ["java"], _JAVA_CLASS, _JAVA_MEMBERS)
    kotlin = _decorated(files, of, ["kt", "kts"], _KOTLIN_CLASS, _KOTLIN_MEMBERS)
    return tuple(a.unionByName(b) for a, b in zip(java, kotlin))


def jpa(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and mapped superclasses; members without annotation are fields that are inferred."""
    return _jvm(files, Classes("jpa", "table", r"@Entity\b|@MappedSuperclass\b", r"@(?:Entity|MappedSuperclass)\b", r"@(?:\w+:)?(?:OneToOne|OneToMany|ManyToOne|ManyToMany)\b", r"targetEntity\s*=\s*(\w+)", r"@Table\([^)]*name\s*=\s*\"([^\"]+)", convention=True))


def spring_data(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, whose members are fields by convention. Statements in the bodies of methods have no modifiers, and so are none."""
    return _jvm(files, Classes("spring-data", "collection", r"org\.springframework\.data\.mongodb", r"@Document\b", r"@(?:DBRef|DocumentReference)\b", r"^$(.)", r"@Document\(\s*(?:(?:collection|value)\s*=\s*)?\"([^\"]+)", convention=True))


def _braced(files: DataFrame, name: str, extensions: list[str], gate: str, head: str, closing: str, member: str, names: str, kind: str, link: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structs or classes whose members are one to a line: their names, types and what follows."""
    rows = _blocks(files, extensions, gate, head, closing).withColumn("entity", F.regexp_extract("head", head, 1)).withColumnRenamed("path", "file")
    entities = rows.where("number = block").select("entity", F.lit(kind).alias("kind"), text.plural(text.snake_case(F.col("entity"))).alias("physical"), "file", F.col("block").alias("line"))
    body = rows.where((F.col("number") > F.col("block")) & F.col("line").rlike(member)).select("file", "entity", F.col("number").alias("pos"), *(F.regexp_extract("line", member, i).alias(n) for i, n in enumerate(names.split(), 1)))
    rest = F.col("rest")
    pk = rest.rlike("(?i)primary_?key|autoIncrement")
    linked = F.col("type").rlike(link) | rest.rlike(link)
    column = F.nullif(F.regexp_extract(rest, r"\bcolumn:([\w.]+)|\bnamed\(\s*['\"]([^'\"]+)", 1), F.lit(""))
    fields = body.select(
        "file", "entity", "pos", "field", F.coalesce(column, F.nullif(F.regexp_extract(rest, r"\bnamed\(\s*['\"]([^'\"]+)", 1), F.lit(""))).alias("stored"), "type", pk.alias("pk"), F.when(rest.rlike("(?i)unique"), True).alias("uniq"),
        F.when(rest.rlike("(?i)not null"), False).when(rest.rlike(r"(?i)nullable\(") | F.col("type").startswith("*"), True).alias("nullable"), rest.rlike("(?i)autoIncrement").alias("generated"), linked.alias("related"),
    )
    relations = body.where(linked).select("file", "entity", F.col("pos").alias("line"), "field", F.coalesce(F.nullif(F.regexp_extract(rest, target, 1), F.lit("")), F.regexp_extract("type", r"(\w+)$", 1)).alias("target"), F.when(F.col("type").startswith("[]"), "many").otherwise("one").alias("kind"))
    return _tables(name, entities, fields, relations)


_STRUCT = r"^type\s+(\w+)\s+struct\s*\{"
_USES_GORM = r"\"gorm\.io/gorm\"|jinzhu/gorm"


def gorm(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structs of Go files that import GORM; a field of another such struct is a relation, an embedded gorm.Model
    brings its columns, and a TableName method tells where a struct is stored."""
    entities, fields, relations = _braced(files, "gorm", ["go"], _USES_GORM, _STRUCT, r"^\}", r"^\s+(\w+)\s+([*\[\]\w.]+)\s*(`.*`)?\s*(?://.*)?$", "field type rest", "table", r"^(?:\[\])?\*?[A-Z]\w*$", r"^$(.)")
    names = entities.select(F.col("entity").alias("target")).distinct()
    method = r"func\s+\((?:\w+\s+)?\*?(\w+\)\s*TableName\(\)\s*string\s*\{\s*return\s+\"[^\"]+)"
    own = files.where((paths.extension(F.col("path")) == "go") & F.col("content").contains("TableName"))
    told = own.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(method), F.lit(1))).alias("m"))
    told = told.select("file", F.regexp_extract("m", r"^(\w+)", 1).alias("entity"), F.regexp_extract("m", r"\"([^\"]+)$", 1).alias("_stored")).groupBy("file", "entity").agg(F.min("_stored").alias("_stored"))
    entities = entities.join(told, ["file", "entity"], "left").withColumn("physical", F.coalesce("_stored", "physical"))
    # What the embedded model declares.
    columns = [("ID", "uint", True), ("CreatedAt", "time.Time", False), ("UpdatedAt", "time.Time", False), ("DeletedAt", "gorm.DeletedAt", False)]
    rows = _blocks(files, ["go"], _USES_GORM, _STRUCT, r"^\}").where(F.col("line").rlike(r"^\s+gorm\.Model\s*(?:`.*)?$"))
    embedded = rows.select(F.col("path").alias("file"), F.regexp_extract("head", _STRUCT, 1).alias("entity"), F.col("number").alias("pos"), F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.lit(t).alias("type"), F.lit(k).alias("pk"), F.lit(True).alias("generated")) for n, t, k in columns))))
    linked = relations.join(names, "target", "left_semi")
    marked = _blocks(files, ["go"], "many2many", _STRUCT, r"^\}").where(F.col("line").contains("many2many")).select(F.col("path").alias("file"), F.regexp_extract("head", _STRUCT, 1).alias("entity"), F.regexp_extract("line", r"^\s+(\w+)", 1).alias("field"), F.lit(True).alias("_many")).distinct()
    linked = linked.join(marked, ["file", "entity", "field"], "left").withColumn("kind", F.when(F.col("_many"), "many").otherwise(F.col("kind")))
    return _tables("gorm", entities, fields.unionByName(embedded, allowMissingColumns=True), linked)


def drift(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drift tables; columns that an override of primaryKey names are keys."""
    head = r"^class\s+(\w+)\s+extends\s+Table\b"
    entities, fields, relations = _braced(files, "drift", ["dart"], r"package:drift/", head, r"^\}", r"^\s+(\w+Column)\s+get\s+(\w+)\s*=>\s*(.*)$", "type field rest", "table", r"references\(", r"references\(\s*(\w+)")
    key = r"\bget\s+primaryKey\s*=>\s*\{([^}]*)\}"
    own = _blocks(files, ["dart"], r"package:drift/", head, r"^\}").where(F.col("line").rlike(key))
    keys = own.select(F.col("path").alias("file"), F.regexp_extract("head", head, 1).alias("entity"), F.explode(F.split(F.regexp_extract("line", key, 1), r"\s*,\s*")).alias("field"), F.lit(True).alias("_pk")).distinct()
    fields = fields.join(keys, ["file", "entity", "field"], "left").withColumn("pk", F.col("pk") | F.coalesce("_pk", F.lit(False)))
    return _tables("drift", entities, fields, relations)


# Constructors of document fields.
DOCUMENT_TYPES = "String Number Date Boolean Buffer ObjectId Mixed Decimal128 Map Array BigInt UUID Double Int32 Set Object".split()
#: A literal without a type is a document within a document, followed to this depth.
NESTED = 3


def mongoose(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schemas of Mongoose and Dynamoose, named by their model; one that no model takes is embedded, under the name of its variable.

    A schema's literal and all literals below it are groups of the lexer's table. A group with a `type` that names a constructor or a schema
    describes one field, and its parts are options; parts of all other groups are fields, named by the keys on the way to them.
    """
    chosen = files.where(paths.extension(F.col("path")).isin("ts", "js", "tsx", "jsx", "mjs", "cjs") & F.col("content").rlike(r"['\"](?:mongoose|dynamoose)['\"]"))
    rows = lexed(chosen, "slash").withColumnRenamed("path", "file").where("closed")
    rows = saved(rows)  # read many times below
    alias = chosen.select(F.col("path").alias("file"), F.nullif(F.regexp_extract("content", r"\bSchema\s*(?:\bas\b|:)\s*(\w+)\s*[,}]", 1), F.lit("")).alias("_schema"))
    call = lambda name: rf"\bnew\s+(?:\w+\s*\.\s*)*({name})\s*(?:<[^;]*>)?\s*$"
    assigned = r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*new\s[^=]*$"
    calls = rows.where("bracket = '('")
    made = calls.where(F.col("head").rlike(call(r"\w+"))).join(alias, "file").where(F.regexp_extract("head", call(r"\w+"), 1).isin("Schema") | (F.regexp_extract("head", call(r"\w+"), 1) == F.col("_schema")))
    option = F.nullif(F.regexp_extract("text", r"\b(?:collection|tableName)\s*:\s*['\"]([^'\"]+)", 1), F.lit(""))
    schemas = made.groupBy("file", F.col("id").alias("call"), F.nullif(F.regexp_extract("head", assigned, 1), F.lit("")).alias("variable"), _line_of("head", call(r"\w+"), "opened")).agg(F.max(F.when(F.col("part") == 1, option)).alias("collection"))
    roots = rows.where("bracket = '{' AND up_part = 0").select("file", F.col("up").alias("call"), F.col("id").alias("root")).distinct()
    schemas = schemas.join(roots, ["file", "call"])
    model = r"(?:^|[^\w$.])(?:\w+\s*\.\s*)*model\s*(?:<[^<>()]*>)?\s*$"
    literal = r"^['\"`]([^'\"`]*)['\"`]$"
    at = lambda i: F.max(F.when(F.col("part") == i, F.col("text")))
    models = calls.where(F.col("head").rlike(model)).groupBy("file", "id").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
    models = models.where(F.col("a").rlike(literal)).select("file", F.regexp_extract("b", r"(\w+)\s*$", 1).alias("variable"), F.regexp_extract("a", literal, 1).alias("model"), F.nullif(F.regexp_extract(F.coalesce("c", F.lit("")), literal, 1), F.lit("")).alias("named"))
    models = ranking.prefer(models, ["file", "variable"], F.col("model"))
    stripped = F.regexp_replace("variable", r"(?:_?[Ss]chema|_?[Mm]odel|_?[Dd]ef)$", "")
    plain = F.when(stripped == "", F.col("variable")).otherwise(stripped)
    own = F.coalesce(F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20)), F.lit("Schema"))
    placed = saved(schemas.join(models, ["file", "variable"], "left").withColumn("entity", F.coalesce("model", own)))

    # Parts below a schema's literal, each with the way from there.
    below = rows.select("*", F.explode(F.transform("chain", lambda c: c.id)).alias("root")).join(placed.select("file", "root", "entity"), ["file", "root"])
    way = F.filter("chain", lambda c: c.id > F.col("root"))  # groups are numbered as they open
    below = below.where("bracket IN ('{', '[')").withColumn("way", way).where(~F.exists("way", lambda c: c.bracket == "("))
    value = F.col("value")
    inner = F.regexp_replace(value, r"^\[\s*|\s*,?\s*\]$", "")
    last = F.regexp_extract(inner, r"^(?:[\w$]+\s*\.\s*)*([A-Za-z_$][\w$]*)$", 1)
    variables = placed.where("variable IS NOT NULL").select("file", F.col("variable").alias("_name"), F.lit(True).alias("_known")).distinct()
    entries = saved(below.where("bracket = '{' AND key IS NOT NULL").withColumn("_name", last).join(variables, ["file", "_name"], "left").withColumn("_scalar", F.col("_name").isin(*DOCUMENT_TYPES)))
    named = F.col("_scalar") | F.coalesce("_known", F.lit(False))
    described = entries.where((F.col("key") == "type") & named & (F.col("id") != F.col("root"))).select("file", "root", F.col("id").alias("group"), F.col("_name").alias("d_type"), F.col("_known").alias("d_known"), value.startswith("[").alias("d_many"))
    options = entries.join(described.select("file", "root", F.col("group").alias("id")), ["file", "root", "id"]).groupBy("file", "root", F.col("id").alias("group")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("options"))
    inside = entries.select("file", "root", "id", "part", F.explode(F.transform("way", lambda c: c.id)).alias("group")).join(described, ["file", "root", "group"], "left_semi").select("file", "root", "id", "part").distinct()
    depth = F.size(F.filter("way", lambda c: c.bracket == "{"))
    prefix = F.aggregate("way", F.lit(""), lambda a, c: F.concat(a, F.coalesce(F.concat(F.when(a == "", "").otherwise("."), c.key), F.lit("")), F.when(c.bracket == "[", "[]").otherwise("")))
    found = entries.join(inside, ["file", "root", "id", "part"], "left_anti").withColumn("_prefix", prefix).where(depth <= NESTED)
    # A part's own literal, in brackets or not.
    wrapped = (F.size("chain") > 1) & (F.get("chain", F.size("chain") - 2)["bracket"] == "[")
    held = below.where("bracket = '{' AND part = 0 AND id <> root").withColumn("_w", wrapped).select("file", "root", F.col("id").alias("group"), F.when(F.col("_w"), F.get("chain", F.size("chain") - 3)["id"]).otherwise(F.col("up")).alias("id"), F.when(F.col("_w"), F.get("chain", F.size("chain") - 2)["part"]).otherwise(F.col("up_part")).alias("part"))
    held = ranking.prefer(held, ["file", "root", "id", "part"], F.col("group")).join(described, ["file", "root", "group"], "left").join(options, ["file", "root", "group"], "left")
    told = found.join(held, ["file", "root", "id", "part"], "left")
    name = F.concat(F.col("_prefix"), F.when(F.col("_prefix") == "", "").otherwise("."), F.col("key"))
    set_to = lambda k: F.col("options")[k]
    many = value.startswith("[") | F.coalesce("d_many", F.lit(False))
    kind = F.when(F.col("d_type").isNotNull(), F.col("d_type")).when(inner.startswith("{"), "object").when(value.rlike(r"^\[\s*\]$"), "Array").when(F.col("_name") != "", F.col("_name")).otherwise("unknown")
    reference = F.nullif(F.element_at(F.split(F.regexp_replace(F.coalesce(set_to("ref"), set_to("refPath")), r"^\(\)\s*=>\s*|['\"`]", ""), "\\."), -1), F.lit(""))
    described_ = F.col("d_type").isNotNull()
    embeds = F.when(described_, F.coalesce("d_known", F.lit(False))).otherwise(F.coalesce("_known", F.lit(False)))
    told = told.select(
        "file", "entity", "line", "at", name.alias("field"), F.concat(kind, F.when(many & (kind != "Array"), "[]").otherwise("")).alias("type"), F.regexp_replace(set_to("alias"), "['\"`]", "").alias("stored"),
        ((name == "_id") | F.coalesce(set_to("hashKey") == "true", F.lit(False))).alias("pk"), F.when(set_to("unique") == "true", True).alias("uniq"), F.when(set_to("required") == "true", False).alias("nullable"), (reference.isNotNull() | embeds).alias("related"),
        F.when(~described_ & ~inner.startswith("{") & ~F.col("_scalar") & ~embeds & ~value.rlike(r"^\[\s*\]$"), True).alias("inferred"), F.coalesce(reference, F.when(embeds, F.coalesce("d_type", "_name"))).alias("target"),
        F.when(reference.isNull(), F.when(many, "embeds-many").otherwise("embeds")).otherwise(F.when(many, "many").otherwise("one")).alias("kind"),
    )
    told = saved(told)
    fields = told.withColumn("pos", F.row_number().over(Window.partitionBy("file", "entity").orderBy("at")))
    relations = told.where("target IS NOT NULL")
    kind = F.when(F.col("model").isNull(), "embedded").otherwise("collection").alias("kind")
    physical = F.coalesce("collection", "named", F.when(F.col("model").isNull(), F.col("entity")).otherwise(text.plural(F.lower("model"))))
    full = placed.join(fields.select("file", "entity").distinct().withColumn("_full", F.lit(True)), ["file", "entity"], "left").where("model IS NOT NULL OR _full")
    entities = full.select("entity", kind, physical.alias("physical"), F.col("variable").alias("alias"), "file", "line")
    return _tables("mongoose", entities, fields, relations)


#: Folders with their roots up to this number are broadcast; more are joined by shuffle.
FOLDERS = 1 << 17

#: Each reader with the extensions of its files and what one of them has to hold for it to read any.
READERS = {
    prisma: ("prisma", r"\b(?:model|view|enum)\b"), sql_ddl: ("sql", r"(?i)\b(?:create|alter)\s+table\b"), django: ("py", r"\bdjango\b"), mongoengine: ("py", r"\bmongoengine\b"), beanie: ("py", r"\bbeanie\b"),
    typeorm: ("ts js", "typeorm"), typegoose: ("ts js", "@typegoose/typegoose"), jpa: ("java kt kts", r"@Entity\b|@MappedSuperclass\b"), spring_data: ("java kt kts", r"org\.springframework\.data\.mongodb"),
    gorm: ("go", r"gorm\.io/gorm|jinzhu/gorm"), drift: ("dart", "package:drift/"), mongoose: ("ts js tsx jsx mjs cjs", "mongoose|dynamoose"),
}


def _needed(files: DataFrame) -> list:
    """The readers that some file is for, by one pass over the files; one at least."""
    extension = paths.extension(F.col("path"))
    fits = [F.max(extension.isin(*x.split()) & F.col("content").rlike(gate)).alias(f"_{i}") for i, (x, gate) in enumerate(READERS.values())]
    row = files.agg(*fits).first()
    return [reader for reader, found in zip(READERS, row) if found] or [sql_ddl]


# Files that make a folder a project of a library's.
_SCRIPTS, _JVM, _PYTHON = "package.json pnpm-workspace.yaml yarn.lock", "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts", "pyproject.toml requirements.txt Pipfile"
MANIFESTS = {
    "typeorm": _SCRIPTS, "mongoose": _SCRIPTS, "typegoose": _SCRIPTS, "jpa": _JVM, "spring-data": _JVM, "django": "manage.py " + _PYTHON, "mongoengine": "manage.py " + _PYTHON,
    "beanie": _PYTHON, "gorm": "go.mod", "drift": "pubspec.yaml pubspec.yml",
}


def schema_roots(placed: DataFrame, files: DataFrame) -> DataFrame:
    """variant, file, root: the nearest folder above each file (variant, file) that holds a manifest of its library; without one what lies
    before the first src, source, lib or server folder that isn't the first; else `.`."""
    kinds = F.create_map(*(F.lit(x) for kind, names in MANIFESTS.items() for x in (kind, names)))
    known = files.select(paths.basename(F.col("path")).alias("_m"), paths.dirname(F.col("path")).alias("_above")).where(F.col("_m").isin(*{x for v in MANIFESTS.values() for x in v.split()})).distinct()
    own = placed.select("variant", "file").distinct()
    above = own.select("variant", "file", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("file")))).alias("_above"))
    fits = above.join(known, "_above").where(F.array_contains(F.split(kinds[F.col("variant")], " "), F.col("_m")))
    nearest = fits.groupBy("variant", "file").agg(F.max_by("_above", F.length("_above")).alias("_root"))
    marker = r"\A(?!(?:src|source|lib|server)/)(.+?)/(?:src|source|lib|server)/.*"
    guess = F.when(F.col("file").rlike(marker), F.regexp_extract("file", marker, 1)).otherwise(".")
    return own.join(nearest, ["variant", "file"], "left").select("variant", "file", F.when(F.col("_root") == "", ".").otherwise(F.coalesce("_root", guess)).alias("root"))


def declared(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities with ids, fields and relations by name, of all readers. Fields and relations are read when they are asked for."""
    found = [reader(files) for reader in _needed(files)]
    entities, fields, relations = (reduce(DataFrame.unionByName, x) for x in zip(*found))
    # Every file with facts has an entity, so the places of these are enough.
    by_file = F.col("variant").isin("prisma", "sql")
    entities = saved(entities)
    # A file's root depends on its folder alone, so one file stands for all of a folder.
    folder = paths.dirname(F.col("file")).alias("_folder")
    one = entities.where(~by_file).groupBy("variant", folder).agg(F.min("file").alias("file"))
    roots = saved(schema_roots(one.select("variant", "file"), files).select("variant", folder, "root"))
    roots = F.broadcast(roots) if roots.count() <= FOLDERS else roots

    def placed(frame: DataFrame) -> DataFrame:
        scope = F.when(by_file, F.col("file")).otherwise(F.coalesce("root", F.lit(".")))
        return frame.withColumn("_folder", paths.dirname(F.col("file"))).join(roots, ["variant", "_folder"], "left").withColumn("variant", F.concat_ws(":", "variant", scope)).select(*frame.columns)

    entities = placed(entities).withColumn("id", ids.entity_id("entity", F.col("entity"), F.col("variant"), F.col("file"), F.col("entity")))
    return saved(entities), placed(fields).distinct(), placed(relations)


def data_model(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities with ids, fields and resolved relations of all readers."""
    entities, fields, relations = declared(files)
    return entities, fields, resolve(entities, relations)


def resolve(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """relations with target_id, confidence and state: exact for one entity of that name in the variant, else unresolved
    (none, or ambiguous for several). A qualified name is looked for before its last part. Repeated relations are one."""
    last = lambda c: F.lower(F.element_at(F.split(c, "\\."), -1))
    names = F.array_distinct(F.array_compact(F.array(F.lower("entity"), last("entity"), F.lower("physical"), last("physical"), F.lower("alias"))))
    aliases = entities.select("variant", "id", F.explode(names).alias("_alias")).distinct().groupBy("variant", "_alias").agg(F.count("*").alias("_n"), F.min("id").alias("target_id"))
    own = entities.groupBy("variant", "file", "entity").agg(F.min("id").alias("source_id"))
    wanted = relations.distinct().withColumn("_alias", F.lower("target"))
    qualified = wanted.join(aliases, ["variant", "_alias"], "left")
    simple = aliases.withColumnsRenamed({"_alias": "_last", "_n": "_n2", "target_id": "_id2"})
    both = qualified.withColumn("_last", last("target")).join(simple, ["variant", "_last"], "left").join(own, ["variant", "file", "entity"], "left")
    n, id_ = F.coalesce("_n", "_n2", F.lit(0)), F.coalesce("target_id", "_id2")
    state = F.when(n == 1, "resolved").when(n == 0, "missing").otherwise("ambiguous")
    return both.select(*RELATION, "source_id", F.when(n == 1, id_).alias("target_id"), F.when(n == 1, "exact").otherwise("unresolved").alias("confidence"), state.alias("state"))


def placeholders(relations: DataFrame) -> DataFrame:
    """id, variant, entity: one node for each target of a variant that no entity answers to."""
    missing = relations.where("confidence = 'unresolved'").select("variant", F.col("target").alias("entity")).distinct()
    return missing.select(ids.entity_id("unresolved", F.col("entity"), F.col("variant"), F.col("entity")).alias("id"), "variant", "entity")


def without_inverses(relations: DataFrame) -> DataFrame:
    """Of two entities that name each other, the side that owns: to-many relations go where a to-one leads back; of two to-one
    relations that annotations tie to each other one stays: that of the entity first by name."""
    back = relations.where("kind = 'one' AND target_id IS NOT NULL").select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.lit(True).alias("_back")).distinct()
    both = relations.join(back, ["source_id", "target_id"], "left")
    mutual = F.coalesce("_back", F.lit(False)) & (F.col("source_id") != F.col("target_id"))
    double = (F.col("kind") == "one") & F.col("variant").rlike("^(?:typeorm|jpa)") & (F.lower("entity") > F.lower("target"))
    return both.where(~(mutual & ((F.col("kind") == "many") | double))).select(*relations.columns)


def diagnostics(relations: DataFrame) -> DataFrame:
    """code, severity, message, file, line of relations that don't resolve; one for each."""
    bad = relations.where("confidence = 'unresolved'")
    told = F.concat_ws(" ", F.concat_ws(".", "entity", "field"), F.lit("names"), "target", F.lit("which is"), "state")
    return bad.select(F.lit("DB_RELATION_UNRESOLVED").alias("code"), F.lit("info").alias("severity"), told.alias("message"), "file", "line").distinct()


def unclosed(files: DataFrame) -> DataFrame:
    """code, severity, message, file, line of tables whose definition has no end; they are no entities."""
    open_ = lexed(files.where((paths.extension(F.col("path")) == "sql") & F.col("content").rlike(r"(?i)\bcreate\b")), "dash").where((F.col("bracket") == "(") & ~F.col("closed") & F.col("head").rlike(CREATED))
    told = F.concat(F.lit("The definition of table "), _unquoted(F.regexp_extract("head", CREATED, 1)), F.lit(" has no end."))
    return open_.select(F.lit("DB_PARSE_PARTIAL").alias("code"), F.lit("warning").alias("severity"), told.alias("message"), F.col("path").alias("file"), _line_of("head", CREATED, "opened")).distinct()
