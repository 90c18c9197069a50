from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from weft.operators import flow, lexer, schema
from weft.sources.files import FILES


def table(spark, files: dict[str, str]):
    return spark.createDataFrame([(p, c, len(c.encode())) for p, c in files.items()], FILES)


def tops(text: str) -> list[str]:
    """Parts at the top by a plain scan of texts without strings and comments."""
    depth, out = 0, [""]
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c in ",;" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def test_parts_against_a_plain_scan():
    rng = random.Random(2)

    def made(depth: int) -> str:
        out = []
        for _ in range(rng.randint(1, 5)):
            out.append(rng.choice(["a", "b c", "\n", "k: v", ", ", "; "]))
            if depth and rng.random() < 0.6:
                a, b = rng.choice(["()", "[]", "{}"])
                out.append(a + made(depth - 1) + b)
        return "".join(out)

    for _ in range(300):
        text = made(4)
        rows = list(lexer.parts(text, "slash"))
        assert [r[12] for r in sorted(rows, key=lambda r: r[9] or 0) if r[0] == 0 and r[12]] == tops(text)
        assert all(r[13] for r in rows) and all(text[r[9] :].startswith(r[12]) for r in rows if r[12])
        assert all(r[8] == text[: r[9]].count("\n") + 1 for r in rows if r[12])


def test_strings_comments_and_open_brackets():
    rows = list(lexer.parts("f(a, 'x, (', /* b, ( */ c // , d\n, `e)`", "slash"))
    assert [(r[12], r[13]) for r in rows if r[0] == 1] == [("a", False), ("'x, ('", False), ("c", False), ("`e)`", False)]
    assert [r[12] for r in lexer.parts("a -- b, c\n, d", "dash")] == ["a", "d"]
    assert [(r[2], r[12]) for r in lexer.parts("x()", "slash")] == [("(", ""), ("", "x()")]
    assert list(lexer.parts("", "slash"))[0][12] == ""


def test_time_grows_with_the_text():
    for text in ("/*" + "* x\n" * 250_000 + "*/ create table t (a int)", "create table t (" + ",\n".join(f"c{i} int" for i in range(50_000)) + ")", "(" * 200_000, "'" * 100_001, "a" * 1_000_000 + "("):
        start = time.perf_counter()
        assert sum(1 for _ in lexer.parts(text, "slash")) > 0
        assert time.perf_counter() - start < 10


def test_wide_tables_and_long_comments(spark):
    columns = ",\n".join(f"c{i} decimal(10,2) not null default 'a,)b'" for i in range(5000))
    sql = f"create table wide (\n{columns},\n primary key (c1, c2), constraint u unique (c3), foreign key (c4) references \"x y\".[t t] (id)\n);\n/*" + " * stars **\n" * 90_000
    sql += "*/\ncreate table if not exists a.b (id int generated always as identity primary key, z timestamp with time zone null);\nalter table only a.b add constraint k foreign key (z) references wide (c1);\ncreate table open (x int"
    files = table(spark, {"s/a.sql": sql})
    entities, fields, relations = schema.data_model(files)
    assert {(r.entity, r.line) for r in entities.collect()} == {("wide", 1), ("a.b", 95_005)}
    own = {(r.entity, r.field): r for r in fields.collect()}
    assert len(own) == 5002 and own["wide", "c4999"].type == "decimal(10,2)" and own["wide", "c2"].pk and own["wide", "c3"].uniq and not own["wide", "c4"].pk
    assert own["a.b", "id"].generated and own["a.b", "z"].type == "timestamp with time zone" and own["a.b", "z"].nullable
    assert {(r.entity, r.field, r.target, r.state) for r in relations.collect()} == {("wide", "c4", "x y.t t", "missing"), ("a.b", "z", "wide", "resolved")}
    told = schema.unclosed(files).collect()
    assert [(r.code, r.line) for r in told] == [("DB_PARSE_PARTIAL", 95_007)] and "open" in told[0].message


DOCUMENTS = """const mongoose = require('mongoose');
const geo = new mongoose.Schema({ lat: Number, lon: { type: Number, required: true } }, { _id: false });
const userSchema = new mongoose.Schema({
  name: { type: String, required: true, unique: true, alias: 'n' },
  a: { b: { c: { d: { e: String } } } },
  where: geo,
  places: [geo],
  list: [{ x: Number, y: { z: Date } }],
  friends: [{ type: Schema.Types.ObjectId, ref: 'Gone' }],
  type: String,
  odd: Foo,
  empty: [],
  fn: { type: String, validate: { validator: function (v) { return { type: String }; } } },
}, { collection: 'people' });
module.exports = mongoose.model('User', userSchema);
"""


def test_documents_within_documents(spark):
    entities, fields, relations = schema.data_model(table(spark, {"d/v.js": DOCUMENTS}))
    assert {(r.entity, r.kind, r.physical, r.line) for r in entities.collect()} == {("Geo", "embedded", "Geo", 2), ("User", "collection", "people", 3)}
    got = [(r.field, r.type) for r in fields.where("entity = 'User'").orderBy("pos").collect()]
    assert got == [
        ("name", "String"), ("a", "object"), ("a.b", "object"), ("a.b.c", "object"), ("a.b.c.d", "object"), ("where", "geo"), ("places", "geo[]"), ("list", "object[]"), ("list[].x", "Number"), ("list[].y", "object"),
        ("list[].y.z", "Date"), ("friends", "ObjectId[]"), ("type", "String"), ("odd", "Foo"), ("empty", "Array"), ("fn", "String"),
    ]
    name = fields.where("field = 'name'").first()
    assert name.uniq and name.nullable is False and name.stored == "n" and fields.where("inferred").first().field == "odd"
    assert {(r.field, r.target, r.kind, r.state) for r in relations.collect()} == {("where", "geo", "embeds", "resolved"), ("places", "geo", "embeds-many", "resolved"), ("friends", "Gone", "many", "missing")}


def test_names_resolve_within_their_project(spark):
    one = "import { Entity } from 'typeorm';\n@Entity('people')\nexport class User {\n  @PrimaryColumn()\n  id: number;\n  @ManyToOne(() => User)\n  boss: User;\n  plain: string;\n}\n"
    two = "import { Entity } from 'typeorm';\n@Entity()\nclass User {\n  @PrimaryGeneratedColumn() code: number;\n  @ManyToOne(() => User)\n  boss: User;\n}\n"
    entities, fields, relations = schema.data_model(table(spark, {"p1/package.json": "{}", "p2/package.json": "{}", "p1/src/u.ts": one, "p2/src/u.ts": two, "x/src/a.py": "from django.db import models\nclass A(models.Model):\n    pass\n"}))
    assert {(r.variant, r.entity) for r in entities.collect()} == {("typeorm:p1", "User"), ("typeorm:p2", "User"), ("django:x", "A")}
    assert {(r.variant, r.field) for r in fields.collect()} == {("typeorm:p1", "id"), ("typeorm:p1", "boss"), ("typeorm:p2", "code"), ("typeorm:p2", "boss"), ("django:x", "id")}
    assert {(r.variant, r.state) for r in relations.collect()} == {("typeorm:p1", "resolved"), ("typeorm:p2", "resolved")}
    ids = {r.variant: r.id for r in entities.collect()}
    assert all(r.target_id == ids[r.variant] for r in relations.collect())


def test_members_of_other_readers(spark):
    java = '@Entity\npublic class Book {\n  @Id @GeneratedValue\n  private Long id;\n  private String title;\n  @Transient\n  private String tmp;\n  public static final int N = 1;\n  @Column(name = "pages_n", nullable = false)\n  public int getPages() {\n    return 1;\n  }\n  @ManyToOne private Author author;\n}\n'
    prisma = 'enum Role {\n  A\n  B\n}\nmodel U {\n  id Int @id @default(autoincrement())\n  role Role @default(A)\n  posts P[] @relation("x")\n  liked P[] @relation(name: "y")\n}\nmodel P {\n  id Int @id @map("p_id")\n  u U @relation("x", fields: [id], references: [id])\n  by U[] @relation("y")\n}\n'
    goose = "import { prop, getModelForClass } from '@typegoose/typegoose';\nclass Inner {\n  @prop()\n  x: string;\n}\nclass Outer {\n  @prop({ required: true })\n  inner: Inner;\n}\nexport const M = getModelForClass(Outer);\n"
    entities, fields, relations = schema.data_model(table(spark, {"J.java": java, "p.prisma": prisma, "t.ts": goose}))
    own = {(r.entity, r.field): r for r in fields.collect()}
    assert {f for e, f in own if e == "Book"} == {"id", "title", "pages", "author"}
    assert own["Book", "id"].generated and own["Book", "title"].inferred and own["Book", "pages"].stored == "pages_n" and own["Book", "pages"].nullable is False and own["Book", "author"].related
    assert own["U", "id"].generated and not own["U", "role"].generated and own["Role", "A"].type == "enum value" and own["P", "id"].stored == "p_id"
    kinds = {r.entity: (r.kind, r.physical) for r in entities.collect()}
    assert kinds["Role"] == ("enum", "Role") and kinds["Inner"] == ("embedded", "Inner") and kinds["Outer"][0] == "collection"
    links = {(r.entity, r.field): (r.target, r.name) for r in relations.where("variant LIKE 'prisma%'").collect()}
    assert links == {("U", "role"): ("Role", None), ("P", "u"): ("U", "x"), ("P", "by"): ("U", "y")}
    assert relations.where("entity = 'Outer'").first().kind == "embeds"


def test_flows_of_long_lines(spark):
    long = "function big(" + ", ".join(f"p{i} = g({i})" for i in range(1500)) + ") {\n  if (ready(1) && other) {\n    db.query(1);\n  }\n}\nfunction two() {\n  big();\n}\n"
    nodes, edges = flow.flow_graph(table(spark, {"a.js": long}))
    assert {(r.kind, r.label) for r in nodes.collect()} >= {("step", "big"), ("step", "two"), ("decision", "ready(1) && other"), ("io", "db.query")}
    assert ("call", "callable:a.js:6", "callable:a.js:1") in {(r.kind, r.src, r.dst) for r in edges.collect()}


def test_packing_of_a_service(spark):
    rng = random.Random(4)
    rows = [(f"m{i % 3}", f"f{i:03}", rng.randint(0, 40), rng.randint(1, 70)) for i in range(400)]

    def expected(module: str) -> set[str]:
        total, kept = 0, []
        for _, unit, _, nodes in sorted((r for r in rows if r[0] == module), key=lambda r: (-r[2], r[1])):
            if not kept or total + nodes <= 64:
                kept.append(unit)
                total += nodes
        return set(kept)

    frame = spark.createDataFrame(rows, "module string, unit string, score long, nodes long")
    got = {m: {r.unit for r in flow.packed(frame).where(F.col("module") == m).collect()} for m in ("m0", "m1", "m2")}
    assert got == {m: expected(m) for m in got}
