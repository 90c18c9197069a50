"""A source workspace written from relational tables, so that it grows with them and SQL can say what is in it.

Each part is a TypeScript file of its brand's package that imports what its lines deliver; suppliers are SQL files, customers
Django models, nations Docker images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _brand(column: str) -> Column:
    return F.replace(F.col(column), F.lit("#"), F.lit(""))


def table_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, size of the files."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part = read("part").select(F.col("p_partkey").alias("p"), _brand("p_brand").alias("b"), F.col("p_size").alias("z"))
    links = read("lineitem").select(F.col("l_partkey").alias("p"), (F.col("l_suppkey") * 7).alias("q")).distinct()
    named = links.join(part.select(F.col("p").alias("q"), F.col("b").alias("qb")), "q", "left")
    near = (F.col("q") % 3 == 0) | F.col("qb").isNull()
    spec = F.when(near, _text("./p", F.col("q"))).otherwise(_text("../../", F.col("qb"), "/src/p", F.col("q")))
    # A part's lines stay few: it has as many as suppliers deliver it.
    lists = named.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("q", spec.alias("spec")))).alias("found"))
    imports = F.concat_ws("", F.transform("found", lambda x: F.concat(F.lit("import a"), x.q.cast("string"), F.lit(" from '"), x.spec, F.lit("';\n"))))
    p = F.col("p")
    body = _text(
        F.coalesce(imports, F.lit("")), "import e from 'pkg-", F.col("z"), "';\napp.get('/parts/", p, "', show", p, ");\nexport function show", p, "(id) {\n  if (id) {\n    return db.query(id);\n  }\n}\n"
    )
    code = part.join(lists, "p", "left").select(_text("packages/", F.col("b"), "/src/p", p, ".ts").alias("path"), body.alias("content"))
    k, n = F.col("k"), F.col("n")
    supplier = read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    made = _text("CREATE TABLE t", k, " (\n  id bigint PRIMARY KEY,\n  nation int NOT NULL REFERENCES n", n, "(id),\n  name varchar(25) UNIQUE\n);\n")
    tables = supplier.select(_text("db/s", k, ".sql").alias("path"), F.concat(made, F.when(k % 2 == 0, _text("CREATE TABLE n", n, " (id int);\n")).otherwise("")).alias("content"))
    customer = read("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    model = _text("from django.db import models\n\nclass C", k, "(models.Model):\n    name = models.CharField(max_length=9, unique=True)\n    nation = models.ForeignKey('N", n, "', on_delete=models.CASCADE)\n")
    second = F.when(k % 3 == 0, _text("\nclass N", n, "(models.Model):\n    code = models.IntegerField(primary_key=True)\n")).otherwise("")
    models = customer.select(_text("app/models/c", k, ".py").alias("path"), F.concat(model, second).alias("content"))
    nation = read("nation").select(F.col("n_nationkey").alias("k"))
    images = nation.select(_text("deploy/n", k, "/Dockerfile").alias("path"), _text("FROM scratch\nEXPOSE ", k + 8000, " 9092/tcp\n").alias("content"))
    every = code.unionByName(tables).unionByName(models).unionByName(images)
    return every.select("path", "content", F.octet_length("content").cast("long").alias("size"))


def language_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, size of files in further languages: Java for customers, C# for parts, Go for suppliers, and for each nation a file in
    Rust, C, PHP, Ruby, Swift, Dart, TypeScript, JavaScript, Python and Prisma, that refers to the next nation's."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k, n, m = F.col("k"), F.col("n"), F.col("m")
    file = lambda frame, path, *content: frame.select(_text(*path).alias("path"), _text(*content).alias("content"))
    customer = read("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), ((F.col("c_nationkey") + 1) % 25).alias("m"))
    java = file(
        customer, ("jv/n", n, "/C", k, ".java"),
        "package shop.n", n, ";\nimport java.util.List;\nimport shop.n", m, ".*;\nimport org.acme.lib", k % 3, ".Tool;\n@Entity\n@Table(name = \"c_", k, "\")\npublic class C", k,
        " {\n  @Id\n  @GeneratedValue\n  private Long id;\n  private String name;\n  @ManyToOne\n  private N", n, " nation;\n  @Column(name = \"b_", k, "\", nullable = false)\n  public int getBalance() {\n    return 1;\n  }\n}\n",
    )
    part = read("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 7).alias("n"), ((F.col("p_size") + 1) % 7).alias("m"))
    sharp = file(part, ("services/g", n, "/P", k, ".cs"), "using System.Text;\nusing Shop.G", m, ";\nusing Newton.Json.L", k % 4, ";\nnamespace Shop.G", n, ";\nclass P", k, " {\n}\n")
    supplier = read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), ((F.col("s_nationkey") + 1) % 25).alias("m"))
    go = file(
        supplier, ("go/n", n, "/s", k, ".go"),
        "package n", n, "\n\nimport (\n\t\"fmt\"\n\t\"ex.org/shop/n", m, "\"\n\t\"github.com/acme/lib", k % 3, "/sub\"\n\t\"gorm.io/gorm\"\n)\n\ntype S", k,
        " struct {\n\tgorm.Model\n\tName string `gorm:\"column:nm;not null\"`\n\tPals []S", k, " `gorm:\"many2many:pals\"`\n}\n\nfunc Run", k, "(n int) {\n\tif n > ", k, " {\n\t\thelp", k, "()\n\t} else {\n\t\tdb.Query(n)\n\t}\n}\n\nfunc help", k, "() {\n}\n",
    )
    nation = read("nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") + 1) % 25).alias("m"), F.col("n_regionkey").alias("r"), ((F.col("n_regionkey") + 1) % 5).alias("q"))
    r, q = F.col("r"), F.col("q")
    each = [
        file(nation, ("rust/src/n", k, ".rs"), "use crate::n", m, "::Thing;\nuse serde::Ser;\nuse std::io;\nmod sub;\n"),
        file(nation, ("c/m", k, ".c"), "#include \"h", m, ".h\"\n// #include \"no.h\"\n#include <boost/asio.hpp>\n#include <stdio.h>\n"),
        file(nation, ("c/include/h", k, ".h"), "#pragma once\n"),
        file(nation, ("php/C", k, ".php"), "<?php\nnamespace App\\N;\nuse App\\N\\C", m, ";\nrequire './x.php';\n"),
        file(nation, ("rb/lib/f", k, ".rb"), "require_relative 'f", m, "'\nrequire 'json'\nrequire 'active_support/core'\n"),
        file(nation, ("sw/Sources/M", r, "/s", k, ".swift"), "import Foundation\nimport M", q, "\nimport Alamofire\n"),
        file(
            nation, ("da/lib/d", k, ".dart"),
            "import 'package:shop/d", m, ".dart';\nimport 'package:flutter/m.dart';\nimport 'dart:io';\nimport 'package:drift/drift.dart';\nclass D", k, " extends Table {\n  IntColumn get code => integer().references(D", m,
            ", #code)();\n  Set<Column> get primaryKey => {code};\n}\n",
        ),
        file(
            nation, ("web/e", k, ".ts"),
            "import { Entity } from 'typeorm';\n@Entity('e_", k, "')\nexport class E", k, " {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ unique: true })\n  code: string;\n  @ManyToOne(() => E", m, ")\n  next: E", m, ";\n}\n",
        ),
        file(
            nation, ("doc/m", k, ".js"),
            "const mongoose = require('mongoose');\nconst s", k, " = new mongoose.Schema({\n  name: { type: String, required: true },\n  place: { town: { code: Number } },\n  tags: [String],\n  next: { type: ObjectId, ref: 'M", m,
            "' },\n}, { collection: 'c", k, "' });\nmongoose.model('M", k, "', s", k, ");\n",
        ),
        file(nation, ("py/m", k, ".py"), "from mongoengine import Document, StringField\nfrom .m", m, " import W", m, "\n\nclass W", k, "(Document):\n    title = StringField(required=True, unique=True)\n    next = ReferenceField('W", m, "')\n"),
        file(
            nation, ("pr/p", k, ".prisma"),
            "enum Kind {\n  A\n  B\n}\nmodel P", k, " {\n  id Int @id @default(autoincrement())\n  kind Kind\n  kids Q", k, "[] @relation(\"k\")\n  @@map(\"p_", k, "\")\n}\nmodel Q", k, " {\n  id Int @id\n  top P", k, "? @relation(\"k\", fields: [id], references: [id])\n}\n",
        ),
    ]
    manifests = [("jv/pom.xml", "<project/>\n"), ("go/go.mod", "module ex.org/shop\n"), ("rust/Cargo.toml", "[package]\n"), ("da/pubspec.yaml", "name: shop\n"), ("web/package.json", '{"dependencies": {"typeorm": "1"}}\n'), ("doc/package.json", "{}\n")]
    every = spark.createDataFrame(manifests, "path string, content string")
    for frame in (java, sharp, go, *each):
        every = every.unionByName(frame)
    return every.select("path", "content", F.octet_length("content").cast("long").alias("size"))


def interface_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, size of files that offer something: for each supplier endpoints of eight kinds, for each nation ports of four."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k = F.col("k")
    file = lambda frame, path, *content: frame.select(_text(*path).alias("path"), _text(*content).alias("content"))
    s, n = read("supplier").select(F.col("s_suppkey").alias("k")), read("nation").select(F.col("n_nationkey").alias("k"))
    every = [
        file(s, ("api/s", k, ".controller.ts"), "@Controller('s", k, "')\nexport class S", k, " {\n  @Get(':id')\n  async find", k, "(id: string) {\n    return 1;\n  }\n}\n"),
        file(s, ("jv/S", k, ".java"), '@RequestMapping("/j', k, '")\npublic class J', k, ' {\n  @PostMapping("/x")\n  public String make', k, '() {\n  }\n  @KafkaListener(topics = "t', k, '")\n  public void on', k, "() {\n  }\n}\n"),
        file(s, ("py/s", k, ".py"), "@app.route('/p", k, "', methods=['GET', 'PUT'])\ndef p", k, "():\n  pass\n"),
        file(s, ("proto/s", k, ".proto"), 'syntax = "proto3";\npackage p', k, ";\nservice G {\n  rpc Hello (stream Q) returns (R);\n}\n"),
        file(s, ("gq/s", k, ".graphql"), "type Query {\n  u", k, ": Int!\n}\ntype Other {\n  x: Int\n}\n"),
        file(s, ("oa/s", k, ".yaml"), "openapi: 3.0.0\npaths:\n  /o", k, ":\n    get:\n      summary: x\n    delete:\n"),
        file(s, ("web/app/(g)/n", k, "/route.ts"), "export async function GET() {\n}\n"),
        file(s, ("ws/s", k, ".ts"), "import { io } from 'socket.io-client';\nsocket.on('m", k, "', f", k, ");\nsocket.emit('e", k, "');\n"),
        file(s, ("sse/s", k, ".py"), "from x import EventSourceResponse\ndef stream", k, "():\n  return EventSourceResponse(1)\n"),
        file(n, ("srv/n", k, ".js"), "app.listen(", k + 6000, ");\n"),
        file(n, ("k8s/n", k, ".yaml"), "ports:\n  - containerPort: ", k + 7000, "\n    protocol: TCP\n"),
        file(n, ("compose/n", k, "/compose.yml"), 'services:\n  web:\n    ports:\n      - "', k + 8000, ':80"\n'),
        file(n, ("cfg/n", k, ".properties"), "server.port=", k + 9000, "\n"),
    ]
    whole = every[0]
    for frame in every[1:]:
        whole = whole.unionByName(frame)
    return whole.select("path", "content", F.octet_length("content").cast("long").alias("size"))
