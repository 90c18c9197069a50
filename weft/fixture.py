"""A small workspace in several languages, to try the operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.sources.files import FILES

SOURCES = {
    "package.json": '{"dependencies": {"react": "18", "typeorm": "0.3", "mongoose": "8"}}\n',
    "src/ui/Deck.tsx": "import React from 'react';\nimport {\n  load,\n} from '../api/ships';\nexport const Deck = () => load();\n",
    "src/api/ships.ts": "import type { Ship } from '@/domain/ship';\nimport './gone';\nexport async function load(id: string): Promise<Ship> {\n  if (id) {\n    return db.query(id);\n  } else {\n    fail();\n  }\n}\nfunction fail() {\n  throw 1;\n}\n",
    "src/domain/ship.ts": "export interface Ship {}\n",
    "src/api/ships.controller.ts": "@Controller('ships')\nexport class Ships {\n  @Get(':id')\n  async find(id: string) {\n    return load(id);\n  }\n}\n",
    "src/documents/voyage.js": "const mongoose = require('mongoose');\nconst berth = new mongoose.Schema({\n  lat: Number,\n});\nconst voyage = new mongoose.Schema({\n  name: { type: String, required: true },\n  where: berth,\n  harbour: { type: mongoose.Schema.Types.ObjectId, ref: 'Harbour' },\n}, { collection: 'voyage_book' });\nmodule.exports = mongoose.model('Voyage', voyage);\n",
    "app/models.py": "from django.db import models\n\nclass Crew(models.Model):\n    name = models.CharField(max_length=9, unique=True)\n\nclass Sailor(models.Model):\n    crew = models.ForeignKey('Crew', on_delete=models.CASCADE)\n",
    "app/views.py": "from .models import Crew\nfrom fastapi import FastAPI\n\n@app.get('/crews')\ndef crews():\n    return Crew.objects.all()\n",
    "app/test_views.py": "from .views import crews\n",
    "prisma/schema.prisma": "model Ship {\n  id Int @id\n  email String? @unique\n  cargoes Cargo[]\n  @@map(\"ships\")\n}\n\nmodel Cargo {\n  id Int @id\n  carrier Ship @relation(fields: [id], references: [id])\n}\n",
    "db/tables.sql": "CREATE TABLE orders (\n  id bigint PRIMARY KEY,\n  price decimal(10,2) NOT NULL,\n  customer_id int REFERENCES customers(id)\n);\nCREATE TABLE customers (id int, name text, PRIMARY KEY (id));\n",
    "go/go.mod": "module example.com/shop\n",
    "go/cmd/api/main.go": "package main\n\nimport (\n\t\"fmt\"\n\t\"example.com/shop/internal/store\"\n\t\"github.com/gin-gonic/gin\"\n)\n\nfunc main() {\n\tr.GET(\"/ping\", ping)\n\tr.Run(\":8080\")\n}\n\nfunc ping() {\n}\n",
    "go/internal/store/store.go": "package store\n",
    "Dockerfile": "FROM scratch\nEXPOSE 5432 9092/tcp\n",
    "compose.yml": "services:\n  web:\n    ports:\n      - \"8080:80\"\n    image: web\n",
    "svc/greeter.proto": "syntax = \"proto3\";\nservice Greeter {\n  rpc Hello (Q) returns (R);\n}\n",
}


def workspace_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c, len(c.encode())) for p, c in SOURCES.items()], FILES)
