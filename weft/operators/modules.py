"""Modules of a workspace: which files belong together, what imports what, how files rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids, paths, text

from weft.operators import ranking
from weft.operators.rollup import longest_prefix
from weft.session import saved
from weft.sources.files import CODE, NAMES

# Files that mark a project, and folders that say nothing on their own.
MANIFESTS = "go.mod package.json pubspec.yaml pubspec.yml cargo.toml pom.xml build.gradle build.gradle.kts pyproject.toml setup.py composer.json gemfile package.swift cmakelists.txt build.zig".split()
CONTAINERS = "apps packages services modules src app lib cmd internal pkg sources source tests test include inc headers".split()
TEST_FOLDERS = "test tests __tests__ spec specs testing e2e it".split()
ENTRY_STEMS = "main index app server cli extension program application bootstrap".split()
ENTRY_NAMES = "manage.py __main__.py wsgi.py asgi.py conftest.py".split()
SCRIPT_STEMS = "esbuild gulpfile gruntfile karma jest babel metro nuxt next".split()
CONFIG = "json yaml yml toml ini env lock conf cfg properties gradle".split()
LANGUAGES = {
    "ts tsx": "TypeScript", "js jsx mjs cjs": "JavaScript", "vue": "Vue", "svelte": "Svelte", "py": "Python", "java": "Java", "kt kts": "Kotlin", "go": "Go", "rs": "Rust",
    "cs": "C#", "php": "PHP", "rb": "Ruby", "dart": "Dart", "swift": "Swift", "c h": "C", "cc cpp cxx hpp hh hxx": "C++",
}
ROOT = "(root)"
#: Of a module's files, and of those that tie two modules, so many are named.
EXAMPLES = 5


def project_roots(files: DataFrame) -> DataFrame:
    """root: folders that hold a project's manifest; the top of the workspace is always a project and not listed."""
    return files.where(F.lower(paths.basename(F.col("path"))).isin(*MANIFESTS)).select(paths.dirname(F.col("path")).alias("root")).where("root <> ''").distinct()


def language(path: Column) -> Column:
    extension = paths.extension(path)
    return F.coalesce(*(F.when(extension.isin(*x.split()), F.lit(name)) for x, name in LANGUAGES.items()), F.lit("Other"))


# Buckets of file types.
BUCKETS = {
    "ts": "ts tsx mts cts", "js": "js jsx mjs cjs", "py": "py pyi", "jvm": "java kt kts scala groovy", "go": "go", "rust": "rs", "ruby": "rb erb", "php": "php", "dotnet": "cs fs vb", "native": "c h cc cpp hpp cxx m mm swift",
    "dart": "dart", "schema": "sql prisma graphql gql proto", "config": "json yaml yml toml ini env lock conf properties", "docs": "md mdx txt rst adoc", "style": "css scss sass less styl",
    "markup": "html htm vue svelte xml astro", "asset": "png jpg jpeg gif svg ico webp woff woff2 ttf mp4", "shell": "sh bash zsh fish ps1",
}


def bucket(path: Column) -> Column:
    """The bucket of a file's type, by its extension; other for what has none."""
    of = {x: name for name, extensions in BUCKETS.items() for x in extensions.split()}
    found = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[paths.extension(path)]
    return F.coalesce(found, F.lit("other"))


#: Folders up to this number are broadcast with their modules; more are joined by shuffle.
FOLDERS = 1 << 17


def folder_modules(files: DataFrame) -> DataFrame:
    """folder, root, module of each folder that holds a file: both depend on nothing else of a path."""
    folder = F.col("folder")
    placed = longest_prefix(files.select(paths.dirname(F.col("path")).alias("folder")).distinct(), "folder", project_roots(files), "root", own=True)
    inside = F.when(F.col("root").isNull(), folder).otherwise(F.substring(folder, F.length("root") + 2, F.length(folder)))
    parts = F.split(inside, "/")
    take = F.when(F.lower(parts[0]).isin(*CONTAINERS) & (F.size(parts) > 1), 2).otherwise(1)
    module = F.when(inside == "", F.coalesce("root", F.lit(ROOT))).otherwise(F.concat_ws("/", "root", F.array_join(F.slice(parts, F.lit(1), take), "/")))
    found = saved(placed.select("folder", "root", module.alias("module")))
    return F.broadcast(found) if found.count() <= FOLDERS else found


def _within(frame: DataFrame, path: str, folders: DataFrame, name: str) -> DataFrame:
    """frame with `name`, the module of the folder of its path."""
    of = folders.select(F.col("folder").alias("_folder"), F.col("module").alias(name))
    return frame.withColumn("_folder", paths.dirname(F.col(path))).join(of, "_folder").drop("_folder")


def with_modules(files: DataFrame) -> DataFrame:
    """files with root (the nearest project) and module: one folder below it, or two where the first is a container."""
    return files.withColumn("folder", paths.dirname(F.col("path"))).join(folder_modules(files), "folder", "left").drop("folder")


def role(path: Column, root: Column) -> Column:
    """test, config, entry, source or other."""
    name, extension, stem = paths.basename(path), paths.extension(path), F.lower(paths.stem(path))
    folders = F.transform(F.split(paths.dirname(path), "/"), lambda x: F.lower(x))
    is_test = (
        F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | stem.rlike("\\.(?:test|spec)\\z|_test\\z|^test_") | F.lower(path).contains("__mocks__")
        | (stem.rlike("(?:tests?|spec)\\z") & extension.isin("java", "kt", "cs", "go", "rb"))
    )
    script = stem.rlike("\\.(?:config|conf|setup)\\z") | stem.isin(*SCRIPT_STEMS)
    depth = F.size(F.split(path, "/")) - F.when(root.isNull(), 0).otherwise(F.size(F.split(root, "/")))
    entry = F.lower(name).isin(*ENTRY_NAMES) | (stem.isin(*ENTRY_STEMS) & (depth <= 2))
    code = F.when(script, "config").when(entry, "entry").otherwise("source")
    return F.when(is_test, "test").when(extension.isin(*CODE), code).when(F.lower(name).isin(*NAMES) | extension.isin(*CONFIG), "config").otherwise("other")


def inventory(files: DataFrame) -> DataFrame:
    """id, module, files, languages, examples of each module of code files. No task takes a whole module: counts are added up and first paths
    are chosen before the shuffle."""
    code = with_modules(files.select("path")).where(paths.extension(F.col("path")).isin(*CODE)).select("path", "module")
    counts = code.groupBy("module").agg(F.count("*").alias("files"), F.array_sort(F.collect_set(language(F.col("path")))).alias("languages"))
    first = ranking.top(code, ["module"], [F.col("path")], EXAMPLES).groupBy("module").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    return counts.join(first, "module").select(ids.node_id("module", F.col("module")).alias("id"), "module", "files", "languages", "examples")


def module_edges(imports: DataFrame, files: DataFrame, links: DataFrame | None = None, once: bool = False) -> DataFrame:
    """src, dst, n, sources, line: imports between modules. A statement counts once for each module that it reaches; sources are its
    first five files. links (symbol, target) lists the files of the symbols that imports name: of these only the modules meet imports.

    Paths and targets are files of the workspace, whose modules are looked up by folder. once says that imports repeats no statement, as
    resolved() doesn't: one that reaches a single folder then needs no comparison with others, and is added up where it is.
    """
    folders = folder_modules(files)
    place = ["path", "specifier", "line"]
    reached = F.array_distinct(F.transform("targets", paths.dirname))
    plain = F.lit(once) & (F.size(reached) <= 1)
    if links is not None:
        plain = plain & F.col("symbol").isNull()
    of = folders.select(F.col("folder").alias("_folder"), F.col("module").alias("dst"))
    explode = lambda rows: rows.select(*place, F.explode(reached).alias("_folder")).join(of, "_folder").select(*place, "dst")
    several = explode(imports.where(~plain))
    if links is not None:
        modules = _within(links, "target", folders, "dst").select("symbol", "dst").distinct()
        several = several.unionByName(imports.where("symbol IS NOT NULL").select(*place, "symbol").join(modules, "symbol").select(*place, "dst"))
    statements = _within(explode(imports.where(plain)).unionByName(several.distinct()), "path", folders, "src").where("src <> dst")
    between = Window.partitionBy("src", "dst").orderBy("path")
    first = statements.select("src", "dst", "path", F.dense_rank().over(between).alias("_nth")).where(F.col("_nth") <= EXAMPLES)
    first = first.groupBy("src", "dst").agg(F.array_sort(F.collect_set("path")).alias("sources"))
    counts = statements.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min(F.struct("path", "line"))["line"].alias("line"))
    return counts.join(first, ["src", "dst"]).select("src", "dst", "n", "sources", "line")


def module_links(meant: DataFrame, files: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """src, dst, n of module_edges(), counted from what specifiers mean in folders (imports.meant()) and how many statements have each: no
    statement is met again. links is as for module_edges()."""
    folders = folder_modules(files)
    place = ["grp", "folder", "specifier"]
    of = folders.select(F.col("folder").alias("_folder"), F.col("module").alias("dst"))
    explode = lambda rows: rows.select(*place, "n", F.explode("targets").alias("_target")).select(*place, "n", paths.dirname(F.col("_target")).alias("_folder")).join(of, "_folder").select(*place, "n", "dst")
    several = explode(meant.where("symbol IS NOT NULL OR size(targets) > 1"))
    if links is not None:
        modules = _within(links, "target", folders, "dst").select("symbol", "dst").distinct()
        several = several.unionByName(meant.where("symbol IS NOT NULL").select(*place, "n", "symbol").join(modules, "symbol").select(*place, "n", "dst"))
    reached = explode(meant.where("symbol IS NULL AND size(targets) <= 1")).unionByName(several.distinct())
    src = folders.select("folder", F.col("module").alias("src"))
    return reached.join(src, "folder").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def external_links(meant: DataFrame, files: DataFrame, limit: int = 18) -> DataFrame:
    """package, module, module_n of external_uses(), counted as in module_links()."""
    per = saved(meant.where("package IS NOT NULL").join(folder_modules(files).select("folder", "module"), "folder").groupBy("package", "module").agg(F.sum("n").alias("module_n")))
    most = per.groupBy("package").agg(F.sum("module_n").alias("n")).orderBy(F.desc("n"), "package").limit(limit)
    return per.join(F.broadcast(most.select("package")), "package")


def fan(imports: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, n_out) and (path, n_in): how many other files each file imports, and is imported by.

    Files that import the same symbols reach the same files through them, so what a set of symbols reaches is worked out once for the
    set, and counts for each of its files; a file named by itself as well counts once.
    """
    single = imports.select("path", F.explode("targets").alias("target")).where("path <> target").distinct()
    if links is None:
        return single.groupBy("path").agg(F.count("*").alias("n_out")), single.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n_in"))
    sets = imports.where("symbol IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_set("symbol")).alias("_set"))
    reach = sets.groupBy("_set").agg(F.count("*").alias("_files")).withColumn("symbol", F.explode("_set")).join(links, "symbol").select("_set", "target", "_files").distinct()
    own = sets.join(reach.select("_set", F.col("target").alias("path"), F.lit(1).alias("_own")), ["_set", "path"], "left").select("path", "_set", F.coalesce("_own", F.lit(0)).alias("_own"))
    more = single.join(sets, "path", "left").join(reach.select("_set", "target", F.lit(True).alias("_known")), ["_set", "target"], "left").where("_known IS NULL")
    sizes = own.join(reach.groupBy("_set").agg(F.count("*").alias("_n")), "_set").select("path", (F.col("_n") - F.col("_own")).alias("n"))
    into = reach.groupBy(F.col("target").alias("path")).agg(F.sum("_files").alias("n")).unionByName(own.where("_own = 1").select("path", F.lit(-1).cast("long").alias("n")))
    added = lambda many, key: many.unionByName(more.groupBy(F.col(key).alias("path")).agg(F.count("*").alias("n"))).groupBy("path").agg(F.sum("n").alias("n"))
    return added(sizes, "path").withColumnRenamed("n", "n_out"), added(into, "target").withColumnRenamed("n", "n_in")


def external_uses(imports: DataFrame, files: DataFrame, limit: int = 18) -> DataFrame:
    """package, n, module, module_n, file, line: the packages used most, with each module's own first use."""
    used = _within(imports.where("package IS NOT NULL").select("path", "line", "package"), "path", folder_modules(files), "module")
    per = saved(used.groupBy("package", "module").agg(F.count("*").alias("module_n"), F.min(F.struct("path", "line")).alias("first")))
    most = per.groupBy("package").agg(F.sum("module_n").alias("n")).orderBy(F.desc("n"), "package").limit(limit)
    return per.join(F.broadcast(most), "package").select("package", "n", "module", "module_n", F.col("first.path").alias("file"), F.col("first.line").alias("line"))


def diagnostics(imports: DataFrame, limit: int = 18) -> DataFrame:
    """code, severity, message: how many external packages the list of those used most leaves out."""
    n = imports.where("package IS NOT NULL").agg(F.count_distinct("package").alias("n")).where(F.col("n") > limit)
    return n.select(F.lit("EXTERNAL_DEPENDENCY_LIMIT").alias("code"), F.lit("info").alias("severity"), F.concat((F.col("n") - limit).cast("string"), F.lit(" external packages that are used less are not shown.")).alias("message"))


def file_table(imports: DataFrame, files: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """path, module, role, language, bytes, lines, imports, imported_by. What was not measured is null, not 0: lines of
    files without content, imports of files that are no code."""
    out, into = fan(imports, links)
    # Contents are counted where they are, not sent to the joins.
    counted = F.when((F.length("content") > 0) | (F.col("size") == 0), text.count_lines(F.col("content")).cast("long"))
    placed = with_modules(files.select("path", "size", counted.alias("lines"))).join(out, "path", "left").join(into, "path", "left")
    code = paths.extension(F.col("path")).isin(*CODE)
    zero = F.lit(0).cast("long")
    return placed.select(
        "path", F.when(code, F.col("module")).alias("module"), role(F.col("path"), F.col("root")).alias("role"), language(F.col("path")).alias("language"), F.col("size").alias("bytes"),
        "lines",
        F.when(code, F.coalesce("n_out", zero)).alias("imports"), F.when(code, F.coalesce("n_in", zero)).alias("imported_by"),
    )


def reports(table: DataFrame, limit: int = 8) -> dict[str, DataFrame]:
    """Ranked lists of a file table: entry points, load-bearing, largest, unreferenced and untested files."""
    source = table.where("role = 'source'")
    code = table.where("role IN ('source', 'entry') AND lines IS NOT NULL")
    stem = F.regexp_replace(F.lower(paths.stem(F.col("path"))), "^test_|[._-]?(?:tests?|spec)\\z", "")
    tested = table.where("role = 'test'").select(stem.alias("_stem")).distinct()
    untested = source.withColumn("_stem", F.lower(paths.stem(F.col("path")))).join(tested, "_stem", "left_anti")
    orders = {
        "entry_points": (table.where("role = 'entry'"), [F.desc("imports"), F.col("path")]),
        "load_bearing": (table.where("imported_by > 0"), [F.desc("imported_by"), F.col("path")]),
        "largest": (code, [F.desc("lines"), F.col("path")]),
        "unreferenced": (source.where("imported_by = 0"), [F.col("imports"), F.desc("lines"), F.col("path")]),
        "untested": (untested.drop("_stem"), [F.desc("lines"), F.col("path")]),
    }
    return {name: frame.orderBy(*order).limit(limit) for name, (frame, order) in orders.items()}


# Dependencies, modules, packages, files and words that name a technology.
NPM = {
    "react": "React", "next": "Next.js", "vue": "Vue", "svelte": "Svelte", "express": "Express", "fastify": "Fastify", "@nestjs/core": "NestJS", "typeorm": "TypeORM",
    "prisma": "Prisma", "@prisma/client": "Prisma", "sequelize": "Sequelize", "drizzle-orm": "Drizzle ORM", "drizzle_orm": "Drizzle ORM", "mongoose": "Mongoose",
    "@typegoose/typegoose": "Typegoose", "mongodb": "MongoDB", "dynamoose": "Dynamoose", "@aws-sdk/client-dynamodb": "DynamoDB", "firebase-admin": "Firebase", "redis": "Redis", "ioredis": "Redis",
}
GO = {
    "github.com/gin-gonic/gin": "Gin", "github.com/labstack/echo": "Echo", "github.com/gofiber/fiber": "Fiber", "github.com/go-chi/chi": "chi", "github.com/gorilla/mux": "Gorilla", "gorm.io/gorm": "GORM",
    "entgo.io/ent": "Ent", "github.com/uptrace/bun": "Bun", "github.com/jmoiron/sqlx": "sqlx", "go.mongodb.org/mongo-driver": "MongoDB", "github.com/redis/go-redis": "Redis",
}
PUB = {
    "flutter": "Flutter", "drift": "Drift", "moor": "Drift", "floor": "Floor", "isar": "Isar", "objectbox": "ObjectBox", "sqflite": "sqflite", "riverpod": "Riverpod", "flutter_riverpod": "Riverpod",
    "hooks_riverpod": "Riverpod", "bloc": "Bloc", "flutter_bloc": "Bloc", "provider": "Provider", "get": "GetX",
}
FILES_OF = {
    "go.mod": "Go modules", "cargo.toml": "Cargo", "package.swift": "SwiftPM", "cmakelists.txt": "CMake", "meson.build": "Meson", "pom.xml": "JVM build", "build.gradle": "JVM build", "build.gradle.kts": "JVM build",
    "dockerfile": "Docker", "compose.yaml": "Docker", "compose.yml": "Docker", "docker-compose.yaml": "Docker", "docker-compose.yml": "Docker",
}
EXTENSIONS_OF = {"prisma": "Prisma", "sql": "SQL"}
WORDS_OF = {
    "Django": r"\b(?:from|import)\s+django\b|\bmodels\.Model\b", "FastAPI": r"\b(?:from|import)\s+fastapi\b", "Flask": r"\b(?:from|import)\s+flask\b", "SQLAlchemy": r"\bsqlalchemy\b|\bdeclarative_base\b",
    "Spring Boot": r"\bSpringBootApplication\b|\borg\.springframework\b", "JPA": r"\b(?:jakarta|javax)\.persistence\b", "MongoEngine": r"\bmongoengine\b", "Beanie": r"\b(?:from|import)\s+beanie\b",
    "MongoDB": r"\b(?:from|import)\s+pymongo\b|\bimport\s+motor\b", "Spring Data MongoDB": r"\borg\.springframework\.data\.mongodb\b",
}


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def technologies(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """technology: languages of code files, what manifests depend on, and what files and their words tell, in order."""
    name, extension, content = F.lower(paths.basename(F.col("path"))), paths.extension(F.col("path")), F.col("content")
    none = F.array().cast("array<string>")
    only = lambda on, value: F.when(on, value).otherwise(none)
    spelled = F.array(*(F.when(content.rlike(p), F.lit(n)) for n, p in WORDS_OF.items()))
    required = only(name == "go.mod", F.array(*(F.when(content.contains(m), F.lit(n)) for m, n in GO.items())))
    # A dependency is a key one level below its list.
    keys = F.regexp_extract_all("content", F.lit(r"(?m)^ {2}([a-z_][a-z0-9_]*):"), F.lit(1))
    packages = only(name.isin("pubspec.yaml", "pubspec.yml"), F.concat(F.transform(keys, lambda k: _named(k, PUB)), F.array(F.when(content.rlike(r"\bsdk:\s*flutter\b"), "Flutter"))))
    monorepo = F.when((name == "package.json") & F.get_json_object("content", "$.workspaces").isNotNull(), "JavaScript monorepo")
    variant = F.when(name.startswith("dockerfile.") | name.endswith(".dockerfile") | name.contains("docker-compose"), "Docker")
    one = F.array(F.when(extension.isin(*CODE), language(F.col("path"))), _named(name, FILES_OF), _named(extension, EXTENSIONS_OF), monorepo, variant)
    seen = files.select(F.explode(F.concat(one, spelled, required, packages)).alias("technology"))
    every = seen.unionByName(dependencies.select(_named(F.col("dependency"), NPM).alias("technology")))
    return every.where("technology IS NOT NULL AND technology <> 'Other'").distinct()
