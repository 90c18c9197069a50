"""Source workspaces as tables: a scan that reads what can be analysed, with limits and a report of what it left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths

# Extensions of code, of other text that is read, and names that are read whatever their extension.
CODE = "ts tsx js jsx mjs cjs vue svelte py java kt kts go rs cs php rb dart swift c h cc cpp cxx hpp hh hxx".split()
TEXT = [*CODE, *"json toml yaml yml xml gradle sql prisma proto graphql gql properties conf ini".split()]
NAMES = (
    "dockerfile go.mod cargo.toml gemfile pipfile requirements.txt package.json pom.xml build.gradle build.gradle.kts settings.gradle "
    "settings.gradle.kts pnpm-workspace.yaml pyproject.toml pubspec.yaml pubspec.yml cmakelists.txt package.swift meson.build "
    "docker-compose.yml docker-compose.yaml compose.yml compose.yaml procfile"
).split()
#: Folders of dependencies and build results: never read, whatever the caller excludes besides.
ALWAYS_EXCLUDED = [f"**/{x}/**" for x in ("node_modules", ".git", "vendor", "dist", "build", "target", ".venv", "venv", "__pycache__", "Pods", ".dart_tool")]
MAX_FILES, MAX_KB = (100, 10_000, 20_000), (16, 1024, 10_240)

FILES = "path STRING, content STRING, size BIGINT"


def is_readable(path: Column) -> Column:
    """Whether a path is one to analyse: never .env files, else known names, Dockerfile variants and extensions."""
    name = F.lower(paths.basename(path))
    return ~name.startswith(".env") & (name.isin(*NAMES) | name.startswith("dockerfile.") | paths.extension(path).isin(*TEXT))


def _clamped(value: int | None, limits: tuple[int, int, int]) -> int:
    low, usual, high = limits
    return usual if value is None else min(high, max(low, value))


#: What to give as max_files to read all files, however many.
ALL = 0


def _any_case(name: str) -> str:
    """A glob of a name in capital or small letters."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


#: Names of files that is_readable() may hold for, as a glob that Spark applies when it lists folders.
GLOB = "{" + ",".join([*(f"*.{_any_case(x)}" for x in TEXT), *map(_any_case, NAMES), _any_case("dockerfile") + ".*"]) + "}"


def _reader(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", GLOB)


def scan(spark: SparkSession, roots: dict[str, str], exclude: list[str] = (), max_files: int | None = None, max_kb: int | None = None) -> tuple[DataFrame, DataFrame]:
    """files (path, content, size) and diagnostics (code, severity, message) of the folders in roots (name: URI).

    With several roots paths begin with the root's name. Files are ordered by path and the first max_files (100 to
    20000; 10000 if not given; ALL: every one) are kept; those over max_kb (16 to 10240) keep their size and lose their content.

    Folders are listed first, without opening a file. With a limit the kept paths, of which there are 20000 at most, are what is read then;
    without one the folders are read, but for names that are no text and files over the size, which Spark leaves unopened. Spark lists no
    files without a byte, so these are missing.
    """
    limit, most = ALL if max_files == ALL else _clamped(max_files, MAX_FILES), _clamped(max_kb, MAX_KB) * 1024
    listed = None
    for name, uri in roots.items():
        root = uri.rstrip("/") + "/"
        raw = _reader(spark).load(root).select("path", F.col("length").alias("size"))
        # Spark returns absolute paths; what follows the root's own last folder is the path within it.
        inside = F.element_at(F.split(F.col("path"), "/" + _quoted(root.rstrip("/").rsplit("/", 1)[-1]) + "/", 2), 2)
        part = raw.select(F.col("path").alias("uri"), (F.concat(F.lit(name + "/"), inside) if len(roots) > 1 else inside).alias("path"), "size")
        listed = part if listed is None else listed.unionByName(part)
    # Of a path that two roots give, one is kept.
    chosen = listed.where(is_readable(F.col("path")) & ~paths.matches(F.col("path"), [*ALWAYS_EXCLUDED, *exclude])).groupBy("path").agg(F.min(F.struct("uri", "size")).alias("_f")).select("path", "_f.*")
    cut = False
    if limit != ALL:
        first = chosen.orderBy("path").limit(limit + 1).collect()  # 20001 at most
        cut = len(first) > limit
        chosen = spark.createDataFrame([tuple(r) for r in first[:limit]], chosen.schema)
        small = [r["uri"] for r in first[:limit] if r["size"] <= most]
        read = _reader(spark).load(small) if small else None
    else:
        read = _reader(spark).load([uri.rstrip("/") + "/" for uri in roots.values()])
    text = F.decode("content", "UTF-8").alias("content")
    opened = chosen.limit(0).select("uri", F.lit("").alias("content")) if read is None else read.where(F.col("length") <= most).select(F.col("path").alias("uri"), text)
    files = chosen.where(F.col("size") <= most).join(opened, "uri").select("path", "content", "size").unionByName(chosen.where(F.col("size") > most).select("path", F.lit("").alias("content"), "size"))
    # Listed without opening, read with what can't be read left out: the difference is told.
    told = _diagnostics(chosen.limit(1 if cut else 0), chosen.where(F.col("size") > most), limit, most)
    return files, told.unionByName(unreadable(chosen.select("path"), files.select("path")))


def unreadable(listed: DataFrame, read: DataFrame) -> DataFrame:
    """code, severity, message: how many of the listed paths were not read."""
    missing = listed.join(read, "path", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    return missing.select(F.lit("UNREADABLE_FILE").alias("code"), F.lit("warning").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" files could not be read.")).alias("message"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _diagnostics(cut: DataFrame, large: DataFrame, limit: int, most: int) -> DataFrame:
    limited = cut.limit(1).select(F.lit("SCAN_LIMIT_REACHED").alias("code"), F.lit("warning").alias("severity"), F.lit(f"Only the first {limit} files are analysed.").alias("message"))
    sized = large.agg(F.count("*").alias("n")).where("n > 0")
    sized = sized.select(F.lit("FILE_SIZE_LIMIT").alias("code"), F.lit("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(f" files over {most // 1024} KiB are listed without their content.")).alias("message"))
    return limited.unionByName(sized)


#: Other JSON files that name dependencies, and the entries that hold them.
JSON_MANIFESTS = {"package.json": "dependencies devDependencies peerDependencies", "composer.json": "require require-dev", "bower.json": "dependencies devDependencies", "deno.json": "imports"}


def manifests(files: DataFrame) -> DataFrame:
    """path, dependency of each manifest in JSON; a malformed one has none."""
    name = F.lower(paths.basename(F.col("path")))
    fields = sorted({k for keys in JSON_MANIFESTS.values() for k in keys.split()})
    parsed = F.from_json("content", ", ".join(f"`{k}` MAP<STRING,STRING>" for k in fields))
    own = files.where(name.isin(*JSON_MANIFESTS)).select("path", name.alias("name"), parsed.alias("p"))
    none = F.array().cast("array<string>")
    of_file = F.coalesce(*(F.when(F.col("name") == n, F.array_distinct(F.flatten(F.array(*(F.coalesce(F.map_keys(F.col("p")[k]), none) for k in keys.split()))))) for n, keys in JSON_MANIFESTS.items()))
    return own.select("path", F.explode(of_file).alias("dependency"))
