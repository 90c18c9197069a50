"""A workspace as a set of tables: what the operators derive from its files, as lazy DataFrames and SQL views."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import ids
from weft.operators import areas, communities, cycles, flow, graph, imports, interfaces, modules, reports, schema
from weft.plans.schema_document import whole_document
from weft.session import saved
from weft.sources.files import manifests, scan


class Workspace:
    """Tables of one state of a workspace. Facts that several tables share are checkpointed when first
    asked for, so that what is derived from them has a plan of its own; all else is lazy."""

    VIEWS = "files imports symbol_files modules module_edges externals file_table endpoints ports flow_nodes flow_edges flow_units entities fields relations tree technologies diagnostics".split()

    def __init__(self, spark: SparkSession, files: DataFrame, diagnostics: DataFrame | None = None, revision: int = 0):
        # Dealt by path: what reads files works on all of them at once however few partitions they came in, and joins by path are spared a shuffle.
        self.spark, self.files, self.revision = spark, files.repartition("path").persist(), revision
        self.scanned = diagnostics

    @classmethod
    def read(cls, spark: SparkSession, *uris: str, exclude: list[str] = (), **limits: int) -> Workspace:
        """The workspace in one or more folders; with several, paths begin with the folders' names."""
        roots = {uri.rstrip("/").rsplit("/", 1)[-1]: uri for uri in uris}
        return cls(spark, *scan(spark, roots, list(exclude), **limits))

    @cached_property
    def _statements(self) -> DataFrame:
        return saved(imports.imports(self.files))

    @cached_property
    def meant(self) -> DataFrame:
        """What each specifier means in a folder, and how many statements have it there."""
        return saved(imports.meant(self._statements, self.files))

    @cached_property
    def imports(self) -> DataFrame:
        return saved(imports.resolved(self._statements, self.files, self.meant))

    @cached_property
    def symbol_files(self) -> DataFrame:
        """symbol, target: the files of the packages and namespaces that imports name."""
        return saved(imports.symbol_files(self.files))

    def import_targets(self) -> DataFrame:
        """imports with all files that each means in `targets`."""
        return imports.expanded(self.imports, self.symbol_files)

    @cached_property
    def modules(self) -> DataFrame:
        return saved(modules.inventory(self.files))

    @cached_property
    def module_edges(self) -> DataFrame:
        return saved(modules.module_edges(self.imports, self.files, self.symbol_files, once=True))

    @cached_property
    def module_links(self) -> DataFrame:
        """src, dst, n of module_edges, for what needs neither sources nor lines."""
        named = not self.meant.where("symbol IS NOT NULL").isEmpty()
        return saved(modules.module_links(self.meant, self.files, self.symbol_files if named else None))

    @cached_property
    def externals(self) -> DataFrame:
        return modules.external_uses(self.imports, self.files)

    @cached_property
    def file_table(self) -> DataFrame:
        return saved(modules.file_table(self.imports, self.files, self.symbol_files))

    @cached_property
    def endpoints(self) -> DataFrame:
        return saved(interfaces.with_module(interfaces.endpoints(self.files), self.placed))

    @cached_property
    def placed(self) -> DataFrame:
        """path, module of every file."""
        return saved(modules.with_modules(self.files).select("path", "module"))

    @cached_property
    def ports(self) -> DataFrame:
        return interfaces.ports(self.files, self.endpoints)

    @cached_property
    def _flow(self) -> tuple[DataFrame, DataFrame]:
        return flow.flow_graph(self.files)

    @property
    def flow_nodes(self) -> DataFrame:
        return self._flow[0]

    @property
    def flow_edges(self) -> DataFrame:
        return self._flow[1]

    @cached_property
    def flow_units(self) -> DataFrame:
        return flow.units(*self._flow)

    @cached_property
    def _model(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return schema.declared(self.files)

    @property
    def entities(self) -> DataFrame:
        return self._model[0]

    @cached_property
    def fields(self) -> DataFrame:
        return saved(self._model[1])

    @cached_property
    def relations(self) -> DataFrame:
        return saved(schema.without_inverses(saved(schema.resolve(self.entities, self._model[2]))))

    @cached_property
    def tree(self) -> DataFrame:
        return areas.tree(self.files)

    @cached_property
    def technologies(self) -> DataFrame:
        return modules.technologies(self.files, manifests(self.files))

    @cached_property
    def diagnostics(self) -> DataFrame:
        """code, severity, message, file, line of scan, readers and resolution: one for each code, message and place. No statement meets
        what it means for it, and no flow is drawn."""
        missing = self.meant.agg(F.sum(F.when(F.col("unresolved_local"), F.col("n"))).alias("n")).where("n > 0")
        missing = missing.select(F.lit("LOCAL_IMPORTS_UNRESOLVED").alias("code"), F.lit("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" imports name files that are not there.")).alias("message"))
        placed = schema.diagnostics(self.relations).unionByName(schema.unclosed(self.files))
        others = [missing, flow.diagnostics(flow.units_of(self.files)), modules.diagnostics(self.meant), *([] if self.scanned is None else [self.scanned])]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, placed)
        return every.dropDuplicates(["code", "message", "file", "line"])

    @cached_property
    def architecture(self) -> tuple[DataFrame, DataFrame]:
        """nodes (id, kind, label, area) and edges (src, dst, n, confidence) of modules."""
        nodes = graph.path_areas(self.modules.select("id", F.lit("module").alias("kind"), F.col("module").alias("label"), "files"), "label")
        name = lambda c: ids.node_id("module", F.col(c)).alias(c)
        return nodes, self.module_edges.select(name("src"), name("dst"), "n", F.lit("inferred").alias("confidence"))

    def project_flow(self) -> tuple[DataFrame, DataFrame]:
        return flow.project_flow(self.modules, self.module_links)

    def module_ranks(self) -> DataFrame:
        """node, root, rank of the modules that import one another: how long a way leads to each, with modules on a cycle as one."""
        return cycles.condensed_ranks(self.module_edges)

    def module_cycles(self) -> DataFrame:
        """src, dst, turned of the edges between modules: which to turn so that no cycle is left."""
        return cycles.without_cycles(self.module_edges)

    def module_communities(self) -> DataFrame:
        """root, id, community of the modules, by their edges."""
        nodes = self.modules.select(F.col("module").alias("id"))
        return communities.merged(communities.communities(nodes, self.module_edges), self.module_edges)

    def flow_with_boundaries(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the files' flows, with marks where they begin and end."""
        return flow.with_boundaries(self.flow_nodes, self.flow_edges)

    def flow_list(self, project: str = "project") -> DataFrame:
        """The units of flow: the project, its modules, and the files that say most."""
        return flow.all_units(self.flow_nodes, self.flow_edges, self.placed, project, self.project_flow())

    @cached_property
    def subjects(self) -> DataFrame:
        """entities with their area."""
        return saved(areas.subject_areas(self.entities))

    def schema_map(self) -> tuple[DataFrame, DataFrame]:
        """Areas of the data model and the relations between them."""
        return areas.area_summary(self.subjects, self.relations), areas.area_links(self.subjects, self.relations)

    def schema_area(self, name: str) -> DataFrame:
        return areas.area_boundary(self.subjects, self.relations, name)

    def document(self, title: str = "Data model") -> DataFrame:
        """The data model as Markdown, part by part."""
        return whole_document(self.subjects, self.fields, self.relations, schema.diagnostics(self.relations), title)

    def shown_by_areas(self) -> DataFrame:
        """view, uses_areas: whether modules (over 24) and entities (over 30) are shown by areas."""
        one = lambda name, frame, n: reports.uses_areas(frame, n).select(F.lit(name).alias("view"), "uses_areas")
        return one("modules", self.architecture[0], 24).unionByName(one("entities", self.subjects, 30))

    def area_map(self) -> DataFrame:
        return graph.areas(*self.architecture)

    def area(self, name: str) -> DataFrame:
        """What an area's modules have to do with other areas."""
        return graph.boundary(*self.architecture, name)

    def stats(self) -> DataFrame:
        """One row of counters. entities counts placeholders of missing targets too."""
        one = self.files.agg(F.count("*").alias("files"))
        parts = [
            self.modules.agg(F.count("*").alias("modules"), F.sum("files").alias("code_files")),
            self.module_links.agg(F.count("*").alias("module_edges")),
            self.module_links.select("src").unionAll(modules.external_links(self.meant, self.files).select("module")).agg(F.count("*").alias("dependencies")),
            self.flow_list().agg(F.count("*").alias("flow_units")),
            self.entities.agg(F.count("*").alias("_declared")).crossJoin(schema.placeholders(self.relations).agg(F.count("*").alias("_missing"))).select((F.col("_declared") + F.col("_missing")).alias("entities")),
            interfaces.summary(self.endpoints, self.ports),
        ]
        for part in parts:
            one = one.crossJoin(part)  # one row each
        return one

    def register(self, prefix: str = "") -> None:
        """Makes every table a temporary view."""
        for name in self.VIEWS:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def query(self, sql: str) -> DataFrame:
        self.register()
        return self.spark.sql(sql)
