"""Control flow of files as a graph: callables and routes as nodes; calls, forks and dispatches as edges.

Everything is found by windows and as-of joins within a file: a callable reaches to the line before the next one, a call
belongs to the callable around it and to the last decision a few lines above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import ids, paths, text
from weft.operators import graph, ranking
from weft.operators.asof import asof, extents
from weft.operators.interfaces import ARGUMENTS, CODE, SIGNS, callables, handled, holds, lines
from weft.session import saved

#: A call depends on a decision at most so many lines above it; of each callable so many decisions and steps are drawn.
DECISION_WITHIN, DECISIONS, STEPS, EXTERNALS = 8, 4, 6, 8
#: Words that decide by what stands in brackets behind them; one of them also without brackets, at the start of a line.
DECIDING, BARE = ("if", "switch", "when"), "if"
CALL = r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("
# What looks like a call and is none; verbs at the end of a call and receivers that mean input or output;
# names by which a program or a listener conventionally begins.
NOT_CALLS = "if for while switch catch return new typeof sizeof super this".split()
VERBS = "fetch request get post put patch delete query execute save insert update remove publish emit send dispatch enqueue navigate redirect"
RECEIVERS = "repository database client gateway queue producer http axios"
ENTRIES = "main run start bootstrap handle handler execute process"
EXTERNAL = rf"(?i)(?:^|\.)(?:{VERBS.replace(' ', '|')})$|(?:{RECEIVERS.replace(' ', '|')})\."
ENTRY = rf"(?i)^(?:{ENTRIES.replace(' ', '|')}|on[A-Z_]|.*Controller)$"


def extents_of(rows: DataFrame) -> DataFrame:
    """path, name, start, until of each callable."""
    ends = rows.groupBy("path").agg(F.max("number").alias("_end"))
    starts = callables(rows).withColumnRenamed("number", "start").join(ends, "path")
    return extents(starts, ["path"], "start", F.col("_end")).select("path", "name", "start", "until")


def _condition(line: Column) -> Column:
    """What a line decides by, or null: the arguments of a word that decides, else what follows one that begins the line."""
    called = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(line, rf"\b{word}\s*{ARGUMENTS}", 1)), F.lit("")) for word in DECIDING))
    words = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")  # tabs too
    rest = F.when(words[0] == "else", F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    bare = F.when(F.get(rest, F.lit(0)) == BARE, F.array_join(F.slice(rest, F.lit(2), F.size(rest)), " "))
    return F.coalesce(called, F.nullif(F.rtrim(F.regexp_replace(bare, r"[:{]$", "")), F.lit("")))


def starts_of(rows: DataFrame) -> DataFrame:
    """path, name, start of each callable."""
    return callables(rows).select("path", "name", F.col("number").alias("start"))


def decisions(rows: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """path, number, label, nth of the first decisions of each callable; named gives these, if starts_of() is known."""
    label = F.when(F.col("line").rlike(r"\b(?:" + "|".join(DECIDING) + r")\b"), _condition(F.col("line")))
    found = rows.where(holds(F.col("line"), *DECIDING)).select("path", "number", text.truncated(F.trim(label), 44).alias("label")).where("label IS NOT NULL")
    inside = asof(found, (starts_of(rows) if named is None else named).select("path", F.col("start").alias("number"), "name", F.col("start")), ["path"], "number", ["name", "start"]).where("name IS NOT NULL")
    return ranking.top(inside, ["path", "start"], [F.col("number")], DECISIONS).select("path", "number", "label", "name", "start")


def calls(rows: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """path, number, callee, caller, start of the calls inside callables; comments at the ends of lines are no calls. named is as for decisions()."""
    plain = F.regexp_replace("line", "(?://|#).*$", "")
    found = rows.where(F.col("line").contains("(")).select("path", "number", plain.alias("line")).select("path", "number", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)))).alias("callee"))
    found = found.where(~F.element_at(F.split("callee", "\\."), -1).isin(*NOT_CALLS))
    around = asof(found, (starts_of(rows) if named is None else named).select("path", F.col("start").alias("number"), F.col("name").alias("caller"), F.col("start")), ["path"], "number", ["caller", "start"])
    return around.where("caller IS NOT NULL AND number > start").select("path", "number", "callee", "caller", "start")


def _node(kind: str, *columns: str):
    return ids.node_id(kind, *(F.col(c).cast("string") for c in columns))


def flow_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (unit, id, kind, label, line) and edges (unit, src, dst, kind, label) of each file's flow.

    A decision is a node only if a call on its branch is drawn; the branch is No behind an else, otherwise Yes. Names
    defined twice mean their last definition. External input and output is drawn as actions. Files are read whole, whatever their lines'
    length; those that can't declare a callable have no flow (see units_of()) and are spared. Lines that may be a callable, call or decision,
    callables, calls, steps and dispatched routes are each used several times and kept for it.
    """
    files = _declaring(files)
    rows = lines(files, whole=True).where(holds(F.col("line"), *SIGNS, *DECIDING, "else")).persist()
    named = saved(starts_of(rows))
    last = ranking.prefer(named, ["path", "name"], F.desc("start")).select("path", F.col("name").alias("callee_name"), F.col("start").alias("callee_start"))
    made = calls(rows, named).withColumn("callee_name", F.element_at(F.split("callee", "\\."), -1)).join(last, ["path", "callee_name"], "left")
    chosen = decisions(rows, named).select("path", "number", F.col("label").alias("decision"), F.col("start").alias("decision_start"))
    placed = asof(made, chosen, ["path"], "number", ["decision", "decision_start"], within=DECISION_WITHIN).withColumnRenamed("matched_number", "decision_line")
    own = F.col("decision_start") == F.col("start")
    placed = placed.withColumn("decision_line", F.when(own, F.col("decision_line"))).withColumn("decision", F.when(own, F.col("decision")))
    elses = rows.where(F.col("line").contains("else") & F.col("line").rlike(r"\belse\b")).select("path", F.col("number"), F.col("number").alias("else_line"))
    placed = saved(asof(placed, elses, ["path"], "number", ["else_line"]).drop("matched_number"))
    branch = F.when(F.col("decision_line").isNotNull(), F.when(F.col("else_line") > F.col("decision_line"), "No").otherwise("Yes"))
    local = placed.where("callee_start IS NOT NULL AND callee_start <> start").withColumn("kind", F.lit("call"))
    outside = placed.where(F.col("callee_start").isNull() & F.col("callee").rlike(EXTERNAL)).withColumn("kind", F.lit("io"))
    steps = ranking.top(local, ["path", "start"], [F.col("number"), F.col("callee")], STEPS).unionByName(ranking.top(outside, ["path"], [F.col("number"), F.col("callee")], EXTERNALS)).drop("rank")
    steps = saved(steps.withColumn("branch", branch).withColumn("unit", F.col("path")))
    target = F.when(F.col("kind") == "call", _node("callable", "path", "callee_start")).otherwise(_node("io", "path", "callee"))
    caller = _node("callable", "path", "start")
    fork = F.when(F.col("decision_line").isNotNull(), _node("decision", "path", "decision_line"))
    drawn = steps.select("unit", F.coalesce(fork, caller).alias("src"), target.alias("dst"), F.col("kind"), F.coalesce("branch", F.lit("")).alias("label"))
    forks = steps.where("decision_line IS NOT NULL").select("unit", caller.alias("src"), fork.alias("dst"), F.lit("fork").alias("kind"), F.lit("").alias("label"))
    # A route goes to the next callable below, however far; one that nothing follows goes nowhere.
    routes = handled(files, whole=True, offers="http").where("handler IS NOT NULL AND protocol = 'http'").select("path", F.element_at(F.split("handler", "\\."), -1).alias("callee_name"), F.concat_ws(" ", "operation", "address").alias("route"), F.col("number").alias("line"))
    dispatched = saved(routes.join(last, ["path", "callee_name"]))
    starts = dispatched.select(F.col("path").alias("unit"), _node("route", "path", "route").alias("src"), _node("callable", "path", "callee_start").alias("dst"), F.lit("dispatch").alias("kind"), F.lit("").alias("label"))
    edges = drawn.unionByName(forks).unionByName(starts).distinct()
    kind = F.when(F.col("name").rlike(ENTRY), "entry").otherwise("step")
    nodes = (
        named.select(F.col("path").alias("unit"), _node("callable", "path", "start").alias("id"), kind.alias("kind"), F.col("name").alias("label"), F.col("start").alias("line"))
        .unionByName(steps.where("decision_line IS NOT NULL").select("unit", fork.alias("id"), F.lit("decision").alias("kind"), F.col("decision").alias("label"), F.col("decision_line").alias("line")))
        .unionByName(steps.where("kind = 'io'").select("unit", target.alias("id"), F.lit("io").alias("kind"), F.col("callee").alias("label"), F.col("number").alias("line")))
        .unionByName(dispatched.select(F.col("path").alias("unit"), _node("route", "path", "route").alias("id"), F.lit("start").alias("kind"), F.col("route").alias("label"), "line"))
    )
    drawn = saved(ranking.prefer(nodes, ["id"], F.col("line"))), saved(edges)
    rows.unpersist()
    return drawn


def units(nodes: DataFrame, edges: DataFrame, limit: int = 180) -> DataFrame:
    """unit, routes, steps, branches, score of the files whose flow says most: 12 for a route, 3 for an edge, 1 for a callable."""
    drawn = edges.groupBy("unit").agg(F.count("*").alias("edges"))
    counts = nodes.groupBy("unit").agg(F.count_if(F.col("kind") == "start").alias("routes"), F.count_if(F.col("kind").isin("step", "entry")).alias("steps"), F.count_if(F.col("kind") == "decision").alias("branches"))
    scored = counts.join(drawn, "unit", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    scored = scored.withColumn("score", 12 * F.col("routes") + 3 * F.col("edges") + F.col("steps"))
    return scored.orderBy(F.desc("score"), "unit").limit(limit)


#: A flow's begin and end are marked if so many nodes begin or end it at most.
BOUNDARY = 8


def degrees_of_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """unit, id, position of nodes where a flow begins or ends: start for routes, entries and what has only edges out, end for
    what has only edges in, decisions aside. Positions with more than 8 nodes of a unit are left out."""
    into, out = edges.select(F.col("dst").alias("id"), F.lit(True).alias("_in")).distinct(), edges.select(F.col("src").alias("id"), F.lit(True).alias("_out")).distinct()
    placed = nodes.join(into, "id", "left").join(out, "id", "left")
    arrives, leaves = F.col("_in").isNotNull(), F.col("_out").isNotNull()
    starts = F.when(F.col("kind").isin("start", "entry") | (~arrives & leaves), "start")
    ends = F.when((F.col("kind") != "decision") & arrives & ~leaves, "end")
    both = placed.select("unit", "id", F.explode(F.array_compact(F.array(starts, ends))).alias("position"))
    return both.withColumn("_n", F.count("*").over(Window.partitionBy("unit", "position"))).where(F.col("_n") <= BOUNDARY).drop("_n")


def with_boundaries(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with a node of each unit where its flow begins and one where it ends, tied to what begins and ends it."""
    places = degrees_of_flow(nodes, edges)
    mark = ids.node_id("boundary", F.col("unit"), F.col("position"))
    marks = places.select("unit", mark.alias("id"), F.concat(F.lit("flow-"), "position").alias("kind"), F.col("position").alias("label"), F.lit(None).cast("int").alias("line")).distinct()
    begins = F.col("position") == "start"
    ties = places.select("unit", F.when(begins, mark).otherwise(F.col("id")).alias("src"), F.when(begins, F.col("id")).otherwise(mark).alias("dst"), F.when(begins, "starts").otherwise("finishes").alias("kind"), F.lit("").alias("label"))
    return nodes.unionByName(marks), edges.unionByName(ties)


#: A project with more modules than this is shown by areas.
MODULES = 18


def project_flow(modules: DataFrame, edges: DataFrame, most: int = MODULES) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, modules, files, examples) and edges (src, dst, n) of a project: how its modules (module, files) hand off
    to one another (src, dst, n); of more than `most` modules their areas, with n the hand-offs between modules of two areas.
    External packages are no part of it."""
    placed = graph.path_areas(modules.select("module", "files"), "module", ("apps", "packages", "services", "libs", "src"))
    count = F.broadcast(modules.agg((F.count("*") > most).alias("_folded")))  # one row
    placed = placed.crossJoin(count).select("module", "files", F.when(F.col("_folded"), F.col("area")).otherwise(F.col("module")).alias("label"), "_folded")
    first = F.row_number().over(Window.partitionBy("label").orderBy("module"))
    nodes = placed.withColumn("_nth", first).groupBy("label").agg(
        F.count("*").alias("modules"), F.sum("files").alias("files"), F.array_sort(F.collect_list(F.when(F.col("_nth") <= 5, F.col("module")))).alias("examples")
    )
    of = lambda end: placed.select(F.col("module").alias(f"_{end}"), F.col("label").alias(end), *(["_folded"] if end == "src" else []))
    drawn = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("n").alias("_n")).join(of("src"), "_src").join(of("dst"), "_dst").where("src <> dst")
    weight = F.sum(F.when(F.col("_folded"), 1).otherwise(F.col("_n")))
    return nodes.select(ids.node_id("flow-area", F.col("label")).alias("id"), "label", "modules", "files", "examples"), drawn.groupBy("src", "dst").agg(weight.alias("n"))


#: A service's flow draws whole files, by score, as long as they have no more nodes than this together.
PACKED = 64


def packed(per_file: DataFrame, most: int = PACKED) -> DataFrame:
    """module, unit of the files (module, unit, score, nodes) that a service's flow draws: by falling score, each that still fits; the first
    in any case.

    Once a file doesn't fit, no later one of its size does, so of a size k only the first most / k can be drawn. That leaves at most
    about most * ln(most) files of a module, whatever it holds, and the order-dependent choice is a fold over these.
    """
    order = [F.desc("score"), F.col("unit")]
    ranked = per_file.withColumn("_nth", F.row_number().over(Window.partitionBy("module").orderBy(*order))).withColumn("_same", F.row_number().over(Window.partitionBy("module", "nodes").orderBy(*order)))
    likely = ranked.where((F.col("_nth") == 1) | (F.col("_same") * F.col("nodes") <= most))
    rows = likely.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("_nth", "unit", "nodes"))).alias("files"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["kept"]) == 0) | (a["n"] + x["nodes"] <= most)
        return F.when(fits, F.struct((a["n"] + x["nodes"]).alias("n"), F.array_append(a["kept"], x["unit"]).alias("kept"))).otherwise(a)

    return rows.select("module", F.explode(F.aggregate("files", zero, step)["kept"]).alias("unit"))


def all_units(nodes: DataFrame, edges: DataFrame, modules: DataFrame, project: str, whole: tuple[DataFrame, DataFrame], limit: int = 180) -> DataFrame:
    """kind, unit, files, nodes, edges of the project (whole: see project_flow()), of each module with a flow (modules: path, module), and of the files that say most.
    A module's files are all that have a flow; its nodes and edges are of those that its own flow draws (see packed())."""
    own = nodes.join(modules.select(F.col("path").alias("unit"), "module"), "unit", "left").withColumn("module", F.coalesce("module", F.lit("(root)")))
    drawn = edges.groupBy("unit").agg(F.count("*").alias("edges"))
    kinds = [F.count_if(F.col("kind") == "start").alias("_routes"), F.count_if(F.col("kind").isin("step", "entry")).alias("_steps")]
    per_file = saved(own.groupBy("module", "unit").agg(F.count("*").alias("nodes"), *kinds).join(drawn, "unit", "left").withColumn("edges", F.coalesce("edges", F.lit(0))))
    scored = per_file.withColumn("score", 12 * F.col("_routes") + 3 * F.col("edges") + F.col("_steps"))
    shown = per_file.join(packed(scored), ["module", "unit"]).groupBy("module").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
    services = per_file.groupBy("module").agg(F.count("*").alias("files")).join(shown, "module")
    counts = whole[0].agg(F.sum("files").alias("files"), F.count("*").alias("nodes")).where("nodes > 0")
    project_row = counts.crossJoin(whole[1].agg(F.count("*").alias("edges")))  # one row each
    chosen = per_file.join(units(nodes, edges, limit).select("unit"), "unit")
    parts = [
        project_row.select(F.lit("project").alias("kind"), F.lit(project).alias("unit"), "files", "nodes", "edges"),
        services.select(F.lit("service").alias("kind"), F.col("module").alias("unit"), "files", "nodes", "edges"),
        chosen.select(F.lit("file").alias("kind"), "unit", F.lit(1).cast("long").alias("files"), "nodes", "edges"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _declaring(files: DataFrame) -> DataFrame:
    """Files of code that hold a sign of a callable."""
    return files.where(paths.extension(F.col("path")).isin(*CODE) & holds(F.col("content"), *SIGNS))


def units_of(files: DataFrame) -> DataFrame:
    """unit: the files with a flow, without drawing it. These are the files with a callable: calls and decisions lie in one, and a route without one goes nowhere."""
    return callables(lines(_declaring(files), whole=True)).select(F.col("path").alias("unit")).distinct()


def diagnostics(nodes: DataFrame, limit: int = 180) -> DataFrame:
    """code, severity, message: that flows are read off the source, and how many files are left out of the list of units. nodes: unit at least."""
    files = nodes.agg(F.count_distinct("unit").alias("n")).where("n > 0")
    said = files.select(F.lit("FLOW_STATIC_HEURISTIC").alias("code"), F.lit("info").alias("severity"), F.lit("Flows are read off routes, callables, branches and calls; nothing is run.").alias("message"))
    cut = files.where(F.col("n") > limit).select(F.lit("FLOW_FILE_LIMIT").alias("code"), F.lit("info").alias("severity"), F.concat((F.col("n") - limit).cast("string"), F.lit(" files with less to say have no flow of their own.")).alias("message"))
    return said.unionByName(cut)
