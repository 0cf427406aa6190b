"""The pre-built queries over a code and session graph. Every ranking ends with a key, so that ties have one order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators.graph import Graph, degree_of, expand, shared_endpoints

SESSION_ACTIONS = ("TOUCHED", "EDITED", "CREATED")


def files_by_project(g: Graph, project: str) -> DataFrame:
    e = g.edge(["HAS_FILE"]).where(F.col("src") == project)
    return expand(e, g.node("File")).select("path", "lang", "lines").orderBy(F.col("lang").asc_nulls_last(), "path")


def deps_by_project(g: Graph, project: str) -> DataFrame:
    e = g.edge(["DEPENDS_ON"]).where(F.col("src") == project)
    return expand(e, g.node("Package")).select("name", "version", "source").orderBy("source", "name")


def shared_packages(g: Graph) -> DataFrame:
    found = shared_endpoints(g.edge(["DEPENDS_ON"]))
    return found.select(F.col("dst").alias("package"), F.col("members").alias("projects")).orderBy(F.size("projects").desc(), "package")


def hotfiles(g: Graph, project: str, limit: int = 10) -> DataFrame:
    files = g.node("File").where(F.col("project") == project)
    m = g.edge(["MODIFIED"], props=["lines_added"]).where(F.col("src") == F.col("dst"))
    out = expand(m, files).groupBy("path").agg(F.count("*").alias("changes"), F.sum("lines_added").alias("added"))
    return out.orderBy(F.desc("changes"), "path").limit(limit)


def hub_files(g: Graph, limit: int = 10) -> DataFrame:
    counted = g.edge(["DEFINES"]).groupBy("src").agg(F.count("*").alias("symbols"))
    return expand(counted, g.node("File"), on="src").select("path", "project", "symbols").orderBy(F.desc("symbols"), "path", "project").limit(limit)


def symbols_in_file(g: Graph, path: str) -> DataFrame:
    """Of every project that has a file of this path."""
    files = g.node("File").where(F.col("path") == path).select(F.col("id").alias("__file"))
    e = g.edge(["DEFINES"]).join(files, F.col("src") == F.col("__file"))
    return expand(e, g.node("Symbol")).select("name", "kind", "line").orderBy("line", "name")


def sessions_by_project(g: Graph, project: str, limit: int = 20) -> DataFrame:
    s = g.node("Session").where(F.col("project_name") == project)
    return s.select("session_id", "started_at", "slug", "user_prompts", "tool_uses", "model", "duration_ms").orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)


def files_in_session(g: Graph, session_id: str) -> DataFrame:
    e = g.edge(SESSION_ACTIONS, props=["count"]).where(F.col("src") == session_id)
    return expand(e, g.node("File")).select("path", "project", F.col("type").alias("action"), "count").orderBy("action", "path")


def sessions_for_file(g: Graph, fragment: str, limit: int | None = 20) -> DataFrame:
    """The latest sessions that touched a file whose path holds ``fragment``; None: all of them."""
    files = g.node("File").where(F.contains("path", F.lit(fragment))).select(F.col("id").alias("__file"))
    e = g.edge(SESSION_ACTIONS, props=["count"]).join(files, F.col("dst") == F.col("__file"))
    out = expand(e, g.node("Session"), on="src").select("session_id", "project_name", "started_at", "slug", F.col("type").alias("action"), "count")
    return out if limit is None else out.orderBy(F.desc_nulls_last("started_at"), "session_id", "action").limit(limit)


def hotfiles_by_sessions(g: Graph, project: str, limit: int = 10) -> DataFrame:
    s = g.node("Session").where(F.col("project_name") == project).select(F.col("id").alias("__session"))
    e = g.edge(["EDITED"], props=["count"]).join(s, F.col("src") == F.col("__session"))
    out = expand(e, g.node("File")).groupBy("path").agg(F.count("*").alias("sessions"), F.sum("count").alias("edits"))
    return out.orderBy(F.desc("sessions"), "path").limit(limit)


def import_graph(g: Graph, project: str) -> DataFrame:
    files = g.node("File")
    own = files.where(F.col("project") == project).select(F.col("id").alias("__id"), F.col("path").alias("source"))
    e = g.edge(["IMPORTS"]).join(own, F.col("src") == F.col("__id"))
    to_file = e.where(F.col("dst_label") == "File").join(files.select(F.col("id").alias("__t"), F.col("path").alias("target")), F.col("dst") == F.col("__t"))
    to_package = e.where(F.col("dst_label") == "Package").join(g.node("Package").select(F.col("id").alias("__t"), F.col("name").alias("target")), F.col("dst") == F.col("__t"))
    cols = ["source", F.col("dst_label").alias("target_type"), "target"]
    return to_file.select(*cols).unionByName(to_package.select(*cols)).orderBy("source", "target")


def callers_of(g: Graph, symbol: str, project: str | None = None) -> DataFrame:
    s = g.node("Symbol").where(F.col("name") == symbol)
    if project is not None:
        s = s.where(F.col("project") == project)
    s = s.select(F.col("id").alias("__symbol"), F.col("file").alias("defined_in"))
    f = g.node("File").select(F.col("id").alias("__file"), F.col("path").alias("caller"), "project")
    e = g.edge(["CALLS"]).join(s, F.col("dst") == F.col("__symbol"))
    return e.join(f, (F.col("src") == F.col("__file")) & (F.col("caller") != F.col("defined_in"))).select("caller", "project", "defined_in").orderBy("project", "caller")


def class_hierarchy(g: Graph, name: str, project: str | None = None) -> DataFrame:
    """role (parent or child), name, file, project."""
    own = g.node("Symbol").where(F.col("name") == name)
    if project is not None:
        own = own.where(F.col("project") == project)
    own = own.select(F.col("id").alias("__own"))
    e = g.edge(["INHERITS"])
    up = expand(e.join(own, F.col("src") == F.col("__own")), g.node("Symbol")).select(F.lit("parent").alias("role"), "name", "file", "project")
    down = expand(e.join(own, F.col("dst") == F.col("__own")), g.node("Symbol"), on="src").select(F.lit("child").alias("role"), "name", "file", "project")
    return up.unionByName(down).orderBy("role", "name", "file", "project")


def external_imports_by_project(g: Graph, project: str) -> DataFrame:
    files = g.node("File").where(F.col("project") == project).select(F.col("id").alias("__id"))
    e = g.edge(["IMPORTS"], dst="Package").join(files, F.col("src") == F.col("__id"))
    return expand(e, g.node("Package")).groupBy(F.col("name").alias("package")).agg(F.count("*").alias("importers")).orderBy(F.desc("importers"), "package")


def session_stats(g: Graph) -> DataFrame:
    """section (total, project, edge), name, n."""
    s = g.node("Session")
    total = s.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("sessions").alias("name"), "n")
    by_project = s.groupBy("project_name").agg(F.count("*").alias("n")).select(F.lit("project").alias("section"), F.col("project_name").alias("name"), "n")
    by_type = g.edge([*SESSION_ACTIONS, "IN_PROJECT"], src="Session").groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("section"), F.col("type").alias("name"), "n")
    return total.unionByName(by_project).unionByName(by_type)


def most_connected(g: Graph, project: str, limit: int = 8, at_least: int = 3) -> DataFrame:
    """The files of most edges: first the top ``limit``, then those with ``at_least``."""
    files = g.node("File").where(F.col("project") == project)
    d = degree_of(g, "File", files)
    out = d.join(files.select("id", "path"), "id").select("path", "connections").orderBy(F.desc("connections"), "path").limit(limit)
    return out.where(F.col("connections") >= at_least)
