"""Reports over a code graph: overview, repository map, diagrams, leads, compaction, projects.

Each is a set of small frames; only what is printed is brought to the driver, after its limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions import strings as S
from lattice.operators import library as L
from lattice.operators.graph import Graph, degree, expand

#: Fixed values of the reports.
LAYERS, MIXINS, BASES, BASE_LEAST, CRUD_OVER, DEPENDENCIES = 12, 8, 5, 2, 3, 15
CRUD_ENDINGS = ("Create", "Read", "Update", "Schema")
LEAD_COLUMNS = ("username", "name", "role", "headline", "points", "streak", "followers", "linkedin", "twitter", "github", "website", "profile_url", "products", "n_products", "n_featured", "max_upvotes", "topics", "about")


def languages(g: Graph, project: str) -> DataFrame:
    f = g.node("File").where((F.col("project") == project) & F.col("lang").isNotNull() & (F.col("lang") != ""))
    return f.groupBy("lang").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).orderBy(F.desc("files"), "lang")


def layers(g: Graph, project: str) -> DataFrame:
    """layer, files, symbols by the first directories."""
    f = g.node("File").where(F.col("project") == project).groupBy(S.directory_key(F.col("path")).alias("layer")).agg(F.count("*").alias("files"))
    s = g.node("Symbol").where(F.col("project") == project).groupBy(S.directory_key(F.col("file")).alias("layer")).agg(F.count("*").alias("symbols"))
    both = f.join(s, "layer", "full_outer")
    return both.select("layer", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols")).orderBy(F.desc("files"), "layer").limit(LAYERS)


def patterns(g: Graph, project: str) -> DataFrame:
    """position and text of each fact that passes its threshold."""
    s = g.node("Symbol").where(F.col("project") == project)
    mixins = s.where((F.col("kind") == "class") & F.contains("name", F.lit("Mixin"))).orderBy("name").agg(F.array_sort(F.collect_list("name")).alias("n")).where(F.size("n") > 0)
    mixins = mixins.select(F.lit(0).alias("position"), F.concat(F.lit("Mixins: "), F.array_join(F.slice("n", 1, MIXINS), ", ")).alias("text"))
    own = s.select("id", "name")
    inherits = g.edge(["INHERITS"]).join(own.select(F.col("id").alias("__child")), F.col("src") == F.col("__child"))
    bases = expand(inherits, own).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(BASES).where(F.col("n") >= BASE_LEAST)
    bases = bases.select(F.lit(1).alias("position"), F.concat(F.lit("Base class: "), "name", F.lit(" -> "), F.col("n").cast("string"), F.lit(" children")).alias("text"))
    ends = F.lit(False)
    for e in CRUD_ENDINGS:
        ends = ends | F.endswith("name", F.lit(e))
    crud = s.where((F.col("kind") == "class") & ends).agg(F.count("*").alias("n")).where(F.col("n") > CRUD_OVER)
    crud = crud.select(F.lit(2).alias("position"), F.concat(F.lit("CRUD schemas: "), F.col("n").cast("string"), F.lit(" Create/Read/Update/Schema classes")).alias("text"))
    protocols = s.where(F.col("kind").isin("protocol", "interface")).agg(F.count("*").alias("n")).where(F.col("n") > 0)
    protocols = protocols.select(F.lit(3).alias("position"), F.concat(F.lit("Protocols/Interfaces: "), F.col("n").cast("string")).alias("text"))
    return mixins.unionByName(bases).unionByName(crud).unionByName(protocols).orderBy("position", "text")


def overview(g: Graph, project: str) -> dict | None:
    """The architecture report; null for an unknown project, and no key for an empty part."""
    head = g.node("Project").where(F.col("name") == project).select("stack", "description").first()
    if head is None:
        return None
    own = F.col("project") == project
    out: dict = {
        "name": project, "stack": head["stack"] or "(no stack)", "description": head["description"] or "",
        "counts": {"files": g.node("File").where(own).count(), "symbols": g.node("Symbol").where(own).count(), "packages": g.edge(["DEPENDS_ON"]).where(F.col("src") == project).count()},
    }
    parts = {
        "languages": languages(g, project), "layers": layers(g, project), "patterns": patterns(g, project).select("text"),
        "dependencies": L.deps_by_project(g, project).select("name", "source").limit(DEPENDENCIES), "hub_files": L.most_connected(g, project),
    }
    for k, df in parts.items():
        rows = [r[0] if len(r) == 1 else tuple(r) for r in df.collect()]
        if rows:
            out[k] = rows
    return out


def repomap(g: Graph, project: str, lines: DataFrame | None = None, files: int = 20) -> DataFrame:
    """position, path, connections and the ordered symbols (name, kind, line, signature) of the most connected files.

    ``lines`` (path, line_no from 1, text) supplies signatures; a decorator's line is joined to the next.
    """
    own = g.node("File").where(F.col("project") == project).select("id", "path")
    d = own.join(degree(g.edge(), "File").select("id", "connections"), "id", "left").select("id", "path", F.coalesce("connections", F.lit(0)).alias("connections"))
    top = d.orderBy(F.desc("connections"), "path").limit(files)
    s = expand(g.edge(["DEFINES"]).join(top.select(F.col("id").alias("__file"), "path"), F.col("src") == F.col("__file")), g.node("Symbol")).select("path", "name", "kind", "line")
    if lines is None:
        s = s.withColumn("signature", F.lit(None).cast("string"))
    else:
        at = lines.select(F.col("path").alias("__p"), F.col("line_no").alias("__n"), F.trim("text").alias("__t"))
        nxt = lines.select(F.col("path").alias("__p2"), (F.col("line_no") - 1).alias("__n2"), F.trim("text").alias("__t2"))
        s = s.join(at, (F.col("path") == F.col("__p")) & (F.col("line") == F.col("__n")), "left").join(nxt, (F.col("path") == F.col("__p2")) & (F.col("line") == F.col("__n2")), "left")
        s = s.select("path", "name", "kind", "line", F.when(F.startswith("__t", F.lit("@")), F.concat_ws(" ", "__t", "__t2")).otherwise(F.col("__t")).alias("signature"))
    listed = s.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind", "signature"))).alias("symbols"))
    return top.join(listed, "path", "left").select("path", "connections", "symbols").orderBy(F.desc("connections"), "path")


def repomap_yaml(rows: DataFrame) -> str:
    import yaml

    out = [{"path": r["path"], "connections": r["connections"], "symbols": [{k: v for k, v in s.asDict().items() if v is not None} for s in r["symbols"] or []]} for r in rows.collect()]
    return yaml.safe_dump({"files": out}, sort_keys=False, allow_unicode=True)


def diagram(g: Graph, kind: str, project: str, most: int = 40) -> str:
    """A flow chart of at most ``most`` edges: inheritance, imports, calls or deps (grouped by source)."""
    f, s = g.node("File").select(F.col("id").alias("f"), F.col("path"), "project"), g.node("Symbol").select(F.col("id").alias("s"), F.col("name"), F.col("project").alias("sp"))
    if kind == "deps":
        rows = L.deps_by_project(g, project).limit(most).collect()
        out = ["graph LR", f'  {_mid(project)}["{_label(project)}"]']
        for source in sorted({r["source"] or "" for r in rows}):
            out.append(f'  subgraph {_mid(source or "other")}["{_label(source or "other")}"]')
            out += [f'    {_mid(r["name"])}["{_label(r["name"])}"]' for r in rows if (r["source"] or "") == source]
            out.append("  end")
        return "\n".join([*out, *[f"  {_mid(project)} --> {_mid(r['name'])}" for r in rows]])
    if kind == "inheritance":
        e = g.edge(["INHERITS"]).join(s.where(F.col("sp") == project), F.col("src") == F.col("s")).select(F.col("name").alias("a"), "dst")
        pairs = e.join(s, F.col("dst") == F.col("s")).select("a", F.col("name").alias("b"))
    elif kind == "imports":
        pairs = L.import_graph(g, project).where(F.col("target_type") == "File").select(F.col("source").alias("a"), F.col("target").alias("b"))
    elif kind == "calls":
        e = g.edge(["CALLS"]).join(f.where(F.col("project") == project), F.col("src") == F.col("f")).select(F.col("path").alias("a"), "dst")
        pairs = e.join(s, F.col("dst") == F.col("s")).select("a", F.col("name").alias("b"))
    else:
        raise ValueError(f"no diagram of {kind}")
    rows = pairs.distinct().orderBy("a", "b").limit(most).collect()
    arrow = "--|>" if kind == "inheritance" else "-->"
    head = "classDiagram" if kind == "inheritance" else "graph LR"
    if kind == "inheritance":
        return "\n".join([head, *[f"  {_mid(r['a'])} {arrow} {_mid(r['b'])}" for r in rows]])
    return "\n".join([head, *[f'  {_mid(r["a"])}["{_label(r["a"])}"] {arrow} {_mid(r["b"])}["{_label(r["b"])}"]' for r in rows]])


def _mid(text: str) -> str:
    import re

    return re.sub("[^a-zA-Z0-9_]", "_", text)


def _label(text: str) -> str:
    return text.replace('"', "'")


def render(df: DataFrame, title: str = "", most: int = 50) -> str:
    """A plain text table of the first rows."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
    width = [max([len(c), *(len(r[k]) for r in rows)]) for k, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)).rstrip()
    return "\n".join([*([title] if title else []), line(df.columns), line(["-" * w for w in width]), *map(line, rows)])


def people(products: DataFrame) -> DataFrame:
    """One row for each user of the products' makers: the best role, what they did and how it went.

    maker wins over any other role; a missing role is maker. Lists are in order of the slug.
    """
    m = products.select("slug", F.col("name").alias("product"), "upvotes", "featured_at", "topics", F.explode("makers").alias("m"))
    m = m.where(F.coalesce(F.col("m.username"), F.lit("")) != "").withColumn("role", F.coalesce(F.nullif(F.col("m.role"), F.lit("")), F.lit("maker")))
    ordered = F.array_sort(F.collect_list(F.struct("slug", "product", F.col("m.name").alias("name"), "role")))
    out = m.groupBy(F.col("m.username").alias("username")).agg(
        F.when(F.bool_or(F.col("role") == "maker"), "maker").otherwise(F.min("role")).alias("role"), ordered.alias("__o"), F.count("*").alias("n_products"),
        F.count_if(F.coalesce("featured_at", F.lit("")) != "").alias("n_featured"), F.max("upvotes").alias("max_upvotes"), F.array_sort(F.collect_set("topics")).alias("__topics"),
    )
    return out.select(
        "username", "role", F.filter(F.transform("__o", lambda x: x["name"]), lambda x: x.isNotNull())[0].alias("name"), F.array_join(F.slice(F.transform("__o", lambda x: x["product"]), 1, 5), "; ").alias("products"),
        F.array_sort(F.array_distinct(F.transform("__o", lambda x: x["role"]))).alias("roles"), "n_products", "n_featured", "max_upvotes", F.array_join(F.slice("__topics", 1, 5), "; ").alias("topics"),
    )


def leads(products: DataFrame, profiles: DataFrame, *, points: tuple[int, int | None] = (5, 1000), upvotes: tuple[int, int | None] = (5, 700), streak: int = 0, role: str | None = None) -> DataFrame:
    """People with their profiles, within inclusive bounds. A user without profile has 0 points."""
    p = profiles.dropDuplicates(["username"]).drop("is_maker")
    both = people(products).join(p, "username", "left")
    for c in ("points", "streak", "followers"):
        both = both.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    for c in ("headline", "about", "linkedin", "twitter", "github", "website", "profile_url"):
        both = both.withColumn(c, F.coalesce(c, F.lit("")))
    keep = (F.col("streak") >= streak) & _between("points", points) & _between("max_upvotes", upvotes)
    if role is not None:
        keep = keep & (F.col("role") == role)
    return both.where(keep).select(*LEAD_COLUMNS).orderBy(F.desc("points"), "username")


def _between(c: str, bounds: tuple[int, int | None]) -> Column:
    low = F.coalesce(F.col(c), F.lit(0)) >= bounds[0]
    return low if bounds[1] is None else low & (F.coalesce(F.col(c), F.lit(0)) <= bounds[1])


def compaction_candidates(docs: DataFrame, today: Column, *, days: int = 90, chars: int = 3000, done: str = "compacted", every: bool = False, created: str = "created", size: str = "n_chars", status: str = "status") -> DataFrame:
    """Notes that are old or long and not compacted yet; with ``every`` all that are not compacted."""
    fresh = ~F.col(status).eqNullSafe(F.lit(done))
    return docs.where(fresh if every else fresh & (F.coalesce(F.col(created) < F.date_sub(today, days), F.lit(False)) | (F.col(size) >= chars)))


def resolve_project(projects: DataFrame, name: str) -> DataFrame:
    """By path if it has a slash or a tilde in front, else by name whatever the case."""
    if "/" in name or name.startswith("~"):
        return projects.where(F.col("path") == name.rstrip("/"))
    return projects.where(F.lower("name") == name.lower())


def portfolio(g: Graph) -> DataFrame:
    """project, stack, files, symbols, packages of every project."""
    f = g.node("File").groupBy("project").agg(F.count("*").alias("files"))
    s = g.node("Symbol").groupBy("project").agg(F.count("*").alias("symbols"))
    p = g.edge(["DEPENDS_ON"]).groupBy(F.col("src").alias("project")).agg(F.countDistinct("dst").alias("packages"))
    out = g.node("Project").select(F.col("name").alias("project"), "stack")
    for part in (f, s, p):
        out = out.join(part, "project", "left")
    return out.fillna(0, ["files", "symbols", "packages"]).orderBy("project")


def counts_by_namespace(tables: Mapping[str, DataFrame], namespace: str = "source", searchable: Sequence[str] = ("SourceDoc", "Video", "Maker")) -> DataFrame:
    """source, a count for each kind, and total of the searchable kinds."""
    out: DataFrame | None = None
    for kind, df in tables.items():
        part = df.groupBy(F.col(namespace).alias("source")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables")
    wide = out.groupBy("source").pivot("kind", list(tables)).agg(F.sum("n")).fillna(0)
    total = sum((F.col(k) for k in tables if k in searchable), F.lit(0))
    return wide.withColumn("total", total.cast("bigint")).orderBy("source")
