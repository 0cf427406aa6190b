"""Registered queries that call the code, session, product and source operators, over the driver tables read as such.

The tables are mapped to the engine's own schema: nations are projects, orders are files, lines of
orders are symbols, parts are packages, users of events are sessions. Logs, manifests, notes,
subtitles and listings are written out as text from whole tables and read back by the parsers. The
SQL states the same results from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import strings as S
from lattice.operators import library as L
from lattice.operators import reports as R
from lattice.operators.graph import Graph
from lattice.operators.profiles import product_links, profile_search, stored_profiles
from lattice.plans import workload
from lattice.plans.star import load
from lattice.plans.workload import bars, query
from lattice.session import scratch

P = "NATION_7"
ACTIONS = {"view": "TOUCHED", "click": "EDITED", "purchase": "CREATED"}


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def code_graph(spark: SparkSession, d: str, only: str | None = None) -> Graph:
    """The tables as a graph of the engine's schema.

    ``only``: files, symbols and their edges are those of one project, for reports on it; its files have no edges with files of others, as
    all orders of a customer are of one project. They and their lines are written once, so that the whole tables are joined once and not for each part.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        if only is None:
            return df
        where = scratch(spark, name)
        df.write.option("compression", "zstd").parquet(where)
        return spark.read.parquet(where)

    nation, customer, supplier, part, orders, line, events = (load(spark, d, t) for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    none = F.lit("")
    project = nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("stack"), text("n_regionkey")).alias("stack"), F.concat(F.lit("/"), "n_name").alias("path"), F.lit("active").alias("status"), F.lit(False).alias("has_claude_md"), F.concat(F.lit("nation "), text("n_nationkey")).alias("description"))
    owner = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("project"))
    owner = owner if only is None else owner.where(F.col("project") == only)
    path = F.concat_ws("/", "o_orderstatus", F.substring("o_orderpriority", 1, 1), text("o_orderkey"))
    files = orders.join(owner, F.col("o_custkey") == F.col("c_custkey")).select(F.concat_ws("|", "project", path).alias("id"), path.alias("path"), "project", F.col("o_orderpriority").alias("lang"), F.floor("o_totalprice").alias("lines"), "o_orderkey", "o_custkey")
    files = kept(files, "files")
    suffix = F.when(F.col("l_returnflag") == "A", "Create").when(F.col("l_returnflag") == "R", "Mixin").otherwise("")
    own = kept(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").join(files, F.col("l_orderkey") == F.col("o_orderkey")), "lines")
    symbols = own.select(
        F.concat_ws("|", "id", text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("id"), F.concat(F.lit("S"), text(F.col("l_partkey") % 40), suffix).alias("name"), "project", F.col("path").alias("file"),
        F.when(F.col("l_linestatus") == "O", "class").otherwise("interface").alias("kind"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("id").alias("file_id"),
    )
    follow = files.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).where(F.col("dst").isNotNull())
    first = symbols.where(F.col("line") == 1).select(F.col("file_id").alias("__f"), F.col("id").alias("dst"))
    home = nation.select(F.col("n_nationkey").alias("__n"), F.col("n_name").alias("project_name"))
    users = events.groupBy("user_id").agg(F.min("ts").alias("__a"), F.count_if(F.col("event_type") == "signup").alias("user_prompts"), F.count("*").alias("tool_uses"))
    session = users.join(home, F.col("user_id") % 25 == F.col("__n")).select(
        text("user_id").alias("id"), text("user_id").alias("session_id"), "project_name", none.alias("project_path"), F.date_format("__a", "yyyy-MM-dd HH:mm:ss").alias("started_at"), none.alias("ended_at"), F.lit(0).cast("bigint").alias("duration_ms"),
        "user_prompts", "tool_uses", F.lit("m").alias("model"), none.alias("git_branch"), F.concat(F.lit("s"), text("user_id")).alias("slug"),
    )
    acts = events.join(files, F.col("event_id") == F.col("o_orderkey")).select("event_type", text("user_id").alias("src"), F.col("id").alias("dst"), F.from_json("props", "k BIGINT")["k"].alias("count"))
    edges = {
        ("Project", "HAS_FILE", "File"): files.select(F.col("project").alias("src"), F.col("id").alias("dst")),
        ("File", "DEFINES", "Symbol"): symbols.select(F.col("file_id").alias("src"), F.col("id").alias("dst")),
        ("Project", "DEPENDS_ON", "Package"): line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), text("l_partkey").alias("dst")).distinct(),
        ("File", "MODIFIED", "File"): own.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("l_quantity").cast("bigint").alias("lines_added")),
        ("File", "IMPORTS", "File"): follow,
        ("File", "IMPORTS", "Package"): own.where(F.col("l_returnflag") == "A").select(F.col("id").alias("src"), text("l_partkey").alias("dst")).distinct(),
        ("File", "CALLS", "Symbol"): follow.join(symbols.select("file_id", F.col("id").alias("__s")), F.col("dst") == F.col("file_id")).select("src", F.col("__s").alias("dst")),
        ("Symbol", "INHERITS", "Symbol"): symbols.where(F.col("line") > 1).join(first, F.col("file_id") == F.col("__f")).select(F.col("id").alias("src"), "dst"),
        **{("Session", a, "File"): acts.where(F.col("event_type") == k).select("src", "dst", "count") for k, a in ACTIONS.items()},
        ("Session", "IN_PROJECT", "Project"): session.select(F.col("id").alias("src"), F.col("project_name").alias("dst")),
    }
    nodes = {"Project": project, "File": files.drop("o_orderkey", "o_custkey"), "Symbol": symbols.drop("file_id"), "Package": part.select(text("p_partkey").alias("id"), F.concat_ws(" ", "p_name", text("p_partkey")).alias("name"), text("p_size").alias("version"), F.col("p_brand").alias("source")), "Session": session}
    return Graph(spark, nodes, edges)


#: The same graph in SQL.
_CODE = """WITH project AS (SELECT n_name AS name, 'stack' || n_regionkey AS stack, 'nation ' || n_nationkey AS description FROM nation),
file AS (SELECT n_name || '|' || o_orderstatus || '/' || substr(o_orderpriority, 1, 1) || '/' || o_orderkey AS id, o_orderstatus || '/' || substr(o_orderpriority, 1, 1) || '/' || o_orderkey AS path, n_name AS project, o_orderpriority AS lang, floor(o_totalprice)::BIGINT AS lines, o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
own AS (SELECT * FROM lineitem JOIN file ON o_orderkey = l_orderkey),
symbol AS (SELECT id || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS id, 'S' || (l_partkey % 40) || CASE l_returnflag WHEN 'A' THEN 'Create' WHEN 'R' THEN 'Mixin' ELSE '' END AS name, project, path AS file, CASE l_linestatus WHEN 'O' THEN 'class' ELSE 'interface' END AS kind, l_linenumber::BIGINT AS line, id AS file_id FROM own),
package AS (SELECT p_partkey::VARCHAR AS id, p_name || ' ' || p_partkey AS name, p_size::VARCHAR AS version, p_brand AS source FROM part),
depends AS (SELECT DISTINCT n_name AS src, l_partkey::VARCHAR AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
follow AS (SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM file) WHERE dst IS NOT NULL),
uses AS (SELECT DISTINCT id AS src, l_partkey::VARCHAR AS dst FROM own WHERE l_returnflag = 'A'),
calls AS (SELECT src, symbol.id AS dst FROM follow JOIN symbol ON file_id = follow.dst),
inherits AS (SELECT a.id AS src, b.id AS dst FROM symbol a JOIN symbol b ON a.file_id = b.file_id AND b.line = 1 AND a.line > 1),
session AS (SELECT user_id::VARCHAR AS id, n_name AS project_name, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, user_prompts, tool_uses, 's' || user_id AS slug FROM (SELECT user_id, min(ts) AS a, count(*) FILTER (event_type = 'signup') AS user_prompts, count(*) AS tool_uses FROM events GROUP BY 1) JOIN nation ON n_nationkey = user_id % 25),
acts AS (SELECT CASE event_type WHEN 'view' THEN 'TOUCHED' WHEN 'click' THEN 'EDITED' ELSE 'CREATED' END AS type, user_id::VARCHAR AS src, id AS dst, CAST(props::JSON ->> 'k' AS BIGINT) AS count FROM events JOIN file ON o_orderkey = event_id WHERE event_type IN ('view', 'click', 'purchase')),
ends AS (SELECT project AS n, 'Project' AS label FROM file UNION ALL SELECT id, 'File' FROM file UNION ALL SELECT file_id, 'File' FROM symbol UNION ALL SELECT id, 'Symbol' FROM symbol UNION ALL SELECT src, 'Project' FROM depends UNION ALL SELECT dst, 'Package' FROM depends
  UNION ALL SELECT id, 'File' FROM own UNION ALL SELECT src, 'File' FROM follow UNION ALL SELECT dst, 'File' FROM follow WHERE src <> dst UNION ALL SELECT src, 'File' FROM uses UNION ALL SELECT dst, 'Package' FROM uses UNION ALL SELECT src, 'File' FROM calls UNION ALL SELECT dst, 'Symbol' FROM calls UNION ALL SELECT src, 'Symbol' FROM inherits UNION ALL SELECT dst, 'Symbol' FROM inherits WHERE src <> dst
  UNION ALL SELECT src, 'Session' FROM acts UNION ALL SELECT dst, 'File' FROM acts UNION ALL SELECT id, 'Session' FROM session UNION ALL SELECT project_name, 'Project' FROM session),
degree AS (SELECT n AS id, count(*) AS connections FROM ends WHERE label = 'File' GROUP BY 1)
"""


def code(sql: str):
    return query(_CODE + sql)


@code(f"SELECT path, lang, lines FROM file WHERE project = '{P}'")
def code_files(spark: SparkSession, d: str) -> DataFrame:
    return L.files_by_project(code_graph(spark, d), P)


@code(f"SELECT name, version, source FROM depends JOIN package ON dst = id WHERE src = '{P}'")
def code_deps(spark: SparkSession, d: str) -> DataFrame:
    return L.deps_by_project(code_graph(spark, d), P)


@code("SELECT dst AS package, string_agg(src, '|' ORDER BY src) AS projects FROM depends GROUP BY 1 HAVING count(*) >= 2")
def code_shared(spark: SparkSession, d: str) -> DataFrame:
    return L.shared_packages(code_graph(spark, d)).select("package", bars(F.col("projects")).alias("projects"))


@code(f"SELECT path, count(*) AS changes, sum(l_quantity::BIGINT)::BIGINT AS added FROM own WHERE project = '{P}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def code_hotfiles(spark: SparkSession, d: str) -> DataFrame:
    return L.hotfiles(code_graph(spark, d), P)


@code("SELECT path, project, count(*) AS symbols FROM own GROUP BY id, path, project ORDER BY 3 DESC, 1, 2 LIMIT 10")
def code_hub_files(spark: SparkSession, d: str) -> DataFrame:
    return L.hub_files(code_graph(spark, d))


@code("SELECT name, kind, line FROM symbol WHERE file = (SELECT path FROM file WHERE o_orderkey = 42)")
def code_symbols_in_file(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_orderkey = 42").first()
    return L.symbols_in_file(code_graph(spark, d), f"{o['o_orderstatus']}/{o['o_orderpriority'][0]}/42")


@code(f"SELECT id AS session_id, started_at, slug, user_prompts, tool_uses, 'm' AS model, 0::BIGINT AS duration_ms FROM session WHERE project_name = '{P}' ORDER BY started_at DESC, id LIMIT 20")
def code_sessions(spark: SparkSession, d: str) -> DataFrame:
    return L.sessions_by_project(code_graph(spark, d), P)


@code("SELECT path, project, type AS action, count FROM acts JOIN file ON dst = id WHERE src = '5'")
def code_files_in_session(spark: SparkSession, d: str) -> DataFrame:
    return L.files_in_session(code_graph(spark, d), "5")


@code("SELECT session.id AS session_id, project_name, started_at, slug, type AS action, count FROM acts JOIN file ON dst = file.id JOIN session ON src = session.id WHERE contains(path, '/12') ORDER BY started_at DESC, session.id, type, count LIMIT 20")
def code_sessions_for_file(spark: SparkSession, d: str) -> DataFrame:
    found = L.sessions_for_file(code_graph(spark, d), "/12", None)
    return found.orderBy(F.desc("started_at"), "session_id", "action", "count").limit(20)


@code(f"SELECT path, count(*) AS sessions, sum(count)::BIGINT AS edits FROM acts JOIN session ON src = session.id JOIN file ON dst = file.id WHERE type = 'EDITED' AND project_name = '{P}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def code_hotfiles_by_sessions(spark: SparkSession, d: str) -> DataFrame:
    return L.hotfiles_by_sessions(code_graph(spark, d), P)


@code(f"SELECT a.path AS source, 'File' AS target_type, b.path AS target FROM follow JOIN file a ON src = a.id JOIN file b ON dst = b.id WHERE a.project = '{P}' UNION ALL SELECT path, 'Package', name FROM uses JOIN file ON src = file.id JOIN package ON dst = package.id WHERE project = '{P}'")
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return L.import_graph(code_graph(spark, d), P)


@code("SELECT f.path AS caller, f.project, s.file AS defined_in FROM calls JOIN symbol s ON dst = s.id JOIN file f ON src = f.id WHERE s.name = 'S7Mixin' AND f.path <> s.file")
def code_callers(spark: SparkSession, d: str) -> DataFrame:
    return L.callers_of(code_graph(spark, d), "S7Mixin")


@code("SELECT 'parent' AS role, p.name, p.file, p.project FROM inherits JOIN symbol s ON src = s.id JOIN symbol p ON dst = p.id WHERE s.name = 'S7Mixin' UNION ALL SELECT 'child', c.name, c.file, c.project FROM inherits JOIN symbol s ON dst = s.id JOIN symbol c ON src = c.id WHERE s.name = 'S7Mixin'")
def code_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return L.class_hierarchy(code_graph(spark, d), "S7Mixin")


@code(f"SELECT name AS package, count(*) AS importers FROM uses JOIN file ON src = file.id JOIN package ON dst = package.id WHERE project = '{P}' GROUP BY 1")
def code_external_imports(spark: SparkSession, d: str) -> DataFrame:
    return L.external_imports_by_project(code_graph(spark, d), P)


@code("SELECT 'total' AS section, 'sessions' AS name, count(*) AS n FROM session UNION ALL SELECT 'project', project_name, count(*) FROM session GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM acts GROUP BY 2 UNION ALL SELECT 'edge', 'IN_PROJECT', count(*) FROM session")
def code_session_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.session_stats(code_graph(spark, d))


@code(f"SELECT path, connections FROM degree JOIN file USING (id) WHERE project = '{P}' ORDER BY 2 DESC, 1 LIMIT 8")
def code_most_connected(spark: SparkSession, d: str) -> DataFrame:
    return L.most_connected(code_graph(spark, d), P)


@code(f"SELECT lang, count(*) AS files, sum(lines)::BIGINT AS lines FROM file WHERE project = '{P}' GROUP BY 1")
def code_languages(spark: SparkSession, d: str) -> DataFrame:
    return R.languages(code_graph(spark, d), P)


_KEY = "split_part({0}, '/', 1) || '/' || split_part({0}, '/', 2) || '/'"


@code(f"SELECT layer, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols FROM (SELECT {_KEY.format('path')} AS layer, count(*) AS files FROM file WHERE project = '{P}' GROUP BY 1) FULL JOIN (SELECT {_KEY.format('file')} AS layer, count(*) AS symbols FROM symbol WHERE project = '{P}' GROUP BY 1) USING (layer) ORDER BY files DESC, layer LIMIT 12")
def code_layers(spark: SparkSession, d: str) -> DataFrame:
    return R.layers(code_graph(spark, d), P)


_PATTERNS = f"""SELECT 0 AS position, 'Mixins: ' || array_to_string(list_sort(list(name))[1:8], ', ') AS text FROM symbol WHERE project = '{P}' AND kind = 'class' AND contains(name, 'Mixin') HAVING count(*) > 0
UNION ALL SELECT 1, 'Base class: ' || name || ' -> ' || n || ' children' FROM (SELECT p.name, count(*) AS n FROM inherits JOIN symbol c ON src = c.id JOIN symbol p ON dst = p.id WHERE c.project = '{P}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) WHERE n >= 2
UNION ALL SELECT 2, 'CRUD schemas: ' || count(*) || ' Create/Read/Update/Schema classes' FROM symbol WHERE project = '{P}' AND kind = 'class' AND name LIKE '%Create' HAVING count(*) > 3
UNION ALL SELECT 3, 'Protocols/Interfaces: ' || count(*) FROM symbol WHERE project = '{P}' AND kind = 'interface' HAVING count(*) > 0"""


@code(_PATTERNS)
def code_patterns(spark: SparkSession, d: str) -> DataFrame:
    return R.patterns(code_graph(spark, d), P)


@code(f"""SELECT name, stack, description, (SELECT count(*) FROM file WHERE project = p.name) AS files, (SELECT count(*) FROM symbol WHERE project = p.name) AS symbols, (SELECT count(*) FROM depends WHERE src = p.name) AS packages,
(SELECT count(DISTINCT lang) FROM file WHERE project = p.name) AS languages, (SELECT least(12, count(DISTINCT {_KEY.format('path')})) FROM file WHERE project = name) AS layers, (SELECT count(*) FROM ({_PATTERNS})) AS patterns, (SELECT least(15, count(*)) FROM depends WHERE src = name) AS dependencies, (SELECT least(8, count(*)) FROM degree JOIN file USING (id) WHERE project = name AND connections >= 3) AS hubs FROM project p WHERE name = '{P}'""")
def code_overview(spark: SparkSession, d: str) -> DataFrame:
    o = R.overview(code_graph(spark, d, P), P) or {"counts": {}}
    row = (o.get("name"), o.get("stack"), o.get("description"), *(o["counts"].get(k) for k in ("files", "symbols", "packages")), *(len(o.get(k, ())) for k in ("languages", "layers", "patterns", "dependencies", "hub_files")))
    return spark.createDataFrame([row], "name string, stack string, description string, files bigint, symbols bigint, packages bigint, languages bigint, layers bigint, patterns bigint, dependencies bigint, hubs bigint")


@code(f"""SELECT path, connections, (SELECT string_agg(line || ':' || name || ':' || kind, '|' ORDER BY line, name, kind) FROM symbol WHERE file_id = t.id) AS symbols FROM (SELECT id, path, coalesce(connections, 0) AS connections FROM file LEFT JOIN degree USING (id) WHERE project = '{P}' ORDER BY 3 DESC, 2 LIMIT 20) t""")
def code_repomap(spark: SparkSession, d: str) -> DataFrame:
    m = R.repomap(code_graph(spark, d), P)
    return m.select("path", "connections", bars(F.transform("symbols", lambda s: F.concat_ws(":", s["line"].cast("string"), s["name"], s["kind"]))).alias("symbols"))


_MID = "regexp_replace({0}, '[^a-zA-Z0-9_]', '_', 'g')"


@code(f"""SELECT 'graph LR' AS line UNION ALL SELECT '  ' || {_MID.format('a')} || '["' || a || '"] --> ' || {_MID.format('b')} || '["' || b || '"]' FROM (SELECT DISTINCT a.path AS a, b.path AS b FROM follow JOIN file a ON src = a.id JOIN file b ON dst = b.id WHERE a.project = '{P}' ORDER BY 1, 2 LIMIT 40)""")
def code_diagram(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in R.diagram(code_graph(spark, d), "imports", P).split("\n")], "line string")


@code("SELECT name AS project, stack, (SELECT count(*) FROM file WHERE project = p.name) AS files, (SELECT count(*) FROM symbol WHERE project = p.name) AS symbols, (SELECT count(*) FROM depends WHERE src = p.name) AS packages FROM project p")
def code_portfolio(spark: SparkSession, d: str) -> DataFrame:
    return R.portfolio(code_graph(spark, d))


@code(f"SELECT 'Symbol' AS label, count(*) AS n FROM symbol WHERE project <> '{P}' UNION ALL SELECT 'File', count(*) FROM file WHERE project <> '{P}' UNION ALL SELECT 'IMPORTS', (SELECT count(*) FROM follow JOIN file a ON src = a.id JOIN file b ON dst = b.id WHERE a.project <> '{P}' AND b.project <> '{P}') + (SELECT count(*) FROM uses JOIN file ON src = id WHERE project <> '{P}') UNION ALL SELECT 'EDITED', count(*) FROM acts WHERE type = 'EDITED' UNION ALL SELECT 'DEPENDS_ON', count(*) FROM depends WHERE src <> '{P}'")
def code_clear_project(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import clear_project

    g = code_graph(spark, d)
    left = Graph(spark, *clear_project(g.nodes, g.edges, P)).stats()
    return left.where(F.col("name").isin("Symbol", "File", "IMPORTS", "EDITED", "DEPENDS_ON")).select(F.col("name").alias("label"), "n")


# --- sessions as chat logs --------------------------------------------------------------------------


def chat_logs(spark: SparkSession, d: str) -> DataFrame:
    """session_id, dir, line_no and line: a line of JSON for each event of a user, prompts and uses of tools."""
    e = load(spark, d, "events")
    home = load(spark, d, "nation").select(F.col("n_nationkey").alias("__n"), F.concat(F.lit("-home-x-projects-"), F.replace("n_name", F.lit("_"), F.lit(""))).alias("dir"))
    e = e.join(home, F.col("user_id") % 25 == F.col("__n"))
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Write")
    path = F.concat(F.lit("/home/x/src/f"), F.from_json("props", "k BIGINT")["k"].cast("string"), F.lit(".py"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    prompt = F.to_json(F.struct(F.lit("user").alias("type"), at.alias("timestamp"), F.lit("/home/x").alias("cwd"), F.struct(F.concat(F.lit("prompt number "), text("event_id")).alias("content")).alias("message")))
    block = F.struct(F.lit("tool_use").alias("type"), tool.alias("name"), F.struct(path.alias("file_path")).alias("input"))
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), at.alias("timestamp"), F.struct(F.concat(F.lit("m"), text(F.col("event_id") % 3)).alias("model"), F.array(block).alias("content")).alias("message")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(text("user_id").alias("session_id"), "dir", (F.row_number().over(w) - 1).alias("line_no"), F.when(tool.isNull(), prompt).otherwise(use).alias("line"))


_LOGS = """WITH e AS (SELECT user_id::VARCHAR AS session_id, replace(n_name, '_', '') AS project, ts, event_id, event_type, CAST(props::JSON ->> 'k' AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, event_type IN ('view', 'click', 'purchase') AS tool FROM events JOIN nation ON n_nationkey = user_id % 25)
"""


@query(_LOGS + """SELECT session_id, project AS project_name, CASE WHEN bool_or(NOT tool) THEN '/home/x' ELSE '' END AS project_path, arg_min(stamp, (ts, event_id)) AS started_at, arg_max(stamp, (ts, event_id)) AS ended_at, count(*) FILTER (NOT tool) AS user_prompts, count(*) FILTER (tool) AS tool_uses,
coalesce('m' || (arg_min(event_id, (ts, event_id)) FILTER (tool) % 3), '') AS model FROM e GROUP BY 1, 2""")
def session_nodes(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import sessions

    return sessions.sessions(sessions.parse(chat_logs(spark, d))).select("session_id", "project_name", "project_path", "started_at", "ended_at", "user_prompts", "tool_uses", "model")


@query(_LOGS + """, s AS (SELECT session_id, bool_or(NOT tool) AS home FROM e GROUP BY 1)
SELECT session_id, project, CASE WHEN home THEN 'src/f' ELSE '/home/x/src/f' END || k || '.py' AS path, CASE max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) WHEN 1 THEN 'TOUCHED' WHEN 2 THEN 'EDITED' ELSE 'CREATED' END AS action, count(*) AS count FROM e JOIN s USING (session_id) WHERE tool GROUP BY session_id, project, home, k""")
def session_file_actions(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import sessions

    parsed = sessions.parse(chat_logs(spark, d))
    return sessions.file_actions(parsed, sessions.sessions(parsed)).select("session_id", "project", "path", "action", "count")


@query(_LOGS + """, p AS (SELECT session_id, string_agg(r || '. prompt number ' || event_id, chr(10) ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS r FROM e WHERE NOT tool) WHERE r <= 5 GROUP BY 1),
h AS (SELECT session_id, project, arg_min(stamp, (ts, event_id)) AS a FROM e GROUP BY 1, 2)
SELECT session_id, '[Project: ' || project || ' | ' || substr(a, 1, 10) || ']' AS head, coalesce('Prompts:' || chr(10) || t, '') AS prompts FROM h LEFT JOIN p USING (session_id)""")
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import sessions

    parsed = sessions.parse(chat_logs(spark, d))
    nodes = sessions.sessions(parsed)
    s = sessions.summaries(parsed, nodes, sessions.file_actions(parsed, nodes))
    part = F.regexp_extract("summary", r"(?s)(Prompts:\n(?:\d+\. prompt number \d+(?:\n(?=\d)|))*)", 1)
    return s.select("session_id", F.substring_index("summary", "\n", 1).alias("head"), part.alias("prompts"))


# --- commit logs, manifests, notes, subtitles -------------------------------------------------------


@query("SELECT 'f' || l_partkey AS file, 'c' || c_custkey AS project, c_name || '|' || c_mktsegment AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, l_quantity::BIGINT AS lines_added, l_linenumber::BIGINT AS lines_removed, substr(md5(o_orderkey::VARCHAR), 1, 8) AS commit FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def commit_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of their customer's repository, their lines as changed files, written as a log and parsed."""
    from lattice.sources import gitlog

    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    project = F.concat(F.lit("c"), text("c_custkey")).alias("project")
    head = o.select(project, (F.col("o_orderkey") * 1000).alias("line_no"), F.concat_ws("|", F.md5(text("o_orderkey")), "c_name", "c_mktsegment", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("line"))
    line = load(spark, d, "lineitem").join(o.select("o_orderkey", "c_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    body = line.select(project, (F.col("o_orderkey") * 1000 + F.col("l_linenumber")).alias("line_no"), F.concat_ws("\t", text(F.col("l_quantity").cast("bigint")), text("l_linenumber"), F.concat(F.lit("f"), text("l_partkey"))).alias("line"))
    return gitlog.parse_log(head.unionByName(body))


def manifest_tree(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as projects: package.json of even ones, requirements.txt and a manifest that does not count of odd ones."""
    line = load(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    name = F.concat(F.lit("p"), text("l_partkey"))
    project = F.concat(F.lit("s"), text("l_suppkey")).alias("project")
    version = F.concat(text(F.col("l_partkey") % 9), F.lit("."), text("l_partkey"))
    js = line.where("l_suppkey % 2 = 0").groupBy(project).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(name, F.concat(F.lit("^"), version)))).alias("dependencies"))).alias("text"))
    req = line.where("l_suppkey % 2 = 1").groupBy(project).agg(F.concat(F.lit("# listed\n-r base.txt\n"), F.array_join(F.collect_list(F.concat(name, F.lit(">="), version)), "\n")).alias("text"))
    skip = req.select("project", F.lit("node_modules/package.json").alias("path"), F.lit('{"dependencies": {"no": "1"}}').alias("text"))
    return js.select("project", F.lit("web/package.json").alias("path"), "text").unionByName(req.select("project", F.lit("requirements.txt").alias("path"), "text")).unionByName(skip)


@query("SELECT DISTINCT 's' || l_suppkey AS project, 'p' || l_partkey AS name, (l_partkey % 9) || '.' || l_partkey AS version, CASE WHEN l_suppkey % 2 = 0 THEN 'npm' ELSE 'pip' END AS source FROM lineitem")
def manifest_dependencies(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import manifests

    return manifests.scan_dependencies(manifest_tree(spark, d))


@query("SELECT 'total' AS section, 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'type', coalesce(lang, 'unknown'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'tags', 'unique', count(DISTINCT t) FROM (SELECT unnest(['note', source]) AS t FROM documents) WHERE t IS NOT NULL")
def notes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as notes with front matter, read by the notes' parser and counted."""
    from lattice.sources import notes

    docs = load(spark, d, "documents")
    head = F.concat(F.lit("---\ntitle: T"), text("doc_id"), F.coalesce(F.concat(F.lit("\ntype: "), "lang"), F.lit("")), F.lit("\ntags: [note"), F.coalesce(F.concat(F.lit(", "), "source"), F.lit("")), F.lit("]\n---\n"))
    tree = docs.select(F.lit("p").alias("project"), F.concat(F.lit("n/"), text("doc_id"), F.lit(".md")).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return notes.note_stats(notes.scan_notes(tree, "2024-01-01"))


def subtitles(spark: SparkSession, d: str) -> DataFrame:
    """A subtitle file of each conversation, a cue of a second for each turn."""
    c = load(spark, d, "conversations")
    stamp = lambda s: F.format_string("00:%02d:%02d.000", F.floor(s / 60), s % 60)
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    cue = F.concat(stamp(F.col("turn")), F.lit(" --> "), stamp(F.col("turn") + 1), F.lit("\n"), said)
    v = c.groupBy(text("conv_id").alias("video_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]).alias("cues"))
    return v.select("video_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join("cues", "\n\n")).alias("vtt"))


_SAID = r"""WITH c AS (SELECT conv_id::VARCHAR AS video_id, turn, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '<[^>]+>', '', 'g')) AS t FROM conversations)
"""


@query(_SAID + "SELECT video_id, coalesce(string_agg(t, ' ' ORDER BY turn), '') AS text FROM (SELECT video_id, t, min(turn) AS turn FROM c WHERE t <> '' GROUP BY 1, 2) GROUP BY 1")
def subtitle_text(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import transcripts

    return transcripts.vtt_text(subtitles(spark, d))


@query(_SAID + ", k AS (SELECT *, lag(t) OVER (PARTITION BY video_id ORDER BY turn) AS p FROM c WHERE t <> '') SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY turn) - 1 AS position, turn::DOUBLE AS start, t AS text FROM k WHERE p IS NULL OR p <> t")
def subtitle_segments(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import transcripts

    return transcripts.segments(subtitles(spark, d)).select("video_id", F.col("position").cast("bigint").alias("position"), "start", "text")


# --- products and people ----------------------------------------------------------------------------


def products(spark: SparkSession, d: str) -> DataFrame:
    """Parts as products, the suppliers of a part as its makers and commenters."""
    line = load(spark, d, "lineitem")
    role = F.when(F.col("l_suppkey") % 3 == 0, "commenter").when(F.col("l_suppkey") % 3 == 1, "maker").otherwise("")
    maker = F.struct(F.concat(F.lit("u"), text("l_suppkey")).alias("username"), F.concat(F.lit("User "), text("l_suppkey")).alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("bigint").alias("followers"), role.alias("role"))
    by = line.groupBy("l_partkey").agg(F.array_sort(F.collect_set(maker)).alias("makers"), F.count("*").alias("upvotes"))
    p = load(spark, d, "part").join(by, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(F.concat(F.lit("p"), text("p_partkey")).alias("slug"), F.col("p_name").alias("name"), F.col("p_type").alias("tagline"), "makers", "upvotes", F.when(F.col("p_size") % 2 == 0, "2024-01-01").alias("featured_at"), F.col("p_brand").alias("topics"), F.concat(F.lit("2024-0"), text(F.col("p_size") % 9 + 1), F.lit("-05")).alias("launch_date"))


_MAKERS = """WITH m AS (SELECT DISTINCT 'p' || l_partkey AS slug, p_name AS product, 'u' || l_suppkey AS username, 'User ' || l_suppkey AS name, CASE l_suppkey % 3 WHEN 0 THEN 'commenter' ELSE 'maker' END AS role, up AS upvotes, p_size % 2 = 0 AS featured, p_brand AS topic
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey, count(*) AS up FROM lineitem GROUP BY 1) USING (l_partkey)),
people AS (SELECT username, CASE WHEN bool_or(role = 'maker') THEN 'maker' ELSE min(role) END AS role, min(name) AS name, array_to_string(list(product ORDER BY slug)[1:5], '; ') AS products, count(*) AS n_products, count(*) FILTER (featured) AS n_featured, max(upvotes) AS max_upvotes, array_to_string(list_sort(list(DISTINCT topic))[1:5], '; ') AS topics FROM m GROUP BY 1)
"""


@query(_MAKERS + "SELECT * FROM people")
def product_people(spark: SparkSession, d: str) -> DataFrame:
    return R.people(products(spark, d)).select("username", "role", "name", "products", "n_products", "n_featured", "max_upvotes", "topics")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as profiles of their users, but for every fifth one."""
    s = load(spark, d, "supplier").where("s_suppkey % 5 <> 0")
    blank = {c: F.lit(None).cast("string").alias(c) for c in ("linkedin", "twitter", "github", "website")}
    return s.select(F.concat(F.lit("u"), text("s_suppkey")).alias("username"), F.concat(F.lit("/@u"), text("s_suppkey")).alias("profile_url"), F.col("s_name").alias("headline"), F.concat(F.lit("about "), "s_name").alias("about"), *blank.values(), F.lit(True).alias("is_maker"), (F.col("s_suppkey") % 30).alias("streak"), F.abs(F.col("s_acctbal")).cast("bigint").alias("points"), F.col("s_suppkey").alias("followers"))


@query(_MAKERS + "SELECT username, role, points, products, n_products, max_upvotes FROM (SELECT people.*, coalesce(trunc(abs(s_acctbal))::BIGINT, 0) AS points FROM people LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON username = 'u' || s_suppkey) WHERE points BETWEEN 5 AND 5000 AND max_upvotes BETWEEN 5 AND 700 AND role = 'maker'")
def product_leads(spark: SparkSession, d: str) -> DataFrame:
    return R.leads(products(spark, d), profiles(spark, d), points=(5, 5000), role="maker").select("username", "role", "points", "products", "n_products", "max_upvotes")


@query(_MAKERS + "SELECT 'user' AS kind, username AS src, string_agg(DISTINCT role, ',' ORDER BY role) AS what FROM m GROUP BY 2 UNION ALL SELECT 'edge', username, md5('x:' || slug) || CASE role WHEN 'maker' THEN 'MADE' ELSE 'COMMENTED' END FROM m")
def product_user_graph(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources.products import user_graph

    users, edges = user_graph(products(spark, d), "x")
    out = users.select(F.lit("user").alias("kind"), F.col("username").alias("src"), F.col("roles").alias("what"))
    for k, e in edges.items():
        out = out.unionByName(e.select(F.lit("edge").alias("kind"), "src", F.concat("dst", F.lit(k)).alias("what")))
    return out


def maker_table(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stored profiles, with the vector of the same number."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    rows = stored_profiles(profiles(spark, d).withColumn("name", F.initcap("username"))).withColumn("__n", F.substr("username", F.lit(2)).cast("bigint"))
    return rows.join(v, F.col("__n") == F.col("vec_id")).drop("__n", "vec_id")


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


@query(f"""SELECT 'maker:u' || s_suppkey AS id, 'U' || s_suppkey || ' (@u' || s_suppkey || ')' AS title, 'x/@u' || s_suppkey AS url,
concat_ws(' | ', s_name, CASE WHEN trunc(abs(s_acctbal)) > 0 THEN trunc(abs(s_acctbal))::BIGINT || ' pts' END, CASE WHEN s_suppkey % 30 > 0 THEN s_suppkey % 30 || 'd streak' END, s_suppkey || ' followers') AS content, floor(s * 1e6 + 0.5) / 1e6 AS relevance
FROM (SELECT *, list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS s FROM supplier JOIN embeddings ON vec_id = s_suppkey WHERE s_suppkey % 5 <> 0) ORDER BY s DESC, 'u' || s_suppkey LIMIT 10""")
def profile_nearest(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("__q"))
    found = profile_search(maker_table(spark, d).crossJoin(F.broadcast(q)), F.col("__q"), 10, source="x", home="x/")  # one row
    return found.select("id", "title", "url", "content", (F.floor(F.col("relevance") * 1e6 + 0.5) / 1e6).cast("double").alias("relevance"))


@query("SELECT 'u' || s_suppkey AS src, doc_id AS dst FROM supplier JOIN (SELECT l_partkey AS doc_id, string_agg('Makers: User u' || l_suppkey, '; ' ORDER BY l_suppkey) AS content FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1) ON contains(content, 'u' || s_suppkey) WHERE s_suppkey % 5 <> 0")
def profile_links(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey")  # one exchange, of plain rows
    docs = line.groupBy(F.col("l_partkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda s: F.concat(F.lit("Makers: User u"), text(s))), "; ").alias("content"))
    return product_links(stored_profiles(profiles(spark, d)), docs.withColumn("source_type", F.lit("x-product")), "x-product")


@query("SELECT source, SourceDoc, Maker, SourceDoc + Maker AS total FROM (SELECT source, count(*) AS SourceDoc FROM documents WHERE source IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT 'src' || (s_suppkey % 3) AS source, count(*) AS Maker FROM supplier GROUP BY 1) USING (source) WHERE Maker IS NOT NULL")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    makers = load(spark, d, "supplier").select(F.concat(F.lit("src"), text(F.col("s_suppkey") % 3)).alias("source"))
    found = R.counts_by_namespace({"SourceDoc": load(spark, d, "documents").where("source IS NOT NULL"), "Maker": makers})
    return found.where("SourceDoc > 0 AND Maker > 0")


# --- source code ------------------------------------------------------------------------------------


def source_tree(spark: SparkSession, d: str) -> DataFrame:
    """Orders as python files of their customer's project: a function for each line, which calls one named by the supplier; a class and its base."""
    line, orders, customer = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "customer")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.concat(F.lit("def f"), x["l_partkey"].cast("string"), F.lit("():\n    return f"), x["l_suppkey"].cast("string"), F.lit("()\n"))), "")
    by = line.groupBy("l_orderkey").agg(body.alias("body"))
    o = orders.join(by, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    head = F.concat(F.lit("import part"), text(F.col("o_orderkey") % 50), F.lit(".sub\nclass K"), text(F.col("o_orderkey") % 300), F.lit("(K"), text(F.col("o_orderkey") % 300 - 1), F.lit("):\n    pass\n"))
    return o.select(F.concat(F.lit("n"), text("c_nationkey")).alias("project"), F.concat(F.lit("src/o"), text("o_orderkey"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.concat(head, "body").alias("text"))


_SOURCE = """WITH o AS (SELECT 'n' || c_nationkey AS project, 'src/o' || o_orderkey || '.py' AS path, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
f AS (SELECT project, path, 'f' || l_partkey AS name, 'f' || l_suppkey AS called, 2 + 2 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem JOIN o ON o_orderkey = l_orderkey),
symbol AS (SELECT project, path, name, 'function' AS kind, max(line) AS line FROM f GROUP BY 1, 2, 3 UNION ALL SELECT project, path, 'K' || (o_orderkey % 300), 'class', 2 FROM o)
"""


@query(_SOURCE + "SELECT project, path AS file, name, kind, line FROM symbol")
def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import code as C

    return C.symbols(C.parse(source_tree(spark, d))).select("project", "file", "name", "kind", "line")


@query(_SOURCE + "SELECT DISTINCT a.project || '|' || a.path AS src, s.project || '|' || s.path || '|' || s.name AS dst FROM f a JOIN symbol s ON a.project = s.project AND a.called = s.name WHERE a.path <> s.path")
def source_calls(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import code as C

    records = C.stored(C.parse(source_tree(spark, d)), "symbol", "call")
    return C.call_edges(records, C.symbols(records), again=True)


@query(_SOURCE + "SELECT DISTINCT project || '|' || a.path || '|K' || (o_orderkey % 300) AS src, project || '|' || b.path || '|' || name AS dst FROM o a JOIN (SELECT * FROM symbol WHERE kind = 'class') b USING (project) WHERE name = 'K' || (o_orderkey % 300 - 1)")
def source_inherits(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import code as C

    records = C.stored(C.parse(source_tree(spark, d)), "symbol", "inherit")
    return C.inherit_edges(records, C.symbols(records), again=True)


@query(_SOURCE + "SELECT project || '|' || path AS src, 'part' || (o_orderkey % 50) AS dst FROM o WHERE o_orderkey % 50 < 25")
def source_imports(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import code as C
    from lattice.sources import files

    tree = source_tree(spark, d)
    known = spark.range(25).select(F.concat(F.lit("part"), text("id")).alias("id"), F.concat(F.lit("part"), text("id")).alias("name"))
    return C.import_edges(C.parse(tree), files.scan_files(tree), known)[1]


@query(_SOURCE + "SELECT project || '|' || path AS id, 'python' AS lang, 4 + 2 * (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM o")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import files

    return files.scan_files(source_tree(spark, d)).select("id", "lang", "lines")


# --- scalar functions -------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{:d}:{:02d}', s // 60, s % 60) END AS clock, s::DOUBLE AS seconds FROM (SELECT o_orderkey, o_orderkey * 7 AS s FROM orders)""")
def fn_clock(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", S.clock_text(F.col("o_orderkey") * 7).alias("clock"))
    return o.withColumn("seconds", S.clock_seconds(F.col("clock")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS day, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS at FROM orders")
def fn_dates(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon")
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("never")
    return o.select("o_orderkey", S.compact_date(day).alias("day"), F.date_format(S.any_timestamp(stamp), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a/o' || o_orderkey ELSE '/w/xy/a/o' || o_orderkey END AS below, CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_orderkey || '/ios' ELSE 'p' || o_orderkey END AS project, CASE WHEN o_orderkey % 4 = 0 THEN lpad(o_orderkey::VARCHAR, 11, 'v') END AS video FROM orders")
def fn_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 2 == 0, "/w/x/").otherwise("/w/xy/"), F.lit("a/o"), text(k))
    dashed = F.when(k % 3 == 0, F.concat(F.lit("-Users-u-projects-p"), text(k), F.lit("-ios"))).when(k % 3 == 1, F.concat(F.lit("-Users-u-projects-p"), text(k))).otherwise(F.concat(F.lit("-tmp-p"), text(k)))
    url = F.when(k % 8 == 0, F.concat(F.lit("https://t.be/watch?v="), F.lpad(text(k), 11, "v"), F.lit("&t=1"))).when(k % 4 == 0, F.concat(F.lit("https://youtu.be/"), F.lpad(text(k), 11, "v"))).otherwise(F.concat(F.lit("https://t.be/"), text(k)))
    return load(spark, d, "orders").select("o_orderkey", S.relative_path(path, F.lit("/w/x")).alias("below"), S.project_of_dashed(dashed).alias("project"), S.video_id(url).alias("video"))


@query("SELECT p_partkey, replace(p_name, ' ', ',') || ',' || lower(p_type) || ',2024-0' || (p_size % 9 + 1) AS tags, replace(replace(p_name, ' ', '_'), '#', '_') || '__' AS mid, p_name || chr(10) || p_type AS context FROM part")
def fn_tags(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    topics = F.concat(F.initcap(F.replace("p_name", F.lit(" "), F.lit(", "))), F.lit(", "), "p_type")
    return p.select("p_partkey", S.topic_tags(topics, F.concat(F.lit("2024-0"), text(F.col("p_size") % 9 + 1), F.lit("-01"))).alias("tags"), S.mermaid_id(F.concat("p_name", F.lit("#!"))).alias("mid"), S.sibling_context(F.lit(None).cast("string"), F.col("p_name"), F.col("p_type")).alias("context"))


@query("SELECT p_partkey, 'x' || p_partkey AS name, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size || '.0' END AS version FROM part")
def fn_requirement(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources.manifests import requirement

    k = F.col("p_partkey")
    sign = F.when(k % 4 == 0, ">=").when(k % 4 == 1, "==").otherwise("<")
    r = requirement(F.concat(F.lit("x"), text(k), F.when(k % 4 == 3, "").otherwise(F.concat(sign, F.lit(" "), text("p_size"), F.lit(".0")))))
    return load(spark, d, "part").select("p_partkey", r["name"].alias("name"), F.trim(r["version"]).alias("version"))


@query("SELECT s_suppkey, ['ann', 'supplier'] AS parts, s_suppkey % 3 = 0 AS same FROM supplier")
def fn_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://www.linkedin.com/in/"), F.when(k % 3 == 0, "annsupplier").otherwise("someone"), text(k))
    return load(spark, d, "supplier").select("s_suppkey", S.name_parts(F.lit("ann_Supplier")).alias("parts"), S.profile_matches(F.lit("ann_supplier"), url, F.lit("")).alias("same"))


_LANGS = [".py", ".ts", ".tsx", ".rs", ".go", ".rb", ".md", ".bin"]


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'tsx' WHEN 3 THEN 'rust' WHEN 4 THEN 'go' WHEN 5 THEN 'ruby' WHEN 6 THEN 'markdown' END AS lang, o_orderkey % 3 > 0 AS scanned FROM orders")
def fn_languages(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources import files

    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 3 == 0, "a/node_modules/").otherwise("a/node/"), text(k), F.array(*map(F.lit, _LANGS))[(k % 8).cast("int")])
    return load(spark, d, "orders").select("o_orderkey", files.language(path, documents=True).alias("lang"), files.scannable(path).alias("scanned"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS inside, CASE o_orderkey % 6 WHEN 0 THEN '.m' || o_orderkey WHEN 1 THEN 'm' || o_orderkey WHEN 2 THEN './m' || o_orderkey WHEN 3 THEN '@s/m' || o_orderkey WHEN 4 THEN 'crate::m' || o_orderkey ELSE 'm' || o_orderkey END AS target,
CASE o_orderkey % 6 WHEN 0 THEN 'm' || o_orderkey WHEN 2 THEN 'm' || o_orderkey WHEN 4 THEN 'm' || o_orderkey END AS fragment FROM orders""")
def fn_imports(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources.code import classify_import, import_fragment

    k = F.col("o_orderkey")
    m = F.concat(F.lit("m"), text(k))
    name = F.when(k % 6 == 0, F.concat(F.lit("."), m)).when(k % 6 == 1, F.concat(m, F.lit(".sub"))).when(k % 6 == 2, F.concat(F.lit("'./"), m, F.lit("'"))).when(k % 6 == 3, F.concat(F.lit("'@s/"), m, F.lit("/deep'"))).when(k % 6 == 4, F.concat(F.lit("crate::"), m)).otherwise(F.concat(m, F.lit("::x")))
    lang = F.when(k % 6 < 2, "python").when(k % 6 < 4, "typescript").otherwise("rust")
    o = load(spark, d, "orders").select("o_orderkey", name.alias("n"), lang.alias("l"))
    inside, target = classify_import(F.col("n"), F.col("l"))
    o = o.select("o_orderkey", "l", inside.alias("inside"), target.alias("target"))
    return o.select("o_orderkey", "inside", "target", F.when(F.col("inside"), import_fragment(F.col("target"), F.col("l"))).alias("fragment"))


# --- products as documents --------------------------------------------------------------------------


@query("""SELECT md5('x:p' || p_partkey) AS doc_id, p_name || ' — ' || coalesce(up, 0) || '↑' AS title, 'x,' || replace(lower(p_brand), ' ', '-') || ',2024-0' || (p_size % 9 + 1) AS tags, coalesce(up, 0) AS popularity, CASE WHEN p_size % 2 = 0 THEN 'featured' WHEN p_size % 3 > 0 THEN 'launched' ELSE 'created' END AS product_status,
p_name || '. ' || p_type || '. Topics: ' || p_brand || coalesce('. Upvotes: ' || up, '') || coalesce('. Makers: ' || names, '') || '. Launched: 2024-0' || (p_size % 9 + 1) || '-05' AS text
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS up, string_agg(DISTINCT 'User ' || l_suppkey, ', ' ORDER BY 'User ' || l_suppkey) AS names FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def product_documents(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources.products import product_docs

    p = products(spark, d)
    ordered = F.array_sort("makers", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    p = p.withColumn("makers", ordered).join(load(spark, d, "part").select(F.concat(F.lit("p"), text("p_partkey")).alias("slug"), (F.col("p_size") % 3).cast("bigint").alias("daily_rank")), "slug")
    for c, t in (("description", "string"), ("comments", "bigint"), ("rating", "double"), ("website", "string"), ("url", "string")):
        p = p.withColumn(c, F.lit(None).cast(t))
    return product_docs(p, "x", "x", "https://x/").select("doc_id", "title", "tags", "popularity", "product_status", "text")


@query("SELECT 'p' || p_partkey AS slug, CASE WHEN p_partkey % 2 = 0 THEN 'newer' ELSE 'older' END AS dump FROM part")
def product_dumps(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources.products import merge_dumps

    p = load(spark, d, "part").select(F.concat(F.lit("p"), text("p_partkey")).alias("slug"), "p_partkey")
    newer = p.where("p_partkey % 2 = 0").select("slug", F.lit("newer").alias("dump"))
    return merge_dumps([newer, p.select("slug", F.lit("older").alias("dump"))])


@query("""SELECT 'p' || p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'known' ELSE 'found' END AS tagline, greatest(p_size, CASE WHEN p_partkey % 2 = 0 THEN 25 END)::BIGINT AS upvotes, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 2 <> 0 THEN 'kept' ELSE 'new' END AS maker FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0
UNION ALL SELECT 'p' || p_partkey, NULL, p_size, 'kept' FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 <> 0""")
def product_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Products of which some are redacted or lack a tagline, with what a closer look at the even ones found."""
    from lattice.sources.products import enrich

    k = F.col("p_partkey")
    slug = F.concat(F.lit("p"), text(k)).alias("slug")
    maker = lambda u: F.array(F.struct(u.alias("username"), u.alias("name")))
    p = load(spark, d, "part")
    items = p.select(slug, F.when(k % 3 == 0, "known").alias("tagline"), F.col("p_size").cast("bigint").alias("upvotes"), maker(F.when((k % 4 == 0) | (k % 2 != 0), "kept").otherwise("[REDACTED]")).alias("makers"))
    found = p.where("p_partkey % 2 = 0").select(slug, F.lit("found").alias("tagline"), F.lit(25).cast("bigint").alias("upvotes"), maker(F.lit("new")).alias("makers"))
    return enrich(items, found).select("slug", "tagline", "upvotes", F.col("makers")[0]["username"].alias("maker"))


@query("SELECT count(*) FILTER (p_partkey % 7 = 0 OR p_partkey % 5 = 0) AS rejected FROM part")
def product_rejected(spark: SparkSession, d: str) -> DataFrame:
    from lattice.sources.products import rejected

    k = F.col("p_partkey")
    return rejected(load(spark, d, "part").select(F.when(k % 7 != 0, text(k)).alias("slug"), F.when(k % 5 == 0, "").otherwise("n").alias("name")))


@query("""SELECT 'p' || p_partkey AS slug, p_name AS name, p_type AS tagline, CASE WHEN p_partkey % 2 = 0 THEN 'about ' || p_name ELSE 'shared' END AS description, p_size::BIGINT AS upvotes, CASE WHEN p_partkey % 2 = 0 THEN '2024-03-0' || (p_size % 9 + 1) ELSE '' END AS launch_date,
CASE WHEN p_partkey % 2 = 0 THEN 'b' || p_size || '|c' ELSE '' END AS makers, 'created' AS product_status FROM part WHERE p_partkey % 5 <> 0""")
def product_page_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as stored pages: even ones with linked data, odd ones with titles alone, every fifth still being checked."""
    from lattice.sources.pages import product_pages

    p, k = load(spark, d, "part"), F.col("p_partkey")
    who = lambda u: F.struct(F.lit("").alias("name"), F.concat(F.lit("https://x/@"), u).alias("url"))
    ld = F.to_json(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("about "), "p_name").alias("description"), F.concat(F.lit("2024-03-0"), text(F.col("p_size") % 9 + 1), F.lit("T00")).alias("datePublished"), F.array(who(F.concat(F.lit("b"), text("p_size"))), who(F.lit("c"))).alias("author"), F.array(F.struct(F.lit("UserLikes").alias("interactionType"), text("p_size").alias("userInteractionCount"))).alias("interactionStatistic")))
    linked = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))
    plain = F.concat(F.lit('<meta property="og:title" content="'), "p_name", F.lit(' | X"><meta property="og:description" content="shared"><script>{"votesCount": '), text("p_size"), F.lit("}</script>"))
    body = F.when(k % 5 == 0, "<title>Just a moment...</title>").when(k % 2 == 0, linked).otherwise(plain)
    pages = p.select(F.concat(F.lit("p"), text(k)).alias("slug"), F.concat(body, F.lit('<meta name="description" content="'), "p_type", F.lit('">')).alias("html"))
    out = product_pages(pages, "X")
    return out.select("slug", "name", "tagline", "description", "upvotes", "launch_date", bars(F.transform("makers", lambda m: m["username"])).alias("makers"), "product_status")


@query("""WITH l AS (SELECT l_partkey, l_suppkey, bool_or(l_suppkey % 2 = 0) OVER (PARTITION BY l_partkey) AS listed FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
r AS (SELECT l_partkey, 'u' || l_suppkey || ':' || CASE WHEN l_suppkey % 2 = 0 THEN 'maker' WHEN l_suppkey % 3 = 0 THEN 'hunter' WHEN listed THEN 'commenter' ELSE 'maker' END AS x FROM l)
SELECT 'p' || l_partkey AS slug, string_agg(x, '|' ORDER BY x) AS makers FROM r GROUP BY 1""")
def product_confirmed_makers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a part as its people, the even ones listed as its makers; odd ones are hunters or said to be makers."""
    from lattice.sources.pages import confirmed_makers

    k = F.col("l_suppkey")
    who = lambda role: F.struct(F.concat(F.lit("u"), text(k)).alias("username"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("url"), role.alias("role"))
    people = F.array_sort(F.collect_set(F.when(k % 4 != 0, who(F.when(k % 3 == 0, "hunter").otherwise("maker")))))
    listed = F.array_sort(F.collect_set(F.when(k % 2 == 0, who(F.lit("maker")))))
    by = load(spark, d, "lineitem").groupBy("l_partkey").agg(people.alias("makers"), listed.alias("listed"))
    out = by.select(F.concat(F.lit("p"), text("l_partkey")).alias("slug"), confirmed_makers(F.col("makers"), F.col("listed")).alias("m"))
    # people without a list keep their roles
    return out.select("slug", bars(F.array_sort(F.transform("m", lambda x: F.concat_ws(":", x["username"], x["role"])))).alias("makers"))


# --- upserts of the store ---------------------------------------------------------------------------


@query("SELECT count(*) FILTER (c_custkey % 10 = 0) AS created, count(*) FILTER (c_custkey % 2 = 0) AS matched FROM customer")
def upsert_count(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import upsert_counts

    c = load(spark, d, "customer").select("c_custkey")
    return upsert_counts(c, c.where("c_custkey % 2 = 0").unionAll(c.where("c_custkey % 10 = 0").select(-F.col("c_custkey") - 1)), ["c_custkey"])


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 1 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)) AS relationships_created, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS merged, (SELECT count(*) FROM lineitem) AS appended")
def edge_upserts(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import append_edges, created_edges, merge_edges

    e = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    old, new = e.where("l_linenumber = 1").drop("l_linenumber").distinct(), e.where("l_linenumber > 1").drop("l_linenumber")
    merged = merge_edges(old, new).agg(F.count("*").alias("merged"))
    appended = append_edges(e.where("l_linenumber = 1"), e.where("l_linenumber > 1")).agg(F.count("*").alias("appended"))
    return created_edges(old, new).crossJoin(merged).crossJoin(appended)  # one row each


@query("SELECT o_custkey::BIGINT AS c_custkey, c_name AS name FROM (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey % 2 <> 0)")
def nodes_of_endpoints(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import with_missing_nodes

    known = load(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("name"))
    return with_missing_nodes(known, load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1")
def last_of_each_key(spark: SparkSession, d: str) -> DataFrame:
    from lattice.operators.dml import last_per_key

    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return last_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


QUERIES = {k: q for k, q in workload.QUERIES.items() if q.run.__module__ == __name__}
