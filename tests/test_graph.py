import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattice import cypher
from lattice.cypher import CypherError, positional, run
from lattice.operators import dml as D
from lattice.operators import library as L
from lattice.operators import reports as R
from lattice.operators.graph import Graph, degree, reach, shared_endpoint_pairs, shared_endpoints

from .conftest import got
from .graphs import mini


@pytest.fixture(scope="module")
def g(spark):
    return mini(spark)


def test_library(g):
    assert [r[0] for r in got(L.files_by_project(g, "alpha"))] == ["src/app.ts", "src/lib/util.ts"]
    assert [r[0] for r in got(L.deps_by_project(g, "alpha"))] == ["react", "zod"]
    assert [(r[0], list(r[1])) for r in got(L.shared_packages(g))] == [("react", ["alpha", "beta"])]
    assert got(L.hotfiles(g, "alpha")) == [("src/app.ts", 2, 15), ("src/lib/util.ts", 1, 3)]
    assert [(r[0], r[2]) for r in got(L.hub_files(g))] == [("api/models.py", 3), ("src/app.ts", 2), ("api/main.py", 1), ("src/lib/util.ts", 1)]
    assert [(r[0], r[2]) for r in got(L.symbols_in_file(g, "src/app.ts"))] == [("App", 10), ("render", 30)]
    assert [r[0] for r in got(L.sessions_by_project(g, "alpha"))] == ["s2", "s1"]
    assert [(r[2], r[0], r[3]) for r in got(L.files_in_session(g, "s1"))] == [("EDITED", "src/app.ts", 4), ("TOUCHED", "src/lib/util.ts", 1)]
    assert [(r[0], r[4], r[5]) for r in got(L.sessions_for_file(g, "util"))] == [("s2", "CREATED", 1), ("s1", "TOUCHED", 1)]
    assert got(L.hotfiles_by_sessions(g, "alpha")) == [("src/app.ts", 2, 6)]
    assert got(L.import_graph(g, "alpha")) == [("src/app.ts", "Package", "react"), ("src/app.ts", "File", "src/lib/util.ts")]
    assert got(L.callers_of(g, "fmt")) == [("src/app.ts", "alpha", "src/lib/util.ts")]
    assert [(r[0], r[1]) for r in got(L.class_hierarchy(g, "Base"))] == [("child", "UserCreate"), ("child", "UserRead")]
    assert got(L.external_imports_by_project(g, "alpha")) == [("react", 1)]
    stats = {(r[0], r[1]): r[2] for r in got(L.session_stats(g))}
    assert stats == {("total", "sessions"): 3, ("project", "alpha"): 2, ("project", "beta"): 1, ("edge", "EDITED"): 2, ("edge", "TOUCHED"): 2, ("edge", "CREATED"): 1, ("edge", "IN_PROJECT"): 3}


def test_stats_and_degree(g):
    s = {r[1]: r[2] for r in got(g.stats())}
    assert (s["Project"], s["File"], s["Symbol"], s["IMPORTS"], s["MODIFIED"]) == (2, 4, 7, 4, 3)
    d = {r[1].split("|")[1]: r[2] for r in got(degree(g.edge(), "File"))}
    assert d == {"src/app.ts": 10, "src/lib/util.ts": 6, "api/main.py": 6, "api/models.py": 5}


def test_shared_rewrite_equals_self_join(g):
    e = g.edge(["DEPENDS_ON"])
    pairs = {(r[2], r[0]) for r in got(shared_endpoint_pairs(e))}
    assert pairs == {(r[0], m) for r in got(shared_endpoints(e)) for m in r[1]}


def test_reach_counts_least_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert sorted(got(reach(e, spark.createDataFrame([("a",)], "x string"), 3))) == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]


def test_reports(g):
    assert [tuple(r) for r in got(R.layers(g, "alpha"))] == [("src/", 1, 2), ("src/lib/", 1, 1)]
    assert [tuple(r) for r in got(R.layers(g, "beta"))] == [("api/", 2, 4)]
    assert [r[1] for r in got(R.patterns(g, "beta"))] == ["Base class: Base -> 2 children"]
    o = R.overview(g, "alpha")
    assert o["counts"] == {"files": 2, "symbols": 3, "packages": 2} and o["hub_files"] == [("src/app.ts", 10), ("src/lib/util.ts", 6)] and "patterns" not in o
    assert R.overview(g, "nothing") is None
    assert "react" in R.diagram(g, "deps", "alpha") and "UserRead --|> Base" in R.diagram(g, "inheritance", "beta")
    assert R.diagram(g, "imports", "alpha").count("-->") == 1 and R.diagram(g, "calls", "alpha").count("-->") == 1
    m = R.repomap(g, "alpha").collect()
    assert [r["path"] for r in m] == ["src/app.ts", "src/lib/util.ts"] and [s["name"] for s in m[0]["symbols"]] == ["App", "render"]
    assert "render" in R.repomap_yaml(R.repomap(g, "alpha"))
    assert [r[0] for r in got(R.portfolio(g))] == ["alpha", "beta"]
    assert [r["name"] for r in R.resolve_project(g.node("Project"), "ALPHA").collect()] == ["alpha"]
    assert "path" in R.render(R.layers(g, "beta").withColumnRenamed("layer", "path"), "layers")


def test_cypher_on_mini_graph(g):
    q = lambda text, **p: got(run(g, text, p))
    assert q("MATCH (p:Project {name: 'alpha'})-[:HAS_FILE]->(f:File) RETURN f.path AS path ORDER BY f.lang, f.path") == [("src/app.ts",), ("src/lib/util.ts",)]
    shared = q("MATCH (p1:Project)-[:DEPENDS_ON]->(pkg:Package)<-[:DEPENDS_ON]-(p2:Project) WHERE p1.name <> p2.name RETURN pkg.name, COLLECT(DISTINCT p1.name) AS projects ORDER BY SIZE(projects) DESC")
    assert [(a, list(b)) for a, b in shared] == [("react", ["alpha", "beta"])]
    assert q("MATCH (f:File {project: $p})<-[m:MODIFIED]-(f) RETURN f.path, COUNT(m) AS changes, SUM(m.lines_added) AS added ORDER BY changes DESC LIMIT 10", p="alpha") == [("src/app.ts", 2, 15), ("src/lib/util.ts", 1, 3)]
    assert q("MATCH (s:Session)-[r]->(f:File) WHERE f.path CONTAINS 'util' AND TYPE(r) IN ['TOUCHED', 'EDITED', 'CREATED'] RETURN s.session_id, TYPE(r) AS action, r.count ORDER BY s.started_at DESC LIMIT 20") == [("s2", "CREATED", 1), ("s1", "TOUCHED", 1)]
    assert q("MATCH (src:File {project: 'alpha'})-[:IMPORTS]->(tgt) RETURN labels(tgt)[0] AS kind, CASE WHEN tgt.path IS NOT NULL THEN tgt.path ELSE tgt.name END AS target ORDER BY target") == [("Package", "react"), ("File", "src/lib/util.ts")]
    assert q("MATCH (f:File {project: 'alpha'})-[r]-() RETURN f.path, COUNT(r) AS connections ORDER BY connections DESC LIMIT 8") == [("src/app.ts", 10), ("src/lib/util.ts", 6)]
    assert q("MATCH (s:Session) RETURN COUNT(s)") == [(3,)]
    assert q("MATCH (c:Symbol {name: 'Base'}) OPTIONAL MATCH (c)-[:INHERITS]->(p:Symbol) RETURN c.name AS c, COUNT(p) AS parents") == [("Base", 0)]
    assert sorted(q("MATCH (f:File)<-[:IMPORTS*1..3]-(i:File) RETURN DISTINCT f.path AS to, i.path AS by")) == [("api/models.py", "api/main.py"), ("src/lib/util.ts", "src/app.ts")]
    assert q("UNWIND $ids AS id MATCH (s:Session {session_id: id}) RETURN s.project_name AS p ORDER BY p", ids=["s1", "s3"]) == [("alpha",), ("beta",)]
    assert q("MATCH (s:Session), (p:Project) WHERE s.project_name = p.name RETURN COUNT(*) AS n") == [(3,)]
    assert q("MATCH (p:Project) WITH p ORDER BY p.name DESC LIMIT 1 MATCH (p)-[:DEPENDS_ON]->(k) RETURN k.name ORDER BY k.name") == [("fastapi",), ("react",)]
    assert positional(run(g, "MATCH (p:Project) RETURN p.name ORDER BY p.name")) == [{"value": "alpha"}, {"value": "beta"}]
    assert got(run(g, "CREATE INDEX FOR (n:File) ON (n.path)")) == []
    assert q("CALL db.idx.fulltext.queryNodes('Package', 'react') YIELD node, score RETURN node.name AS n") == [("react",)]


@pytest.mark.parametrize("text", ["MATCH (n:File) DELETE n", "MERGE (n:File {path: 'x'})", "MATCH (n) RETURN m", "MATCH (n:Nope) RETURN n", "MATCH (n:File)-[:NOPE]->() RETURN n", "MATCH (a)-[:IMPORTS*]->(b) RETURN a", "MATCH (n:File", "RETURN $x", "MATCH (n:File)"])
def test_cypher_refuses(g, text):
    with pytest.raises(CypherError):
        run(g, text)


def test_cypher_against_brute_force(spark):
    """Random small graphs: chains with a theta predicate, both directions, edges used once."""
    import random

    from lattice.operators.graph import Graph

    rnd = random.Random(5)
    for _ in range(2):
        n = 6
        nodes = [(str(i), f"n{i % 4}", i) for i in range(n)]
        edges = sorted({(str(rnd.randrange(n)), str(rnd.randrange(n))) for _ in range(9)})
        g = Graph(spark, {"N": spark.createDataFrame(nodes, "id string, name string, k bigint")}, {("N", "E", "N"): spark.createDataFrame(edges, "src string, dst string")})
        rows = sorted(got(run(g, "MATCH (a:N)-[:E]->(b:N)<-[:E]-(c:N) WHERE a.name <> c.name RETURN a.id AS a, b.id AS b, c.id AS c")))
        name = {i: x for i, x, _ in nodes}
        assert rows == sorted((a, b, c) for a, b in edges for c, b2 in edges if b == b2 and (a, b) != (c, b2) and name[a] != name[c])
        rows = sorted(got(run(g, "MATCH (a:N)-[:E]-(b:N) RETURN a.id AS a, b.id AS b")))
        assert rows == sorted([(a, b) for a, b in edges] + [(b, a) for a, b in edges if a != b])
        rows = sorted(got(run(g, "MATCH (a:N)-[:E*1..2]->(b:N) RETURN a.id AS a, b.id AS b")))
        two = [(a, d) for a, b in edges for c, d in edges if b == c and (a, b) != (c, d)]
        assert rows == sorted([*edges, *two])


# --- edge numbers and path counts


def test_equal_parallel_edges_are_two(spark):
    g = mini(spark)
    t = ("File", "MODIFIED", "File")
    one = g.edges[t].limit(1)
    util = "MATCH (a:File)-[r:MODIFIED]->(b:File), (a)-[q:MODIFIED]->(b) RETURN COUNT(*) AS n"
    g.edges[t] = D.number_edges(one.unionByName(one))
    assert got(cypher.run(g, util)) == [(2,)]
    assert got(cypher.run(g, "MATCH (a:File)-[r:MODIFIED]->(b:File) RETURN COUNT(DISTINCT r) AS n, COUNT(r) AS m")) == [(2, 2)]
    assert len({r["eid"] for r in g.edges[t].collect()}) == 2 and D.number_edges(g.edges[t]) is g.edges[t]
    # a number does not depend on the run, and is no property
    assert sorted(got(g.edges[t].select("eid"))) == sorted(got(D.number_edges(one.unionByName(one)).select("eid")))
    assert "eid" not in cypher.run(g, "MATCH (a:File)-[r:MODIFIED]->(b:File) RETURN r").schema["r"].dataType.fieldNames()
    # without numbers equal rows are one edge
    g.edges[t] = one.unionByName(one)
    assert got(cypher.run(g, util)) == [(0,)]
    both = D.append_edges(D.number_edges(one), one.withColumn("lines_added", F.lit(99).cast("bigint")))
    assert both.where("eid IS NULL").count() == 0 and both.select("eid").distinct().count() == 2


def layered(spark, seed):
    """Random edges over layers A, B, C and D, some skipping one, some parallel."""
    rnd = random.Random(seed)
    names = {x: [f"{x}{k}" for k in range(4)] for x in "ABCD"}
    nodes = {x: spark.createDataFrame([(i, k) for k, i in enumerate(v)], "id STRING, w BIGINT") for x, v in names.items()}
    edges = {(a, f"E{a}{b}", b): [(rnd.choice(names[a]), rnd.choice(names[b])) for _ in range(rnd.randrange(1, 9))] for a, b in ("AB", "BC", "CD", "AC")}
    return Graph(spark, nodes, {t: D.number_edges(spark.createDataFrame(v, "src STRING, dst STRING")) for t, v in edges.items()}), edges


def brute_paths(edges, low, high):
    """(start, end) of every path from a node of A, listed edge by edge."""
    out, level = [], [(f"A{k}", f"A{k}") for k in range(4)]
    flat = [e for v in edges.values() for e in v]
    for k in range(high + 1):
        if k >= low:
            out += level
        level = [(s, b) for s, at in level for a, b in flat if a == at]
    return out


@pytest.mark.parametrize(("seed", "low", "high"), [(1, 1, 3), (2, 0, 3), (3, 2, 2), (4, 1, 1)])
def test_path_counts_equal_listed_paths(spark, seed, low, high):
    g, edges = layered(spark, seed)
    assert not g.repeats()
    want = brute_paths(edges, low, high)
    pattern = f"MATCH (a:A)-[:EAB|EBC|ECD|EAC*{low}..{high}]->(x)"
    rows = {(r["s"], r["e"]): (r["n"], r["w"]) for r in cypher.run(g, f"{pattern} RETURN a.id AS s, x.id AS e, COUNT(*) AS n, SUM(a.w) AS w").collect()}
    counts = Counter(want)
    assert rows == {k: (n, n * int(k[0][1])) for k, n in counts.items()}
    assert got(cypher.run(g, f"{pattern} RETURN COUNT(x) AS n, COUNT(DISTINCT x) AS d, MAX(x.id) AS m")) == [(len(want), len({e for _, e in want}), max(e for _, e in want))]
    # rows are still rows
    assert sorted(got(cypher.run(g, f"{pattern} RETURN a.id AS s, x.id AS e"))) == sorted(want)
    plan = cypher.run(g, f"{pattern} RETURN COUNT(*) AS n")._jdf.queryExecution().toString()
    assert "array_append" not in plan


def test_cycles_of_labels_list_their_paths(spark):
    ring = [("f0", "f1"), ("f1", "f2"), ("f2", "f0"), ("f0", "f0")]
    nodes = {"F": spark.createDataFrame([(f"f{k}",) for k in range(3)], "id STRING")}
    g = Graph(spark, nodes, {("F", "TO", "F"): spark.createDataFrame(ring, "src STRING, dst STRING")})
    assert g.repeats() and not Graph(spark, nodes, g.edges, acyclic=frozenset({"TO"})).repeats()

    def trails(high):
        out, level = 0, [((), f"f{k}") for k in range(3)]
        for _ in range(high):
            level = [((*used, e), e[1]) for used, at in level for e in ring if e[0] == at and e not in used]
            out += len(level)
        return out

    for high in (1, 2, 4):
        assert got(cypher.run(g, f"MATCH (a:F)-[:TO*1..{high}]->(b:F) RETURN COUNT(*) AS n")) == [(trails(high),)]
    # a declared lack of cycles is taken at its word
    line = Graph(spark, nodes, {("F", "TO", "F"): spark.createDataFrame([("f0", "f1"), ("f1", "f2"), ("f0", "f1")], "src STRING, dst STRING")}, acyclic=frozenset({"TO"}))
    assert got(cypher.run(line, "MATCH (a:F)-[:TO*1..3]->(b:F) RETURN COUNT(*) AS n")) == [(5,)]
