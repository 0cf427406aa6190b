"""Connections of some nodes, without the edges that have no end among them."""

from tests.conftest import got

from lattice.operators.graph import Graph, degree, degree_of


def test_connections_of_some_nodes_are_those_of_all(spark):
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    edges = {
        ("File", "IMPORTS", "File"): e(("a", "b"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", None)), ("File", "CALLS", "Symbol"): e(("a", "a"), ("b", "s")),
        ("Session", "EDITED", "File"): e(("x", "a"), ("c", "c")), ("Symbol", "INHERITS", "Symbol"): e(("a", "b"), ("s", "s")),
    }
    g = Graph(spark, {}, edges)
    ids = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "id string")
    found = degree_of(g, "File", ids)
    assert "INHERITS" not in str(g.triples(dst="File")) and {r["id"]: r["connections"] for r in found.collect()} == {r["id"]: r["connections"] for r in degree(g.edge(), "File").collect() if r["id"] in ("a", "b")}
    assert degree_of(Graph(spark), "File", ids).count() == 0


def test_overview_joins_the_lines_of_all_orders_once(spark, monkeypatch):
    from lattice.operators import reports
    from lattice.plans import code_queries as Q

    graphs, overview = [], reports.overview
    monkeypatch.setattr(Q.R, "overview", lambda g, p: graphs.append(g) or overview(g, p))
    assert got(Q.code_overview(spark, "/root/testdata/sf0.001"))
    read = {t[1]: graphs[0].edges[t].inputFiles() for t in graphs[0].triples() if t[1] != "DEPENDS_ON"}
    assert read["DEFINES"] and not any("lineitem" in f for files in read.values() for f in files)
