"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from lattice.plans import registered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    if q.sql is None:
        assert rows
        return
    assert rows == sorted(tuple(map(repr, r)) for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({q.sql})").fetchall())


def test_plans_push_filters_and_prune_columns(spark):
    plan = lambda n: QUERIES[n].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    p = plan("lines_in_order")
    assert "EqualTo(l_orderkey,42)" in p and "l_tax" not in p
    p = plan("shared_parts_across_suppliers")
    assert "Join" not in p and "l_extendedprice" not in p
    assert "BroadcastNestedLoopJoin" not in plan("contains_theta_join") and "CartesianProduct" not in plan("contains_theta_join")
    assert "embedding" not in plan("graph_stats_nodes")


def test_residual_callers_and_merge_cover_every_row(spark, duck):
    want = duck.sql("SELECT a.l_orderkey, count(*) FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1").fetchall()
    got = QUERIES["callers_residual_all"].run(spark, SF).select("order_key", "callers").collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(k for k, _ in want) > 50
    ids = {r[0] for r in duck.sql("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels").fetchall()}
    assert {r["doc_id"] for r in QUERIES["merge_with_precedence_all"].run(spark, SF).collect()} == ids


def test_bounded_paths_go_three_hops(spark, tmp_path):
    rows = [(o, p) for o in range(1, 6) for p in (o, o + 1)] + [(9, 1), (9, 7)]  # a chain of parts 1 to 6, and 7 beside 1
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    hops, frontier = {}, {1}
    for k in (1, 2, 3):
        frontier = {q for o, p in rows for w, q in rows if o == w and p in frontier and p != q} - set(hops)
        hops |= dict.fromkeys(frontier, k)
    assert {r["id"]: r["hops"] for r in QUERIES["bounded_paths_1_3"].run(spark, str(tmp_path)).collect()} == hops and hops[4] == 3 and 5 not in hops


def test_entry_points(spark):
    import __spark_entry__ as E

    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and set(QUERIES) <= set(q)
    assert E.entry(spark).count() > 0
