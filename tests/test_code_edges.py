"""Edges of source code: texts are parsed once, ids that are ambiguous still give each edge once."""

import ast
import inspect
import random

import pytest
from tests.conftest import got

from lattice.sources import code


def test_inner_nodes_are_those_of_walk_in_its_order():
    leaf = lambda n: type(n) in code._LEAVES
    for module in (ast, inspect, random, pytest):
        tree = ast.parse(inspect.getsource(module))
        assert [n for n in ast.walk(tree) if not leaf(n)] == code._inner(tree)
    assert not any(k in code._LEAVES for k in (ast.Call, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Attribute))


@pytest.mark.parametrize("bar", [False, True])
def test_edges_of_stored_records_are_the_same(spark, bar):
    sep = "|" if bar else "/"
    text = "class A(B):\n    pass\nclass B(A):\n    pass\ndef f():\n    g()\n    A()\ndef g():\n    f()\n"
    rows = [("p", f"a{sep}x.py", "python", text), ("p", "b.py", "python", text), ("p", "b.py", "python", text + "class A(C):\n    pass\n"), (f"p{sep}a", "x.py", "python", text), ("q", "e.py", "python", None), ("q", "s.py", "python", "def (")]
    records = code.parse(spark.createDataFrame(rows, "project string, path string, lang string, text string"))
    kept = code.stored(records, "symbol", "call", "inherit")
    for edges in (code.call_edges, code.inherit_edges):
        want = sorted(got(edges(records, code.symbols(records))))
        assert sorted(got(edges(kept, code.symbols(kept), again=True))) == want and len(want) > 3


def test_plans_of_edges_parse_once_and_exchange_no_inherited_edges(spark, tmp_path):
    from lattice.plans.code_queries import source_calls, source_inherits

    for q in (source_calls, source_inherits):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "MapInPandas" not in plan and not plan.split("\n")[1].strip("+- ").startswith("HashAggregate")
