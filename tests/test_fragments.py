"""Fragments searched in the tasks, against Python's own search and the keyed join."""

import random

import pyarrow as pa
from tests.conftest import got

from lattice.operators import fragments as FR
from lattice.operators import joins as J
from lattice.operators.profiles import product_links


def cases():
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab1é🙂") for _ in range(n))
    texts = [word(r.randrange(0, 60)) for _ in range(300)] + [None, "", "x" * 3000 + "needle" + "y" * 3000]
    return texts, sorted({word(r.randrange(1, 7)) for _ in range(80)} | {"needle", "x" * 200, "a" * 70, "zz"})


def test_listed_fragments_are_what_python_finds(spark, monkeypatch):
    texts, names = cases()
    monkeypatch.setattr(FR, "BLOCK", 500)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    held = {r["id"]: sorted(r["h"]) for r in FR.fragments_held(df, "t", pa.array(names), "h").collect()}
    assert held == {i: [n for n in names if n in (t or "")] for i, t in enumerate(texts)} and sum(map(len, held.values())) > 1000
    assert all(r["h"] == [] for r in FR.fragments_held(df, "t", pa.array([], pa.string()), "h").collect())


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(FR, "_BASE", 1)  # sums of bytes: every order of one text's bytes has one hash
    monkeypatch.setattr(FR, "_INVERSE", 1)
    data, off = FR._bytes(pa.array(["xabcy", "bca", "cab"]))
    row, fragment = FR.Fragments(pa.array(["abc", "bca", "acb"])).held(data, off)
    assert list(zip(row.tolist(), fragment.tolist())) == [(0, 0), (1, 1)]


def test_join_is_the_same_by_list_and_by_keys_and_keeps_repeated_rows(spark, monkeypatch):
    texts, names = cases()
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])], "id long, name string")
    for right in (spark.createDataFrame([(n,) for n in names] + [("a",), ("a",), (None,), ("",)], "f string"), spark.createDataFrame([(n, k) for k, n in enumerate(names)], "f string, id long")):
        listed = J.contains_join(left, "name", right, "f")
        monkeypatch.setattr(FR, "MOST", 3)
        keyed = J.contains_join(left, "name", right, "f")
        monkeypatch.undo()
        assert listed.columns == keyed.columns and sorted(map(repr, got(listed))) == sorted(map(repr, got(keyed)))


def test_listed_join_exchanges_and_broadcasts_no_texts(spark):
    left, right = spark.range(100).selectExpr("id", "concat('n', id) AS name"), spark.createDataFrame([("1",), ("n2",)], "f string")
    plan = J.contains_join(left, "name", right, "f")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_links_of_a_document_of_several_rows_are_found_once(spark):
    docs = spark.createDataFrame([("d1", "x", "ann"), ("d1", "x", "ann bo"), ("d1", "x", "b"), ("d1", "x", "ob"), ("d2", "x", "\x01an\x01n")], "doc_id STRING, source_type STRING, content STRING")
    makers = spark.createDataFrame([("ann",), ("bo",), ("bob",), ("n\x01a",), ("\x01",)], "username STRING")
    links = product_links(makers, docs, "x")
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the documents, none of the links
    assert sorted(got(links)) == [("\x01", "d2"), ("ann", "d1"), ("bo", "d1")]
