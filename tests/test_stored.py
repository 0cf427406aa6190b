"""Stored indexes: approximate vectors against all pairs, postings against the scores of whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import ann
from lattice.operators.postings import Postings
from lattice.operators.text import tfidf


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "id BIGINT, embedding ARRAY<FLOAT>")


def clustered(n, seed=1, d=16, centres=30):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d)) * 3
    return [(k, c[k % centres] + rng.standard_normal(d)) for k in range(n)]


def exact(rows, asked, k):
    keys = np.array([r[0] for r in rows])
    m = ann._unit(np.float32([r[1] for r in rows]).astype(float))
    out = {}
    for q, v in asked:
        s = np.round(m @ ann._unit(np.float32([v]).astype(float))[0], 12)
        out[q] = keys[np.lexsort((keys, -s))[:k]].tolist()
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(3000)
    return ann.VectorIndex(spark, str(tmp_path_factory.mktemp("ann") / "ix")).build(vectors(spark, rows[:2000])), rows


def test_changes_are_searched_without_fitting_again(spark, built):
    index, rows = built
    before = index.segments.snapshot().meta["centroids"]
    index.add(vectors(spark, rows[2000:]))
    index.add(vectors(spark, [(7, rows[500][1])]))  # a known key in place of its old vector
    index.delete(spark.createDataFrame([(k,) for k in range(100, 200)], "id BIGINT"))
    now = [(k, v if k != 7 else rows[500][1]) for k, v in rows if not 100 <= k < 200]
    asked = [r for r in now if r[0] % 50 == 0]
    for step in (lambda: None, index.compact):
        step()
        assert found(index.search(vectors(spark, asked), 10, probes=10**6)) == exact(now, asked, 10)
        near = index.search(vectors(spark, asked), 10)
        r = ann.recall(near, index.search(vectors(spark, asked), 10, probes=10**6)).first()
        assert r["queries"] == len(asked) and r["recall"] >= 0.9 and index.probes < 45 / 2
    assert index.segments.snapshot().meta["centroids"] == before


def test_blocks_of_a_hot_list(spark, built, monkeypatch):
    index, rows = built
    monkeypatch.setattr(ann, "VECTORS", 16)
    monkeypatch.setattr(ann, "QUERIES", 3)
    own = {r["id"]: r["vector"] for r in index.vectors().collect()}
    asked = [(k, own[k]) for k in list(own)[:40]]
    assert found(index.search(vectors(spark, asked), 5, probes=10**6)) == exact(sorted(own.items()), asked, 5)


def test_few_queries_read_their_lists_alone(spark, built):
    index, rows = built
    plan = index.search(vectors(spark, rows[:1]), 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    lists = [r["list"] for r in index.vectors([0, 1]).select("list").distinct().collect()]
    assert sorted(lists) == [0, 1]


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    odd = vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 0]), (3, [-1, 0])])
    odd = odd.unionByName(spark.createDataFrame([(4, None), (5, []), (6, [nan, 1.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [None, 1.0])], "id BIGINT, embedding ARRAY<FLOAT>")).withColumn("list", F.lit("clash"))
    index = ann.VectorIndex(spark, str(tmp_path / "ix")).build(odd)
    got = found(index.search(odd, 3))
    assert got == {0: [0, 2, 1], 1: [1, 0, 2], 2: [0, 2, 1], 3: [3, 1, 0]}
    with pytest.raises(ValueError):
        ann.VectorIndex(spark, str(tmp_path / "none")).build(odd.where("false"))
    with pytest.raises(ValueError):
        ann.VectorIndex(spark, str(tmp_path / "none")).search(odd, 3)


def documents(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, text STRING")


def test_postings_equal_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "the"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12))) or None
    p, live = Postings(spark, str(tmp_path / "p")), {}
    for step in range(5):
        if step == 3:
            gone = rng.sample(sorted(live), 8)
            p.delete(documents(spark, [(k, "") for k in gone] + [(999, "")]))
            live = {k: v for k, v in live.items() if k not in gone}
        else:
            new = {k: text() for k in rng.sample(range(40), 15)}
            p.add(documents(spark, list(new.items())), token=f"step {step}")
            p.add(documents(spark, [(77, "never")]), token=f"step {step}")  # a repeated change
            live |= new
        if step % 2:
            p.compact()
        assert p.count(p.segments.snapshot()) == len(live)
        docs = documents(spark, list(live.items()))
        for q in ("alpha the", "beta", "psilon (delta) gamma"):
            want = [(r["id"], round(r["score"], 9)) for r in tfidf(docs, q, 10).collect()]
            assert [(r["id"], round(r["score"], 9)) for r in p.search(q, 10).collect()] == want
    assert [r["id"] for r in p.search("the", 3, within=docs.where("id % 2 = 0")).collect()] == [r["id"] for r in tfidf(docs, "the", 3, where=F.col("id") % 2 == 0).collect()]
    assert p.search("", 3).count() == 0 == p.search("nowhere", 3).count() == Postings(spark, str(tmp_path / "none")).search("the", 3).count()


def test_postings_write_what_changes_and_read_their_buckets(spark, tmp_path):
    p = Postings(spark, str(tmp_path / "p"))
    p.add(documents(spark, [(k, f"common word{k}") for k in range(500)]))
    before = p.segments.rows("postings")
    p.add(documents(spark, [(3, "common other")]))
    assert p.segments.rows("postings") - before == 2
    plan = p.of(["common"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
