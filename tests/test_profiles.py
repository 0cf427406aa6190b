"""Profiles in the store: upserts, links, search with a source, and removal of a source."""

from pyspark.sql import functions as F

from lattice.operators import text as X
from lattice.operators.profiles import MAKER, product_links, profile_search, stored_profiles
from lattice.tools import Engine

PROFILES = "username STRING, name STRING, headline STRING, about STRING, points BIGINT, streak BIGINT, followers BIGINT"


def test_stored_profiles_are_one_for_each_name(spark):
    rows = [("ann", "Ann", "builds things", "b" * 600, 5, 0, 2), ("ann", "Zed", "", "", 0, 0, 0), ("bob", None, None, None, None, None, None), ("", "x", "", "", 1, 1, 1), (None, "y", "", "", 1, 1, 1)]
    out = {r["username"]: r for r in stored_profiles(spark.createDataFrame(rows, PROFILES)).collect()}
    assert set(out) == {"ann", "bob"} and out["ann"]["name"] == "Ann" and len(out["ann"]["about"]) == 500 and len(out["ann"]["text"]) > 600
    assert out["bob"]["text"] == "bob" and out["bob"]["points"] == 0
    assert [f.split(" ")[0] for f in MAKER.split(", ")] == [c for c in stored_profiles(spark.createDataFrame([], PROFILES)).columns if c != "text"]


def test_links_hold_the_name_literally(spark):
    docs = spark.createDataFrame([("d1", "x-product", "by ann and bo"), ("d2", "x-product", "nobody"), ("d3", "other", "ann"), ("d4", "x-product", None)], "doc_id STRING, source_type STRING, content STRING")
    makers = spark.createDataFrame([("ann",), ("bo",), ("a.n",), ("",)], "username STRING")
    assert sorted(map(tuple, product_links(makers, docs, "x-product").collect())) == [("ann", "d1"), ("bo", "d1"), ("bo", "d2")]


def test_store_of_profiles(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    doc = "doc_id STRING, source_type STRING, source_name STRING, title STRING, content STRING, url STRING, created STRING, tags STRING, text STRING, popularity BIGINT"
    e.index_source(spark.createDataFrame([("d1", "shop-product", "shop", "Kite", "flies | ann", "u1", "", "", "a kite that flies", 9), ("d2", "blog-post", "blog", "Post", "text ann", "u2", "", "", "a post", 0)], doc))
    people = spark.createDataFrame([("ann", "Ann", "maker of kites", "", 7, 0, 3), ("bob", "Bob", "sails", "", 0, 2, 0)], PROFILES)
    assert e.index_makers(people, "shop") == {"created": 2, "matched": 0} and e.index_makers(people, "shop") == {"created": 0, "matched": 2}
    assert [r["doc_id"] for r in e.maker_products("ann")] == ["d1"] and e.maker_products("bob") == []
    hits = e.source_search("maker of kites", 5)
    assert hits[0]["id"] == "maker:ann" and hits[0]["content"] == "maker of kites | 7 pts | 3 followers" and hits[0]["title"] == "Ann (@ann)"
    assert {r["source_name"] for r in e.source_search("maker of kites", 5, "blog")} == {"blog"}
    assert {r["source"]: (r["SourceDoc"], r["Maker"], r["total"]) for r in e.source_list()} == {"shop": (1, 2, 3), "blog": (1, 0, 1)}
    assert e.delete_source("shop") and not e.delete_source("shop")
    assert e.store.read("makers").isEmpty() and e.store.read("maker_products").isEmpty() and e.store.read("documents").count() == 1


def test_source_is_applied_before_the_ranking_of_chunks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "v"))
    videos = spark.createDataFrame([(f"v{k}", "t", "u", "big" if k else "small", "", "") for k in range(12)], "video_id STRING, title STRING, url STRING, source_name STRING, description STRING, created STRING")
    chunks = spark.createDataFrame([(f"v{k}", i, "exactly what is asked" if k else "hardly asked", "", "", 0.0, "transcript") for k in range(12) for i in (0, 1)], "video_id STRING, chunk_index BIGINT, text STRING, chapter STRING, start_time STRING, start_seconds DOUBLE, chunk_type STRING")
    e.index_videos(videos, chunks, ("asked",))
    found = e.source_search("exactly what is asked", 3, "small")
    assert [r["source_name"] for r in found] == ["small", "small"] and found[0]["context"].count("hardly asked") == 2
    assert e.source_list()[0]["VideoChunk"] > 0
    assert e.delete_source("big") and {r["video_id"] for r in e.store.read("video_chunks").collect()} == {"v0"}
    assert all(r["video_id"] == "v0" for r in e.store.read("video_tags").collect())


def test_search_of_profiles_takes_a_filter(spark):
    m = X.embed(stored_profiles(spark.createDataFrame([("ann", "Ann", "kites", "", 1, 1, 1), ("bob", "Bob", "kites", "", 1, 1, 1)], PROFILES)), "text").withColumn("source_name", F.col("username"))
    out = profile_search(m, X.hash_embedding("kites"), 5, where=F.col("source_name") == "bob").collect()
    assert [(r["id"], r["source_type"]) for r in out] == [("maker:bob", "bob-maker")]
