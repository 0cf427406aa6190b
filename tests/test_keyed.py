import os
import time

from pyspark.sql import functions as F

from lattice.operators.chunking import chunk
from lattice.streaming.keyed import ChunkIndex, follow, keyed_changes, with_text
from lattice.streaming.tree import tree_changes

EVENTS = "root STRING, path STRING, event_type STRING, ts TIMESTAMP, text STRING"


def put(spark, path, rows):
    spark.createDataFrame([("r", p, e, ms, t) for p, e, ms, t in rows], "root STRING, path STRING, event_type STRING, ms BIGINT, text STRING").select("root", "path", "event_type", F.timestamp_millis("ms").alias("ts"), "text").coalesce(1).write.mode("append").parquet(str(path))


def live(index):
    return {r["chunk_id"]: r["text"] for r in index.read().collect()}


def want(files, kinds=None):
    out = {}
    for path, text in files.items():
        kind = "markdown" if path.endswith(".md") else "code" if path.endswith(".py") else "text"
        out |= {f"r|{path}::chunk_{c[0]}": c[4] for c in chunk(text, kind, 20, 60)}
    return out


def md(*parts):
    return "\n".join(f"# {p}\n{'text of ' + p + ' ' + 'x' * 20}" for p in parts)


def test_changes_follow_the_files(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"))
    run = lambda: follow(keyed_changes(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), least=20, most=60), index, str(tmp_path / "cp"), once=True).awaitTermination(120)
    put(spark, tmp_path / "in", [("a.md", "created", 1000, md("one", "two", "three")), ("b.py", "created", 1000, "x = 1\n"), ("c.txt", "created", 1000, None)])
    run()
    files = {"a.md": md("one", "two", "three"), "b.py": "x = 1\n"}
    assert live(index) == want(files) and index.chunks.rows("chunks") == 4
    # one section edited: one chunk is written; an event without a change writes nothing
    files["a.md"] = md("one", "zwei", "three")
    put(spark, tmp_path / "in", [("a.md", "modified", 2000, "never seen"), ("a.md", "modified", 3000, files["a.md"]), ("b.py", "modified", 3000, "x = 1\n")])
    run()
    assert live(index) == want(files) and index.chunks.rows("chunks") == 5
    assert [r["chunk_id"] for r in index.search("zwei").collect()] == ["r|a.md::chunk_1"] and index.search("two").count() == 0
    # a file gone, one shorter, and one deleted and written again at the same time
    put(spark, tmp_path / "in", [("b.py", "deleted", 4000, None), ("a.md", "deleted", 4000, None), ("a.md", "created", 4000, md("one"))])
    run()
    assert live(index) == {"r|a.md::chunk_0": md("one")} and index.search("three").count() == 0
    assert index.postings.count(index.postings.segments.snapshot()) == 1


def test_a_batch_that_runs_again_is_one_change(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([("k", "f", "upsert", "k::chunk_0", 0, "", 1, 1, "some words", 1)], "key STRING, file STRING, change STRING, chunk_id STRING, chunk_index INT, heading STRING, start_line INT, end_line INT, text STRING, total_chunks INT")
    for _ in range(2):
        index.apply(rows, "q:1")
    assert index.chunks.rows("chunks") == 1 and index.chunks.snapshot().version == 1
    index.apply(rows.limit(0), "q:2")
    assert index.chunks.snapshot().version == 1 and ChunkIndex(spark, str(tmp_path / "none")).read().count() == 0


def test_bursts_and_late_deletions_wait_for_the_timer(spark, tmp_path):
    out = []
    stream = lambda: keyed_changes(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), gap=1500, watermark="0 seconds", least=20, most=60)
    run = lambda: stream().writeStream.foreachBatch(lambda df, k: out.extend((r["file"], r["change"], r["text"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    put(spark, tmp_path / "in", [("a.txt", "created", 1000, "first")])
    run()
    put(spark, tmp_path / "in", [("a.txt", "modified", 2000, "second"), ("b.txt", "created", 2000, "b")])
    run()
    assert out == []
    put(spark, tmp_path / "in", [("z.txt", "created", 10_000, "z")])
    run()
    assert sorted(out) == [("a.txt", "upsert", "second"), ("b.txt", "upsert", "b")]
    # a deletion with a new file after it within the gap is a change; one alone is a deletion
    put(spark, tmp_path / "in", [("a.txt", "deleted", 11_000, None), ("b.txt", "deleted", 11_000, None)])
    run()
    put(spark, tmp_path / "in", [("a.txt", "created", 12_000, "third")])
    run()
    put(spark, tmp_path / "in", [("y.txt", "created", 30_000, "y")])
    run()
    assert sorted(out[2:], key=str) == [("a.txt", "upsert", "third"), ("b.txt", "delete", None), ("z.txt", "upsert", "z")]


def test_trees_are_followed(spark, tmp_path):
    root, index = tmp_path / "notes", ChunkIndex(spark, str(tmp_path / "index"))
    root.mkdir()
    (root / "a.md").write_text("# Alpha\nabout cats")
    (root / "b.md").write_text("# Beta\nabout dogs")

    def run():
        changes = tree_changes(spark, {"notes": str(root)}, str(tmp_path / "state"))
        follow(keyed_changes(with_text(changes, {"notes": str(root)})), index, str(tmp_path / "cp"), once=True).awaitTermination(120)

    run()
    assert [r["file"] for r in index.search("cats").collect()] == ["a.md"]
    time.sleep(0.01)
    (root / "a.md").write_text("# Alpha\nabout birds")
    os.remove(root / "b.md")
    run()
    assert index.search("cats").count() == 0 == index.search("dogs").count() and [r["heading"] for r in index.search("birds").collect()] == ["Alpha"]


def test_processing_time_debounce_fires_without_another_event(spark, tmp_path):
    root, index = tmp_path / "notes", ChunkIndex(spark, str(tmp_path / "index"))
    root.mkdir()
    (root / "a.md").write_text("# Alpha\nabout cats")
    changes = tree_changes(spark, {"notes": str(root)}, str(tmp_path / "state"))
    q = follow(keyed_changes(with_text(changes, {"notes": str(root)}), gap=500), index, str(tmp_path / "cp"), every="500 milliseconds")
    try:
        deadline = time.time() + 60
        while not index.postings.segments.snapshot().version and time.time() < deadline:
            time.sleep(0.3)
        assert q.exception() is None and [r["file"] for r in index.search("cats").collect()] == ["a.md"]
    finally:
        q.stop()
