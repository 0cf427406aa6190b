import time

from pyspark.sql import functions as F

from lattice.operators.dml import Store
from lattice.streaming.debounce import debounce, relevant, watch
from lattice.streaming.incremental import first_seen, on_change, refresh

from .conftest import got

EVENTS = "ts TIMESTAMP, path STRING, event_type STRING"


def events(spark, rows):
    return spark.createDataFrame(rows, "ms BIGINT, path STRING, event_type STRING").select(F.timestamp_millis("ms").alias("ts"), "path", "event_type")


ROWS = [(0, "n.md", "created"), (1000, "n.md", "modified"), (2000, "n.md", "modified"), (5000, "n.md", "deleted"), (0, "x.txt", "created"), (0, ".git/n.md", "created")]


def test_debounce_fires_once_for_each_burst(spark):
    e = events(spark, ROWS).where(relevant(F.col("path")))
    out = debounce(e, ["path"], "ts", {"event_type": "event_type"}).orderBy("fired_at")
    assert [(r["path"], r["event_type"]) for r in out.collect()] == [("n.md", "modified"), ("n.md", "deleted")]


def test_stream_equals_batch(spark, tmp_path):
    import random

    rnd = random.Random(1)
    rows = [(t, f"{rnd.choice('abc')}.md", rnd.choice(["created", "modified"])) for t in sorted(rnd.sample(range(0, 60_000), 80))]
    for k in range(4):
        events(spark, rows[k * 20 : (k + 1) * 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = sorted(got(debounce(events(spark, rows), ["path"], "ts", {"event_type": "event_type"})))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = debounce(stream, ["path"], "ts", {"event_type": "event_type"}, watermark="10 minutes").writeStream.format("memory").queryName("fired").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(got(spark.table("fired"))) == batch


def test_watch_indexes_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    events(spark, [*ROWS[:3], (60_000, "z.md", "created")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    load = lambda changed: changed.select(F.md5("path").alias("doc_id"), F.col("path").alias("file"), F.sha2("event_type", 256).alias("content_hash"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = watch(stream, on_change(store, "notes", load, delete=True), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    deadline = time.time() + 5
    while not store.version("notes") and time.time() < deadline:
        time.sleep(0.2)
    assert [r["file"] for r in store.read("notes").collect()] == ["n.md"]  # z.md waits for the watermark


def test_refresh_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("1", "a"), ("2", "b")], "doc_id string, content_hash string")
    assert {r["status"]: r["n"] for r in refresh(store, "t", docs).collect()} == {"new": 2}
    assert {r["status"]: r["n"] for r in refresh(store, "t", docs).collect()} == {"unchanged": 2}
    assert {r["status"]: r["n"] for r in refresh(store, "t", docs, force=True).collect()} == {"updated": 2}
    on_change(store, "t", lambda x: x, delete=True)(spark.createDataFrame([], "path string, event_type string"), 0)
    assert store.read("t").count() == 2


def test_first_seen_drops_repeats(spark, tmp_path):
    events(spark, [(0, "a.md", "x"), (10, "a.md", "y"), (20, "b.md", "z")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = first_seen(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), ["path"], "ts", "1 hour")
    q = s.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["path"] for r in spark.table("seen").collect()) == ["a.md", "b.md"]
