import random

import pytest
from pyspark.sql import functions as F

from lattice.operators.segments import Conflict, Segments


def table(spark, path, fanout=4):
    return Segments(spark, str(path), "id", {"rows": ["b"], "names": []}, fanout)


def frames(spark, rows):
    df = spark.createDataFrame(rows, "id BIGINT, v STRING").withColumn("b", (F.col("id") % 3).cast("int"))
    return {"rows": df.select("id", "v", "b"), "names": df.select("id")}


def live(t):
    rows = t.read("rows")
    return {} if rows is None else {r["id"]: r["v"] for r in rows.collect()}


@pytest.mark.parametrize("fanout", [2, 3])
def test_changes_equal_a_dictionary(spark, tmp_path, fanout):
    rng, t, want = random.Random(fanout), table(spark, tmp_path / "t", fanout), {}
    assert t.read("rows") is None and live(t) == {}
    for step in range(7):
        if step % 3 == 2:
            keys = rng.sample(range(12), 4)
            t.delete(spark.createDataFrame([(k,) for k in keys], "id BIGINT"))
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            new = {k: f"{step}.{k}" for k in rng.sample(range(12), 5)}
            f = frames(spark, list(new.items()))
            t.write(f, f["names"])
            want |= new
        assert live(t) == want
        t.compact()
        assert live(t) == want and {r["id"] for r in t.read("names").collect()} == set(want)
    s = t.snapshot()
    assert len(s.segments) < 7 and t.vacuum(keep=1) > 0
    assert live(t) == want and t.log.versions() == [s.version]


def test_rows_written_grow_with_the_change(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    f = frames(spark, [(k, "a") for k in range(1000)])
    t.write(f)
    before = t.rows("rows")
    f = frames(spark, [(5, "b")])
    t.write(f, f["names"])
    assert t.rows("rows") - before == 1 and live(t)[5] == "b" and len(live(t)) == 1000


def test_two_writers_at_one_version(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    base = t.snapshot()
    t.write(frames(spark, [(1, "a")]), base=base)
    with pytest.raises(Conflict):
        t.write(frames(spark, [(2, "b")]), base=base)
    assert live(t) == {1: "a"}
    # without a base a change is put after the other's
    real, raced = t.snapshot, []

    def raced_snapshot():
        s = real()
        if not raced:
            raced.append(1)
            t.write(frames(spark, [(3, "c")]))
        return s

    t.snapshot = raced_snapshot
    t.write(frames(spark, [(4, "d")]))
    assert live(t) == {1: "a", 3: "c", 4: "d"}


def test_a_repeated_change_is_one(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for _ in range(3):
        t.write(frames(spark, [(1, "a")]), token="batch-1")
    assert t.read("rows").count() == 1 and t.snapshot().version == 1


def test_empty_changes_and_readers_of_an_old_version(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.write(frames(spark, []))
    assert t.read("rows").count() == 0
    t.write(frames(spark, [(1, "a"), (2, "b")]))
    old = t.read("rows")
    t.delete(spark.createDataFrame([(1,)], "id BIGINT"))
    t.compact()
    assert {r["id"] for r in old.collect()} == {1, 2} and set(live(t)) == {2}


def test_filters_reach_the_partitions(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.write(frames(spark, [(k, "a") for k in range(9)]))
    t.delete(spark.createDataFrame([(4,)], "id BIGINT"))
    some = t.read("rows", lambda df: df.where("b = 1"))
    assert {r["id"] for r in some.collect()} == {1, 7} and "PartitionFilters: [isnotnull(b" in some._jdf.queryExecution().toString()


def test_a_writer_that_died_while_it_committed_blocks_no_one(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.write(frames(spark, [(1, "a")]))
    broken = tmp_path / "t" / "_log" / f"{2:012d}.json"
    broken.write_text('{"sequence"')
    # as long as it may still be at work its number is its own, and the last complete version is what there is
    base = t.snapshot()
    assert base.version == 1
    with pytest.raises(Conflict):
        t.write(frames(spark, [(2, "b")]), base=base)
    monkeypatch.setattr("lattice.operators.segments.DEAD", -1)
    t.write(frames(spark, [(2, "b")]))
    assert t.snapshot().version == 3 and live(t) == {1: "a", 2: "b"} and t.vacuum(keep=2) >= 0 and live(t) == {1: "a", 2: "b"}
