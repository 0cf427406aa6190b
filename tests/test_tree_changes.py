import json
import os
import random

from lattice.streaming.tree import TreeReader, difference, tree_changes


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def run(spark, tmp_path, roots, **options):
    """One run of a query that appends to a table, from its checkpoint to what is there now."""
    q = tree_changes(spark, {k: str(v) for k, v in roots.items()}, str(tmp_path / "state"), **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_difference_of_sorted_listings():
    rng = random.Random(2)
    for _ in range(200):
        make = lambda: {("r", rng.choice("abcdefgh")): (rng.randrange(3), 1) for _ in range(rng.randrange(7))}
        a, b = make(), make()
        flat = lambda d: iter(sorted((*k, *v) for k, v in d.items()))
        want = sorted([(*k, "deleted") for k in a.keys() - b.keys()] + [(*k, "created") for k in b.keys() - a.keys()] + [(*k, "modified") for k in a.keys() & b.keys() if a[k] != b[k]])
        assert [r[:3] for r in difference(flat(a), flat(b), 9)] == want


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for k in range(40):
        write(one / f"d{k % 3}" / f"{k}.md", "x")
    write(two / "é ü.md", "x")
    write(one / "code.py", "x")
    write(one / ".git" / "a.md", "x")
    roots, total = {"one": one, "two": two, "missing": tmp_path / "missing"}, []
    for step in range(4):
        if step == 1:
            write(one / "d0" / "0.md", "longer")
            os.remove(one / "d1" / "1.md")
            write(two / "new.MD", "x")
        if step == 2:  # nothing happened
            pass
        if step == 3:  # a file that came back as it was before is created again
            write(one / "d1" / "1.md", "x")
            os.remove(two / "new.MD")
        run(spark, tmp_path, roots)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        now = sorted((r["root"], r["path"], r["event_type"]) for r in rows)
        new = list(now)
        for r in total:
            new.remove(r)
        total = now
        if step == 0:
            assert len(new) == 41 and {r[2] for r in new} == {"created"} and ("two", "é ü.md", "created") in new
        if step == 1:
            assert new == [("one", "d0/0.md", "modified"), ("one", "d1/1.md", "deleted"), ("two", "new.MD", "created")]
        if step == 2:
            assert new == []
        if step == 3:
            assert new == [("one", "d1/1.md", "created"), ("two", "new.MD", "deleted")]
    assert all(r["ts"] is not None and (r["size"] is None) == (r["event_type"] == "deleted") for r in rows)


def test_offsets_name_listings_and_old_ones_go(tmp_path):
    root = tmp_path / "r"
    reader = TreeReader({"roots": json.dumps({"r": str(root)}), "state": str(tmp_path / "state"), "endings": "", "ignored": ""})
    offsets = [reader.initialOffset()]
    for k in range(14):
        write(root / f"{k}.txt", "x")
        offsets.append(reader.latestOffset())
        assert reader.latestOffset() == offsets[-1]
    assert len({o["listing"] for o in offsets}) == 15 and reader.partitions(offsets[3], offsets[3]) == []
    rows = [r for p in reader.partitions(offsets[3], offsets[9]) for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["path"] for r in rows) == sorted(f"{k}.txt" for k in range(3, 9)) and {r["event_type"] for r in rows} == {"created"}
    # a batch that is read again gives the same rows, deletions with the same time
    back = [r for p in reader.partitions(offsets[9], offsets[3]) for b in reader.read(p) for r in b.to_pylist()]
    assert back == [r for p in reader.partitions(offsets[9], offsets[3]) for b in reader.read(p) for r in b.to_pylist()] and {r["event_type"] for r in back} == {"deleted"}
    reader.commit(offsets[-1])
    assert len(os.listdir(tmp_path / "state")) == 9
