import json
import os
from datetime import date

import pytest

from lattice.sources import paged

DDL = "slug STRING, day DATE, makers ARRAY<STRUCT<name: STRING, n: BIGINT>>, links MAP<STRING, STRING>"


def interface(log, pages=3, broken=None):
    """Spans of ``pages`` pages; each fetch leaves a line in a file; ``broken`` names a page that fails as long as its file is there."""

    def fetch(first, last, cursor):
        n = int(cursor or 0)
        if broken and os.path.exists(broken) and (first, n) == ("2026-01-04", 1):
            raise RuntimeError("the run is killed")
        with open(log, "a") as f:
            f.write(json.dumps([first, n]) + "\n")
        row = (f"{first}/{n}", date.fromisoformat(first), [("é", n), ("b", None)], {"site": last})
        return [row, (f"{first}/{n}+", None, None, None)], str(n + 1) if n + 1 < pages else None

    return fetch


def fetched(log):
    return sorted(tuple(json.loads(x)) for x in open(log))


def test_a_killed_run_goes_on_without_a_repeated_page(spark, tmp_path):
    log, broken, progress = str(tmp_path / "log"), tmp_path / "broken", str(tmp_path / "progress")
    broken.write_text("")
    kind = paged.paged_source("paged_resume", DDL, interface(log, broken=str(broken)))
    read = lambda: paged.read_paged(spark, kind, "2026-01-01", "2026-01-08", 3, progress=progress)
    with pytest.raises(Exception, match="the run is killed"):
        read().collect()
    before = fetched(log)
    assert ("2026-01-04", 0) in before and ("2026-01-04", 1) not in before
    broken.unlink()
    rows = sorted(read().collect(), key=lambda r: r["slug"])
    assert fetched(log) == sorted((d, n) for d in ("2026-01-01", "2026-01-04", "2026-01-07") for n in range(3))
    assert len(rows) == 18 and rows[0]["day"] == date(2026, 1, 1) and rows[0]["makers"][0]["name"] == "é" and rows[0]["links"] == {"site": "2026-01-03"} and rows[1]["day"] is None
    # and once more: all from what is stored, the same rows
    assert sorted(read().collect(), key=lambda r: r["slug"]) == rows and len(fetched(log)) == 9


def test_back_off_doubles_and_is_bounded(monkeypatch):
    waits = []
    monkeypatch.setattr(paged.time, "sleep", waits.append)
    tries = []

    def fetch(first, last, cursor):
        tries.append(cursor)
        if len(tries) == 1:
            raise paged.Busy(7)
        if len(tries) == 2:
            raise paged.Busy(10_000)
        if len(tries) < 5:
            raise ConnectionError
        return [("a",)], None

    reader = paged.PagedReader({"from": "2026-01-01", "to": "2026-01-01", "backoff": "0.5"}, fetch, None)
    assert list(reader.read(reader.partitions()[0])) == [("a",)] and waits == [7, paged.MOST_WAIT, 2.0, 4.0]
    tries.clear()
    reader = paged.PagedReader({"from": "2026-01-01", "to": "2026-01-01", "tries": "2"}, lambda *a: (_ for _ in ()).throw(TimeoutError), None)
    with pytest.raises(TimeoutError):
        list(reader.read(reader.partitions()[0]))


def test_spans():
    reader = paged.PagedReader({"from": "2026-01-30", "to": "2026-02-05", "days": "3"}, None, None)
    assert [(p.first, p.last) for p in reader.partitions()] == [("2026-01-30", "2026-02-01"), ("2026-02-02", "2026-02-04"), ("2026-02-05", "2026-02-05")]
    assert paged.PagedReader({"from": "2026-02-02", "to": "2026-02-01"}, None, None).partitions() == []
    with pytest.raises(ValueError):
        paged.PagedReader({"from": "2026-02-02", "to": "2026-02-03", "days": "0"}, None, None).partitions()
