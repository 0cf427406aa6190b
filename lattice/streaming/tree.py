"""Changes of source trees as a stream: a Python data source whose offset names a stored listing.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("roots", '{"notes": "/notes"}').option("state", "/shared/state").load()

Each poll lists the roots. A listing that differs from the last one is stored below ``state``, sorted, in shards by
the hash of the path, and named by its content; the offset is that name. A batch is the sorted-merge difference
of two listings, a task for each shard: created, modified (another size or time) and deleted. A query that
starts again from its checkpoint compares with the listing that it had finished, so that what happened
meanwhile is neither lost nor repeated; what came and went between two polls is not seen.

``state`` and the roots are on file systems that the driver and the executors share. ``endings`` (joined by commas;
empty: all files) and ``ignored`` (path parts) limit what is listed; hidden errors do not: a root that cannot be
listed fails the query, a root that is missing is empty.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lattice.streaming.debounce import IGNORED, WATCHED

SCHEMA = "root STRING, path STRING, event_type STRING, ts TIMESTAMP, size BIGINT"
_ARROW = pa.schema([("root", pa.string()), ("path", pa.string()), ("event_type", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("size", pa.int64())])
#: Shards of a listing, rows of a batch, listings that are kept.
SHARDS, ROWS, KEPT = 16, 10_000, 8

Entry = tuple[str, str, int, int]


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listing(roots: dict[str, str], endings: tuple[str, ...], ignored: frozenset[str]) -> Iterator[Entry]:
    """(root, path below it, microseconds of its time, size) of every file that is watched."""
    for name, root in roots.items():
        where, base = filesystem(root)
        base = base.rstrip("/")
        for f in where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            path = f.path[len(base) + 1 :] if f.path.startswith(base + "/") else f.path
            if f.type == fs.FileType.File and (not endings or path.lower().endswith(endings)) and ignored.isdisjoint(path.split("/")):
                yield name, path, (f.mtime_ns or 0) // 1000, f.size or 0


def difference(before: Iterator[Entry], after: Iterator[Entry], deleted_at: int) -> Iterator[tuple]:
    """(root, path, event_type, microseconds, size) of two sorted listings, by path."""
    a, b = next(before, None), next(after, None)
    while a is not None or b is not None:
        if b is None or (a is not None and a[:2] < b[:2]):
            yield *a[:2], "deleted", deleted_at, None
            a = next(before, None)
        elif a is None or b[:2] < a[:2]:
            yield *b[:2], "created", b[2], b[3]
            b = next(after, None)
        else:
            if a[2:] != b[2:]:
                yield *b[:2], "modified", b[2], b[3]
            a, b = next(before, None), next(after, None)


class Shard(InputPartition):
    def __init__(self, number: int, before: str, after: str) -> None:
        super().__init__(number)
        self.number, self.before, self.after = number, before, after


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["roots"])
        self.state = options["state"].rstrip("/")
        self.endings = tuple(e for e in options.get("endings", ",".join(WATCHED)).lower().split(",") if e)
        self.ignored = frozenset(e for e in options.get("ignored", ",".join(IGNORED)).split(",") if e)

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        shards: list[list[Entry]] = [[] for _ in range(SHARDS)]
        for e in listing(self.roots, self.endings, self.ignored):
            shards[hashlib.md5(f"{e[0]}\0{e[1]}".encode()).digest()[0] % SHARDS].append(e)
        lines = ["".join(json.dumps(e, ensure_ascii=False) + "\n" for e in sorted(s)).encode() for s in shards]
        name = hashlib.sha256(b"\0".join(lines)).hexdigest()[:32]
        where, base = filesystem(self.state)
        done = f"{base}/{name}/at"
        if where.get_file_info(done).type == fs.FileType.NotFound:
            where.create_dir(f"{base}/{name}", recursive=True)
            for k, text in enumerate(lines):
                with where.open_output_stream(f"{base}/{name}/{k}") as f:
                    f.write(text)
            # the time of the listing counts for deletions; it is written last and marks the listing complete
            with where.open_output_stream(done) as f:
                f.write(str(time.time_ns() // 1000).encode())
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        if start["listing"] == end["listing"]:
            return []
        return [Shard(k, start["listing"], end["listing"]) for k in range(SHARDS)]

    def _entries(self, name: str, shard: int) -> Iterator[Entry]:
        if not name:
            return
        where, base = filesystem(self.state)
        with where.open_input_stream(f"{base}/{name}/{shard}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield tuple(json.loads(line))

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(self.state)
        with where.open_input_stream(f"{base}/{partition.after}/at") as f:
            at = int(f.read())
        rows: list[tuple] = []
        for r in difference(self._entries(partition.before, partition.number), self._entries(partition.after, partition.number), at):
            rows.append(r)
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def commit(self, end: dict) -> None:
        """Listings older than the one that is done go, but for the last few: a checkpoint may lag behind by a batch."""
        where, base = filesystem(self.state)

        def at(name: str) -> int:
            with where.open_input_stream(f"{base}/{name}/at") as f:
                return int(f.read() or 0)

        names = [f.base_name for f in where.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory]
        whole = sorted((at(n), n) for n in names if where.get_file_info(f"{base}/{n}/at").type == fs.FileType.File)
        mark = next((t for t, n in whole if n == end["listing"]), 0)
        for _, name in [x for x in whole if x[0] < mark][:-KEPT]:
            where.delete_dir(f"{base}/{name}")


class TreeChanges(DataSource):
    """The data source ``tree_changes``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def tree_changes(spark, roots: dict[str, str], state: str, endings: tuple[str, ...] = WATCHED, ignored: tuple[str, ...] = IGNORED):
    """The stream of changes below ``roots`` (name: folder), with listings kept below ``state``."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("roots", json.dumps(roots)).option("state", state).option("endings", ",".join(endings)).option("ignored", ",".join(ignored)).load()
