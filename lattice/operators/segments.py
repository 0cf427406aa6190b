"""Tables of immutable segments with tombstones: changes are written, never the whole table.

A table has one or more parts (folders with partition columns of their own) whose rows belong to keys. A
change is one commit: new rows as a segment, and the keys that they, or a deletion, hide in all
earlier segments. The list of segments is a small log of numbered files, each created only
where it is absent, so that of two writers at one version one fails and can try again. Segments are
merged by tiers, FANOUT of a level to one of the next, so that a row is rewritten a
logarithmic number of times; readers keep the version that they started from until it is vacuumed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments of a level that are merged into one of the next, and names of past changes that are remembered.
FANOUT, TOKENS = 4, 256
#: Seconds after which a version that is not complete counts as given up, and the wait between attempts at a number that another writer has.
DEAD, PAUSE = 60, 0.1
#: Hidden keys up to which they are sent to every task.
BROADCAST = 200_000
_SEQ = "__seq"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one would be."""


class Log:
    """Numbered JSON files below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.path):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self.fs.listStatus(self.path) if f.getPath().getName().endswith(".json"))

    def _at(self, version: int) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(self.path, f"{version:012d}.json")

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._at(version))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def put(self, version: int, content: Mapping) -> None:
        """Creates a version, or raises ``Conflict`` if it is there."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self._at(version), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or self.fs.exists(self._at(version)):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def latest(self) -> tuple[int, dict | None]:
        """(number, content) of the newest complete version.

        One that is being written is not there yet, and its number cannot be put again; after DEAD seconds its
        writer counts as lost, and the number as used up.
        """
        used = 0
        for v in reversed(self.versions()):
            try:
                return max(v, used), self.read(v)
            except json.JSONDecodeError:
                if time.time() - self.fs.getFileStatus(self._at(v)).getModificationTime() / 1000 > DEAD:
                    used = max(used, v)
        return used, None


@dataclass(frozen=True)
class Segment:
    """Rows written by the changes ``low`` to ``high``: parts by name as (folder, rows), and hidden keys."""

    low: int
    high: int
    level: int
    parts: dict[str, tuple[str, int]]
    gone: str | None = None
    gone_rows: int = 0


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    sequence: int = 0
    segments: tuple[Segment, ...] = ()
    tokens: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)


@dataclass
class Segments:
    """A table at ``root``: ``parts`` gives each part's partition columns, ``order`` the columns that its files are sorted by; all parts have the column ``key``."""

    spark: SparkSession
    root: str
    key: str
    parts: Mapping[str, Sequence[str]]
    fanout: int = FANOUT
    order: Mapping[str, Sequence[str]] = field(default_factory=dict)
    #: for parts whose stored rows hold several keys: stored rows to rows with a key, and back, keeping other columns
    unpack: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    pack: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.root}/_log")

    def snapshot(self) -> Snapshot:
        version, content = self.log.latest()
        if content is None:
            return Snapshot(version)
        segments = tuple(Segment(s["low"], s["high"], s["level"], {k: tuple(v) for k, v in s["parts"].items()}, s["gone"], s["gone_rows"]) for s in content["segments"])
        return Snapshot(version, content["sequence"], segments, tuple(content["tokens"]), content["meta"])

    def _commit(self, s: Snapshot) -> Snapshot:
        new = replace(s, version=s.version + 1, tokens=s.tokens[-TOKENS:])
        self.log.put(new.version, {"sequence": new.sequence, "segments": [vars(x) for x in new.segments], "tokens": new.tokens, "meta": new.meta})
        return new

    def _store(self, part: str, df: DataFrame) -> tuple[str, int]:
        """Writes a part's rows to a folder of their own; (folder, rows). Large partitions are split among tasks, small ones share one."""
        name = f"{part}/{uuid.uuid4().hex}"
        by = list(self.parts[part])
        out = df.hint("rebalance", *by) if by else df
        if order := self.order.get(part):
            out = out.sortWithinPartitions(*by, *order)
        out.write.partitionBy(*by).parquet(f"{self.root}/{name}")
        return name, self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").count()

    def write(self, frames: Mapping[str, DataFrame], gone: DataFrame | None = None, *, token: str | None = None, meta: Mapping | None = None, base: Snapshot | None = None) -> Snapshot:
        """One change: new rows of each part, and the keys (column ``key``) whose earlier rows they take the place of.

        A change whose ``token`` was committed before is left out: a repeated batch is one change. With
        ``base`` the change holds only if nothing was committed since; otherwise it is put after what was.
        """
        s = base or self.snapshot()
        if token is not None and token in s.tokens:
            return s
        stamp = uuid.uuid4().hex
        # rows carry their change's number; it is fixed when the change is committed, by the segment
        stored = {part: self._store(part, df) for part, df in frames.items()}
        meta = {**(meta or {}), **{f"schema:{part}": df.schema.json() for part, df in frames.items()}}
        hidden, hides = None, 0
        if gone is not None:
            hidden = f"gone/{stamp}"
            gone.select(self.key).distinct().write.parquet(f"{self.root}/{hidden}")
            hides = self.spark.read.parquet(f"{self.root}/{hidden}").count()
            hidden = hidden if hides else None
        while True:
            if token is not None and token in s.tokens:
                return s
            n = s.sequence + 1
            tokens = (*s.tokens, token) if token is not None else s.tokens
            new = replace(s, sequence=n, segments=(*s.segments, Segment(n, n, 0, stored, hidden, hides)), tokens=tokens, meta={**s.meta, **meta})
            try:
                return self._commit(new)
            except Conflict:
                if base is not None:
                    raise
                time.sleep(PAUSE)
                s = self.snapshot()

    def delete(self, keys: DataFrame, *, token: str | None = None) -> Snapshot:
        return self.write({}, keys, token=token)

    def hidden(self, s: Snapshot) -> DataFrame | None:
        """key and the last change that hides it, of a snapshot."""
        out: DataFrame | None = None
        for seg in s.segments:
            if seg.gone is not None:
                part = self.spark.read.parquet(f"{self.root}/{seg.gone}")
                part = part if seg.level else part.withColumn(_SEQ, F.lit(seg.high).cast("bigint"))
                out = part if out is None else out.unionByName(part)
        if out is None:
            return None
        out = out.groupBy(self.key).agg(F.max(_SEQ).cast("bigint").alias("__hidden"))
        return F.broadcast(out) if sum(x.gone_rows for x in s.segments) <= BROADCAST else out

    def _rows(self, s: Snapshot, part: str) -> DataFrame | None:
        if f"schema:{part}" not in s.meta:
            return None
        schema = T.StructType.fromJson(json.loads(s.meta[f"schema:{part}"]))
        # merged segments keep the number of each row's change
        merged = T.StructType([*schema.fields, T.StructField(_SEQ, T.LongType())])
        out: DataFrame | None = None
        for seg in s.segments:
            if seg.parts.get(part, ("", 0))[1]:
                read = self.spark.read.schema(merged if seg.level else schema).parquet(f"{self.root}/{seg.parts[part][0]}")
                df = (read if seg.level else read.withColumn(_SEQ, F.lit(seg.high).cast("bigint"))).select(*merged.names)
                out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], merged) if out is None else out

    def read(self, part: str, only: Callable[[DataFrame], DataFrame] | None = None, s: Snapshot | None = None) -> DataFrame | None:
        """The live rows of a part, or None if it was never written. ``only`` filters stored rows before tombstones are looked up, so that it reaches the scans."""
        s = s or self.snapshot()
        rows = self._rows(s, part)
        if rows is None:
            return None
        rows = rows if only is None else only(rows)
        rows = self.unpack[part](rows) if part in self.unpack else rows
        hidden = self.hidden(s)
        return (rows if hidden is None else self._live(rows, hidden)).drop(_SEQ)

    def _live(self, rows: DataFrame, hidden: DataFrame) -> DataFrame:
        return rows.join(hidden, self.key, "left").where(F.col("__hidden").isNull() | (F.col("__hidden") <= F.col(_SEQ))).drop("__hidden")

    def compact(self) -> Snapshot:
        """Merges runs of ``fanout`` neighbouring segments of one level, lowest level first, until there is none.

        Hidden rows are left out of what is merged; tombstones stay as long as an earlier segment is there.
        """
        s = self.snapshot()
        while (found := self._tier(s)) is not None:
            s = self._merge(s, *found)
        return s

    def _tier(self, s: Snapshot) -> tuple[int, int] | None:
        for level in sorted({x.level for x in s.segments}):
            run = 0
            for i, x in enumerate(s.segments):
                run = run + 1 if x.level == level else 0
                if run == self.fanout:
                    return i - run + 1, i + 1
        return None

    def _merge(self, s: Snapshot, first: int, end: int) -> Snapshot:
        own = s.segments[first:end]
        some = replace(s, segments=own)
        hidden = self.hidden(s)
        parts = {}
        for part in {p for x in own for p in x.parts}:
            rows = self._rows(some, part)
            if hidden is not None:
                rows = self._live(self.unpack[part](rows) if part in self.unpack else rows, hidden)
                rows = self.pack[part](rows) if part in self.pack else rows
            parts[part] = self._store(part, rows)
        gone, below = None, self.hidden(some)
        if first and below is not None:
            gone = f"gone/{uuid.uuid4().hex}"
            below.withColumnRenamed("__hidden", _SEQ).write.parquet(f"{self.root}/{gone}")
        merged = Segment(own[0].low, own[-1].high, own[0].level + 1, parts, gone, sum(x.gone_rows for x in own) if gone else 0)
        while True:
            try:
                return self._commit(replace(s, segments=(*s.segments[:first], merged, *s.segments[end:])))
            except Conflict:
                now = self.snapshot()
                # changes committed meanwhile come after; a merge of the same segments by another makes this one void
                at = next((i for i in range(len(now.segments)) if now.segments[i : i + len(own)] == own), None)
                if at is None:
                    return now
                s, first, end = now, at, at + len(own)

    def rows(self, part: str, s: Snapshot | None = None) -> int:
        """Rows of a part on disk, hidden ones included: from the log alone."""
        return sum(x.parts[part][1] for x in (s or self.snapshot()).segments if part in x.parts)

    @staticmethod
    def _listed(log: Log, version: int) -> list[dict]:
        try:
            return log.read(version)["segments"]
        except json.JSONDecodeError:
            return []

    def vacuum(self, keep: int = 10) -> int:
        """Deletes the log's versions but the last ``keep``, and folders that none of these names; the number of folders.

        Run it when no writer is at work: a folder that is not committed yet is named nowhere.
        """
        log = self.log
        versions = log.versions()
        named = {n for v in versions[-keep:] for x in self._listed(log, v) for n in [*(p[0] for p in x["parts"].values()), x["gone"]] if n}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        dropped = 0
        for part in (*self.parts, "gone"):
            folder = path(f"{self.root}/{part}")
            for f in log.fs.listStatus(folder) if log.fs.exists(folder) else ():
                if f"{part}/{f.getPath().getName()}" not in named:
                    log.fs.delete(f.getPath(), True)
                    dropped += 1
        for v in versions[:-keep]:
            log.fs.delete(log._at(v), False)
        return dropped
