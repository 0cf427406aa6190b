"""Keyed upserts over frames, and a store that swaps versions.

Plain Parquet has no MERGE: the new state is written to a version of its own, and a numbered log, whose
files are created only where they are absent, names it, so that a reader never sees half a change, a
plan may read what it replaces, and of two merges at one version one is done again on what the other wrote.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.operators.joins import dedupe_by_priority
from lattice.operators.segments import PAUSE, Conflict, Log

#: Attempts of a merge that other writers overtake.
ATTEMPTS = 5


def last_per_key(df: DataFrame, key: Sequence[str], sequence: Sequence[Column] = ()) -> DataFrame:
    """One row for each key: the last by ``sequence``; without one, any, chosen by all columns."""
    order = [*sequence] or [F.xxhash64(*[F.col(c) for c in df.columns])]
    return dedupe_by_priority(df, key, [o.desc() if not sequence else o for o in order])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The new rows, and the old ones of other keys. ``new`` must have each key once."""
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """created and matched: how many of the new keys were not, and were, there."""
    known = old.select(*key).distinct().withColumn("__known", F.lit(True))
    both = new.select(*key).distinct().join(known, list(key), "left")
    return both.agg(F.count_if(F.col("__known").isNull()).alias("created"), F.count_if(F.col("__known").isNotNull()).alias("matched"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of which there is one for each pair of ends; properties of the newer edge stay."""
    return upsert(old, new.dropDuplicates(["src", "dst"]), ["src", "dst"])


def created_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: the number of new pairs of ends."""
    return new.select("src", "dst").distinct().join(old.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("relationships_created"))


def append_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of which there may be several for a pair of ends; where the old ones are numbered, the new ones are too, apart from each other."""
    if "eid" in old.columns:
        new = number_edges(new)
    return old.unionByName(new, allowMissingColumns=True)


def number_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``eid``, a number of each edge that stays with it: by its columns, and its place among equal rows.

    Edges that have one keep it. Equal parallel rows get different numbers, a row the same in every run.
    """
    if "eid" in edges.columns:
        return edges
    own = [F.col(c) for c in sorted(edges.columns)]
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(0)))
    return edges.withColumn("__place", place).withColumn("eid", F.xxhash64(*own, F.col("__place"))).drop("__place")


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str]) -> DataFrame:
    """The new rows in place of all old ones of their parents."""
    return old.join(new.select(*parent).distinct(), list(parent), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def with_missing_nodes(nodes: DataFrame, endpoints: DataFrame, key: str) -> DataFrame:
    """``nodes`` and bare ones, null but for the key columns given, for endpoints that have none."""
    bare = endpoints.dropDuplicates([key]).join(nodes.select(key), key, "left_anti")
    return nodes.unionByName(bare, allowMissingColumns=True)


def classify(now: DataFrame, before: DataFrame, key: str, digest: str, force: bool = False) -> DataFrame:
    """``now`` with status: new, updated or unchanged, by the stored digest; with ``force`` nothing is unchanged."""
    old = before.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"))
    both = now.join(old, now[key] == old["__key"], "left")
    same = F.lit(False) if force else F.col(digest) == F.col("__digest")
    return both.withColumn("status", F.when(F.col("__key").isNull(), "new").when(same, "unchanged").otherwise("updated")).drop("__key", "__digest")


@dataclass
class Store:
    """Named tables under ``root``: each change is a new version, its line in the log the commit."""

    spark: SparkSession
    root: str

    def _fs(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.root:
            return fs.FileSystem.from_uri(self.root)
        return fs.LocalFileSystem(), self.root

    def _log(self, name: str) -> Log:
        return Log(self.spark, f"{self.root}/{name}/_log")

    def version(self, name: str) -> str | None:
        """The folder of the table's newest version."""
        content = self._log(name).latest()[1]
        return None if content is None else content["version"]

    def names(self) -> list[str]:
        where, base = self._fs()
        if where.get_file_info(base).type == fs.FileType.NotFound:
            return []
        found = [i.base_name for i in where.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
        return sorted(n for n in found if self.version(n))

    def read(self, name: str, ddl: str | None = None) -> DataFrame:
        return self._read(name, self.version(name), ddl)

    def _read(self, name: str, version: str | None, ddl: str | None) -> DataFrame:
        if version is None:
            if ddl is None:
                raise AnalysisException(f"no table {name} in {self.root}")
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), base: int | None = None) -> None:
        """The table's new state. With ``base``, the number of the version that it was made from, raises ``Conflict`` if there is a newer one."""
        v = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{v}")
        log = self._log(name)
        while True:
            try:
                log.put((log.latest()[0] if base is None else base) + 1, {"version": v})
                return
            except Conflict:
                if base is not None:
                    raise
                time.sleep(PAUSE)

    def merge(self, name: str, new: DataFrame, key: Sequence[str]) -> DataFrame:
        """Upsert; returns the counts of created and matched keys, taken before the change. Done again if another writer comes between."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        for attempt in range(ATTEMPTS):
            number, content = self._log(name).latest()
            old = self._read(name, None if content is None else content["version"], ddl)
            counts = upsert_counts(old, new, key).collect()
            try:
                self.write(name, upsert(old, new, key), base=number)
                break
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        return self.spark.createDataFrame(counts, "created bigint, matched bigint")

    def delete(self, name: str) -> bool:
        where, base = self._fs()
        if self.version(name) is None:
            return False
        where.delete_dir(f"{base}/{name}")
        return True


#: What belongs to a project and goes with it. Packages are shared; sessions stay, and their edges to
#: files come back with the files, because they are kept by key.
_OWNED = {"File": "project", "Symbol": "project", "Project": "name"}


def clear_projects(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], projects: DataFrame) -> tuple[dict[str, DataFrame], dict[tuple[str, str, str], DataFrame]]:
    """The graph without the nodes of ``projects`` (project) and the edges that start at them or end there, but for those of sessions.

    One anti-join for each table, whatever the number of projects.
    """
    kept, gone = dict(nodes), {}
    names = projects.select(F.col("project").alias("__project"))
    for label, column in _OWNED.items():
        if label in nodes:
            own = F.col(column) == F.col("__project")
            gone[label] = nodes[label].join(names, own, "left_semi").select(F.col("id").alias("__gone"))
            kept[label] = nodes[label].join(names, own, "left_anti")
    out = {}
    for (a, kind, b), e in edges.items():
        if a in gone:
            e = e.join(gone[a], F.col("src") == F.col("__gone"), "left_anti")
        if b in gone and a != "Session":
            e = e.join(gone[b], F.col("dst") == F.col("__gone"), "left_anti")
        out[(a, kind, b)] = e
    return kept, out


def clear_project(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], project: str) -> tuple[dict[str, DataFrame], dict[tuple[str, str, str], DataFrame]]:
    """``clear_projects`` for one project."""
    spark = next(iter(nodes.values())).sparkSession
    return clear_projects(nodes, edges, spark.createDataFrame([(project,)], "project string"))
