"""Commit logs: a data source over repositories, and the parser of its lines."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Commits of each repository, seconds allowed, and the line of a commit.
COMMITS, SECONDS, FORMAT = 100, 30, "%H|%an|%aI"


def parse_log(lines: DataFrame) -> DataFrame:
    """file, project, author, date, lines_added, lines_removed, commit from (project, line_no, line).

    A commit's header holds for the file lines that follow; ``-`` for a binary file is 0.
    """
    w = Window.partitionBy("project").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.rlike("line", F.lit(r"^[0-9a-f]{7,}\|")), F.col("line"))
    rows = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).withColumn("t", F.split("line", "\t")).where((F.size("t") == 3) & F.col("head").isNotNull())
    h = F.split("head", r"\|")
    number = lambda k: F.coalesce(F.get("t", F.lit(k)).try_cast("bigint"), F.lit(0))
    middle = F.array_join(F.slice(h, 2, F.greatest(F.size(h) - 2, F.lit(0))), "|")  # a name may hold a bar
    return rows.select(F.col("t")[2].alias("file"), "project", middle.alias("author"), F.substring(F.element_at(h, -1), 1, 10).alias("date"), number(0).alias("lines_added"), number(1).alias("lines_removed"), F.substring(h[0], 1, 8).alias("commit"))


def modified_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """A loop at each known file for each of its changes; several for one file stay several."""
    own = parsed.withColumn("src", F.concat_ws("|", "project", "file"))
    known = own.join(files.select(F.col("id").alias("src")), "src", "left_semi")
    return known.select("src", F.col("src").alias("dst"), "author", "date", "lines_added", "lines_removed", "commit")


def last_commit(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("project").agg(F.max("date").alias("last_commit"))


class _Repository(InputPartition):
    def __init__(self, project: str, path: str) -> None:
        super().__init__(path)
        self.project, self.path = project, path


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[_Repository]:
        return [_Repository(k[len("repo.") :], v) for k, v in sorted(self.options.items()) if k.startswith("repo.")]

    def read(self, partition: _Repository) -> Iterator[tuple[str, int, str]]:
        if not shutil.which("git"):
            return
        command = ["git", "log", f"-{self.options.get('commits', COMMITS)}", "--numstat", f"--format={FORMAT}"]
        done = subprocess.run(command, cwd=partition.path, capture_output=True, text=True, timeout=SECONDS, check=False)
        for k, line in enumerate(done.stdout.splitlines() if done.returncode == 0 else []):
            yield partition.project, k, line


class GitLog(DataSource):
    """``format("git_log")`` with options ``repo.<project> = path``: a partition for each repository."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "project string, line_no bigint, line string"

    def reader(self, schema: object) -> _GitReader:
        return _GitReader(dict(self.options))


def read_log(spark: SparkSession, repositories: dict[str, str]) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").options(**{f"repo.{k}": v for k, v in repositories.items()}).load()
