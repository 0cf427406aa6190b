"""A data source over paged interfaces: a task for each span of days, pages by cursor, back-off, and progress that outlives a run.

With a ``progress`` folder each page is stored as it comes, with the cursor that follows it, below a folder of its span; a
read that starts again takes what is stored from there and goes on at the last cursor, so that no page is fetched
twice, whether a task is tried again or the whole run. ``fetch`` says that it is not its turn by raising ``Busy``
or a time-out or broken connection: the wait doubles from ``backoff`` seconds up to MOST_WAIT, for at
most ``tries`` attempts at one page.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds that one wait lasts at most, and attempts at a page.
MOST_WAIT, TRIES = 60.0, 6

Fetch = Callable[[str, str, "str | None"], tuple[list[tuple], "str | None"]]


class Busy(Exception):
    """The interface asks to wait, for ``seconds`` if it says how long."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__(f"busy: wait {seconds} s" if seconds else "busy")
        self.seconds = seconds


class Days(InputPartition):
    def __init__(self, first: str, last: str) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


def _plain(v: object) -> object:
    """A value as JSON holds it."""
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _typed(v: object, kind: T.DataType) -> object:
    """A value of JSON as its column's type has it."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        values = [v.get(f.name) for f in kind] if isinstance(v, dict) else v
        return tuple(_typed(x, f.dataType) for x, f in zip(values, kind, strict=True))
    if isinstance(kind, T.ArrayType):
        return [_typed(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {k: _typed(x, kind.valueType) for k, x in v.items()}
    if isinstance(kind, T.DateType):
        return date.fromisoformat(v)
    if isinstance(kind, T.TimestampType):
        return datetime.fromisoformat(v)
    return v


class _Progress:
    """The stored pages of a span; without a folder nothing is kept."""

    def __init__(self, folder: str | None, span: str) -> None:
        self.where, self.base = None, ""
        if folder:
            self.where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            self.base = f"{base.rstrip('/')}/{span}"
            self.where.create_dir(self.base, recursive=True)

    def page(self, n: int) -> dict | None:
        if self.where is None or self.where.get_file_info(f"{self.base}/{n:08d}.json").type == fs.FileType.NotFound:
            return None
        with self.where.open_input_stream(f"{self.base}/{n:08d}.json") as f:
            return json.loads(f.read())

    def store(self, n: int, rows: list[tuple], cursor: str | None) -> None:
        """A whole page or none: it is written aside and moved to its name."""
        if self.where is None:
            return
        aside = f"{self.base}/.{uuid.uuid4().hex}"
        with self.where.open_output_stream(aside) as f:
            f.write(json.dumps({"rows": _plain(rows), "cursor": cursor}, ensure_ascii=False).encode())
        self.where.move(aside, f"{self.base}/{n:08d}.json")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Fetch, schema: T.StructType) -> None:
        self.options, self.fetch, self.schema = options, fetch, schema

    def partitions(self) -> list[Days]:
        at, end, step = date.fromisoformat(self.options["from"]), date.fromisoformat(self.options["to"]), int(self.options.get("days", 7))
        if step < 1:
            raise ValueError("a span has one day or more")
        out = []
        while at <= end:
            last = min(at + timedelta(days=step - 1), end)
            out.append(Days(at.isoformat(), last.isoformat()))
            at = last + timedelta(days=1)
        return out

    def _fetch(self, span: Days, cursor: str | None) -> tuple[list[tuple], str | None]:
        tries, wait = int(self.options.get("tries", TRIES)), float(self.options.get("backoff", 1.0))
        for attempt in range(1, tries + 1):
            try:
                return self.fetch(span.first, span.last, cursor)
            except (Busy, TimeoutError, ConnectionError) as e:
                if attempt == tries:
                    raise
                time.sleep(min(getattr(e, "seconds", None) or wait, MOST_WAIT))
                wait *= 2
        raise AssertionError("no attempt was made")

    def read(self, partition: Days) -> Iterator[tuple]:
        progress = _Progress(self.options.get("progress"), f"{partition.first}_{partition.last}")
        cursor: str | None = None
        n = 0
        while True:
            known = progress.page(n)
            if known is not None:
                rows, cursor = [_typed(r, self.schema) for r in known["rows"]], known["cursor"]
            else:
                rows, cursor = self._fetch(partition, cursor)
                progress.store(n, rows, cursor)
            yield from rows
            if cursor is None:
                return
            n += 1


def paged_source(source: str, ddl: str, fetch: Fetch) -> type[DataSource]:
    """The data source: options from, to (days), days (of a span), progress, backoff, tries.

    ``fetch(first day, last day, cursor)`` returns rows and the next cursor; none ends the span.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return ddl

        def reader(self, schema: T.StructType) -> PagedReader:
            return PagedReader(dict(self.options), fetch, schema)

    return Paged


def read_paged(spark: SparkSession, kind: type[DataSource], first: str, last: str, days: int = 7, known: DataFrame | None = None, key: str = "slug", limit: int | None = None, progress: str | None = None, backoff: float = 1.0) -> DataFrame:
    """Rows of a span of days whose key is not known yet; with ``progress`` a run that was broken off goes on where it stopped."""
    spark.dataSource.register(kind)
    options = {"from": first, "to": last, "days": str(days), "backoff": str(backoff), **({"progress": progress} if progress else {})}
    df = spark.read.format(kind.name()).options(**options).load()
    if known is not None:
        df = df.join(known.select(key), key, "left_anti")
    return df if limit is None else df.limit(limit)
