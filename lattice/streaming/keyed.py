"""An incremental index of changing files: keyed state, change rows, and stored segments.

State of a file's key: the digest of its text and that of each chunk by id, and the event that waits. Each event arms the key's
timer anew (the trailing debounce), so that a burst is one change and a file that is deleted and written again at
once is only modified; when the timer fires, or at once without a gap, the difference of chunks is put out as change rows. A
batch of these is one change of the stored tables, named by query and batch: what is written grows with
what changed, and a batch that is run again after a failure is not written twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lattice.operators.chunking import CHUNK_LEAST, CHUNK_MOST, chunk
from lattice.operators.postings import Postings
from lattice.operators.segments import Segments
from lattice.session import ship
from lattice.sources.files import language
from lattice.streaming.tree import filesystem

CHANGES = "key STRING, file STRING, change STRING, chunk_id STRING, chunk_index INT, heading STRING, start_line INT, end_line INT, text STRING, total_chunks INT"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
#: Bytes of a file beyond which its text is not read but the file is taken as empty.
MOST_BYTES = 64 << 20


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


class FileState(StatefulProcessor):
    """Input: key, file, kind, event_type, ts, text. ``gap`` in milliseconds; ``event_time``: timers by the events' time and the watermark."""

    def __init__(self, gap: int, event_time: bool, least: int, most: int) -> None:
        self.gap, self.event_time, self.least, self.most = gap, event_time, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "digest STRING, ids ARRAY<STRING>, digests ARRAY<STRING>")
        self.waiting = handle.getValueState("waiting", "file STRING, kind STRING, event_type STRING, text STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:
            # of events of one time a deletion comes first: a file that is there again was written after it
            batch = batch.assign(__order=(batch["event_type"] != "deleted")).sort_values(["ts", "__order"], kind="stable")
            row = batch.iloc[-1]
            if last is None or (row["ts"], row["__order"]) >= (last["ts"], last["__order"]):
                last = row
        if last is None:
            return
        text = last["text"] if isinstance(last["text"], str) else None
        event = (last["file"], last["kind"] if isinstance(last["kind"], str) else None, last["event_type"], text)
        if not self.gap:
            yield from self._changes(key[0], event)
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        now = int(last["ts"].timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.waiting.update(event)
        self.handle.registerTimer(now + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            event = tuple(self.waiting.get())
            self.waiting.clear()
            yield from self._changes(key[0], event)

    def _changes(self, key: str, event: tuple) -> Iterator[pd.DataFrame]:
        file, kind, event_type, text = event
        known = self.known.get() if self.known.exists() else (None, [], [])
        old = dict(zip(known[1], known[2], strict=True))
        if event_type != "deleted" and text is None:
            return  # gone between listing and reading: its deletion is still to come
        if event_type == "deleted":
            found, digest = [], None
        else:
            digest = _digest(text)
            if digest == known[0]:
                return
            found = chunk(text, kind, self.least, self.most)
        new = {f"{key}::chunk_{c[0]}": c for c in found}
        # a chunk's number of chunks is part of it
        digests = {i: _digest(f"{c[1]}\0{c[2]}\0{c[3]}\0{c[5]}\0{c[4]}") for i, c in new.items()}
        out = [(key, file, "delete", i, None, None, None, None, None, None) for i in old if i not in new]
        out += [(key, file, "upsert", i, c[0], c[1], c[2], c[3], c[4], c[5]) for i, c in new.items() if old.get(i) != digests[i]]
        if digest is None:
            self.known.clear()
        else:
            self.known.update((digest, list(digests), list(digests.values())))
        if out:
            frame = pd.DataFrame(out, columns=_COLUMNS)
            yield frame.astype({c: "Int32" for c in ("chunk_index", "start_line", "end_line", "total_chunks")})

    def close(self) -> None:
        pass


def with_text(changes: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Changes of trees (root, path, event_type, ts) with the text of what was created or modified, read where the rows are; null for a file that is gone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {name: filesystem(root) for name, root in roots.items()}
        for b in batches:
            # a few files at a time: a batch of rows must not hold all of their texts
            for at in range(0, b.num_rows, 16):
                s = b.slice(at, 16)
                texts = []
                for root, path, kind in zip(*(s.column(c).to_pylist() for c in ("root", "path", "event_type")), strict=True):
                    text = None
                    if kind != "deleted":
                        where, base = opened[root]
                        try:
                            with where.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                                raw = f.read(MOST_BYTES + 1)
                            text = "" if len(raw) > MOST_BYTES else raw.decode("utf-8", "ignore")
                        except FileNotFoundError:
                            text = None
                    texts.append(text)
                yield pa.record_batch([*s.select(["root", "path", "event_type", "ts"]).columns, pa.array(texts, pa.string())], ["root", "path", "event_type", "ts", "text"])

    return changes.select("root", "path", "event_type", "ts").mapInArrow(run, "root STRING, path STRING, event_type STRING, ts TIMESTAMP, text STRING")


def chunk_kind(path: Column) -> Column:
    """How a file of this name is cut."""
    lang = language(path, documents=True)
    return F.when(lang == "markdown", "markdown").when(lang.isNotNull(), "code").otherwise("text")


def keyed_changes(events: DataFrame, *, gap: int = 0, watermark: str | None = None, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """Change rows of a stream of file events (root, path, event_type, ts, text); with ``watermark`` timers follow the events' time.

    State is kept in RocksDB, which this sets for the session.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = events.withWatermark("ts", watermark) if watermark else events
    own = source.select(F.concat_ws("|", "root", "path").alias("key"), F.col("path").alias("file"), chunk_kind(F.col("path")).alias("kind"), "event_type", "ts", "text")
    mode = "None" if not gap else "EventTime" if watermark else "ProcessingTime"
    return own.groupBy("key").transformWithStateInPandas(FileState(gap, watermark is not None, least, most), CHANGES, "Append", mode)


@dataclass
class ChunkIndex:
    """Chunks and their full-text postings below ``root``, changed by batches of change rows."""

    spark: SparkSession
    root: str

    @property
    def chunks(self) -> Segments:
        return Segments(self.spark, f"{self.root}/chunks", "chunk_id", {"chunks": []})

    @property
    def postings(self) -> Postings:
        return Postings(self.spark, f"{self.root}/postings")

    def apply(self, changes: DataFrame, token: str | None = None) -> bool:
        """One batch of change rows: a segment of each table, and tombstones for what it takes the place of. Whether there was a change."""
        changes = changes.persist()
        try:
            if changes.isEmpty():
                return False
            new = changes.where(F.col("change") == "upsert").drop("change")
            gone = changes.where(F.col("change") == "delete").select("chunk_id")
            self.chunks.write({"chunks": new}, changes.select("chunk_id"), token=token)
            self.postings.add(new, key="chunk_id", token=token)
            self.postings.delete(gone, key="chunk_id", token=None if token is None else f"{token}-gone")
            self.chunks.compact()
            self.postings.compact()
            return True
        finally:
            changes.unpersist()

    def read(self) -> DataFrame:
        found = self.chunks.read("chunks")
        return self.spark.createDataFrame([], CHANGES).drop("change") if found is None else found

    def search(self, query: str, n: int = 5) -> DataFrame:
        """The n best chunks by full text: score and the chunk's columns."""
        return self.postings.search(query, n, key="chunk_id").join(self.read(), "chunk_id").orderBy(F.desc("score"), "chunk_id")


def follow(changes: DataFrame, index: ChunkIndex, checkpoint: str, *, name: str = "chunks", once: bool = False, every: str = "1 second", then: Callable[[], object] | None = None) -> StreamingQuery:
    """Keeps ``index`` up to date with a stream of change rows, and calls ``then`` after each batch that changed it; a restart goes on from the checkpoint."""

    def apply(batch: DataFrame, number: int) -> None:
        if index.apply(batch, f"{name}:{number}") and then is not None:
            then()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
