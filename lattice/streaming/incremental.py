"""Incremental indexing of changed notes, and deduplication of streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators.dml import Store, classify


def refresh(store: Store, name: str, docs: DataFrame, *, key: str = "doc_id", digest: str = "content_hash", force: bool = False) -> DataFrame:
    """Brings the stored table up to date with ``docs``; counts by status (new, updated, unchanged)."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = classify(docs, store.read(name, ddl), key, digest, force)
    counts = marked.groupBy("status").agg(F.count("*").alias("n")).collect()
    changed = marked.where(F.col("status") != "unchanged").drop("status")
    store.merge(name, changed, [key])
    return docs.sparkSession.createDataFrame(counts, "status string, n bigint")


def on_change(store: Store, name: str, load: Callable[[DataFrame], DataFrame], *, delete: bool = False, path: str = "path", kind: str = "event_type") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: re-indexes what changed; with ``delete``, deleted paths leave the table."""

    def run(batch: DataFrame, _: int) -> None:
        changed = batch.where(F.col(kind) != "deleted")
        if not changed.isEmpty():
            refresh(store, name, load(changed))
        if delete and store.version(name):
            gone = batch.where(F.col(kind) == "deleted").select(F.col(path).alias("file"))
            if not gone.isEmpty():
                store.write(name, store.read(name).join(gone, "file", "left_anti"))

    return run


def first_seen(stream: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each key's first event, forgetting keys after ``delay`` of event time: resumable without a list of what was seen."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))
