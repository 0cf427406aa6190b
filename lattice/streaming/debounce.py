"""Change events: filters, and the trailing debounce as a session window.

Each event of a key arms its timer anew; when nothing follows within the gap, the key fires once
with its latest event. An event exactly one gap later still belongs to the burst.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: The default gap, the watched endings and the path parts that are ignored.
DEFAULT_GAP = "1500 milliseconds"
WATCHED = (".md", ".markdown")
IGNORED = (".git", ".venv", "node_modules", ".solo", "archive")


def relevant(path: Column, endings: Sequence[str] = WATCHED, ignored: Sequence[str] = IGNORED) -> Column:
    """Whether a change of this path is looked at."""
    end = F.lit(False)
    for e in endings:
        end = end | F.endswith(path, F.lit(e))
    return end & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored)))


def debounce(events: DataFrame, key: Sequence[str], ts: str, latest: Mapping[str, str], gap: str = DEFAULT_GAP, watermark: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """key, the latest value of each of ``latest`` (new name: column), n and fired_at, a row for each burst.

    Of events of one time the last by ``ties`` counts, and after those by the value itself.

    The same plan for a table and a stream; a stream needs ``watermark`` and emits a burst when it
    has passed (append), or all bursts so far (complete).
    """
    source = events.withWatermark(ts, watermark) if watermark else events
    grouped = source.groupBy(*key, F.session_window(ts, gap).alias("__w"))
    out = grouped.agg(*[F.max_by(c, F.struct(ts, *ties, c)).alias(n) for n, c in latest.items()], F.count("*").alias("n"))
    return out.withColumn("fired_at", F.col("__w.end")).drop("__w")


def watch(events: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, *, key: str = "path", ts: str = "ts", kind: str = "event_type", gap: str = DEFAULT_GAP, watermark: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Debounced changes to a callback, batch by batch; state is in the checkpoint and outlives a stop."""
    fired = debounce(events.where(relevant(F.col(key))), [key], ts, {kind: kind}, gap, watermark)
    writer = fired.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
