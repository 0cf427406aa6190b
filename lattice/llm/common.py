"""Shared plumbing of the training-data operators: scratch space, Arrow batches, table reads.

Defined results used by every operator of this subpackage: a null text is the
empty text; extra columns are carried or ignored, never required; working
columns are prefixed with ``__`` so that clashing input names do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.session import ship

#: Bytes of text handled at once by the numpy kernels; bounds a Python worker's memory.
BLOCK_BYTES = 2 << 20


def prepare(spark: SparkSession, batch_bytes: str = "8m") -> None:
    """Bound the Arrow batches, so that long texts cannot fill a worker, and ship the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``; where it is unset a local one, but only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="lattice-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate, used to size partitions."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


#: A group with one part in HOT of all rows is hot; there are at most HOT of them.
HOT = 4096


def join_groups(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str = "__size") -> DataFrame:
    """``rows`` with what ``groups`` says of their group, for groups of which it has one row each, with their ``size``.

    The hot groups, at most HOT by their sizes, are joined by broadcast, so that none lands in one
    task; the others by a shuffle. Both frames are read more than once: pass stored ones.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot, cold = groups.where(F.col(size) * HOT >= total).drop(size), groups.where(F.col(size) * HOT < total).drop(size)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(cold, on))


def blocks(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of whole rows with at most ``limit`` text bytes, or one longer row."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
