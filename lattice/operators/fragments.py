"""Literal fragments in texts, found in the tasks: which of a list of fragments each text holds.

The list goes to the tasks, so its size is checked before. In a block of texts the places where some fragment
may begin are told by two bytes; for each length of fragments the windows of these places are looked up by
a rolling hash and then compared byte by byte. UTF-8 is searched as it is: no character begins within another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Most fragments of a list, their most bytes, and their most lengths.
MOST, MOST_BYTES, MOST_LENGTHS = 1 << 20, 1 << 24, 256
#: Bytes of text searched at once; bounds a worker's memory.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def listed(fragments: DataFrame, fragment: str) -> tuple[pa.Array, bool] | None:
    """The different fragments that are not empty and whether each is in one row, or None if they are too many for a list."""
    each = fragments.where(F.length(fragment) > 0).groupBy(F.col(fragment).alias("f")).agg(F.count("*").alias("n"))
    size = each.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("f")), F.lit(0)).alias("bytes"), F.countDistinct(F.octet_length("f")).alias("lengths"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    if size["n"] > MOST or size["bytes"] > MOST_BYTES or size["lengths"] > MOST_LENGTHS:
        return None
    return pa.chunked_array(each.select("f").toArrow().column(0).chunks, pa.string()).combine_chunks(), size["most"] == 1


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a string column and where each text begins; nulls are empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)), off - off[0]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Fragments:
    """A list of fragments, to be found in blocks of texts."""

    def __init__(self, fragments: pa.Array) -> None:
        data, off = _bytes(fragments)
        n = np.diff(off)
        self.count = len(n)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.begins = np.zeros(1 << 16, bool)  # by two bytes; a fragment of one byte may begin with any second one
        self.up, self.down = np.ones(0, np.uint64), np.ones(0, np.uint64)
        for length in np.unique(n[n > 0]).tolist():
            own = np.flatnonzero(n == length)
            text = data[off[own][:, None] + np.arange(length)]
            key = ((text.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, length)).sum(1, dtype=np.uint64)
            order = np.argsort(key)
            self.by_length.append((length, key[order], own[order], text[order]))
            first = text[:, 0].astype(np.int64) << 8
            self.begins[first | text[:, 1] if length > 1 else (first[:, None] | np.arange(256)).ravel()] = True

    def held(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, fragment) of what each text holds, once each, in the order of the texts."""
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        two = data.astype(np.uint16) << 8
        two[:-1] |= data[1:]
        starts = np.flatnonzero(self.begins[two])
        row = np.searchsorted(off, starts, side="right") - 1
        left = off[row + 1] - starts
        before = np.append(np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64))
        found = [np.empty(0, np.int64)]
        for length, keys, own, text in self.by_length:
            use = np.flatnonzero(left >= length)
            at = starts[use]
            h = (before[at + length] - before[at]) * self.down[at]
            lo = np.searchsorted(keys, h)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
            lo, use, at = lo[hit], use[hit], at[hit]
            many = np.searchsorted(keys, h[hit], side="right") - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            use, at = np.repeat(use, many), np.repeat(at, many)
            step = max(1, (1 << 22) // length)
            for k in range(0, len(which), step):
                w, p = which[k : k + step], at[k : k + step]
                same = (data[p[:, None] + np.arange(length)] == text[w]).all(1)
                found.append(row[use[k : k + step]][same] * self.count + own[w[same]])
        return np.divmod(np.unique(np.concatenate(found)), max(self.count, 1))


def fragments_held(texts: DataFrame, text: str, fragments: pa.Array, name: str) -> DataFrame:
    """``texts`` with ``name``: the different ``fragments`` that the text holds, an array, empty for none and null."""
    columns = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Fragments(fragments)
        for b in batches:
            _, off = _bytes(b.column(columns.index(text)))
            start = 0
            while start < b.num_rows:
                stop = min(max(int(np.searchsorted(off, off[start] + BLOCK, side="right")) - 1, start + 1), b.num_rows)
                part = b.slice(start, stop - start)
                row, fragment = every.held(*_bytes(part.column(columns.index(text))))
                cuts = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, fragments.take(pa.array(fragment)))], [*columns, name])
                start = stop

    return texts.mapInArrow(run, StructType([*texts.schema.fields]).add(name, ArrayType(StringType())))
