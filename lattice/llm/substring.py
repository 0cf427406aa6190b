"""Substring dedup: words covered by a window that also starts in an earlier document go.

A window is WINDOW consecutive words of one document; "earlier" means a smaller id. Texts are
dealt into chunks by a hash of the id, so that a chunk has a bounded size whatever the ids, the
sources or the groups of copies. A chunk's window fingerprints form a sorted immutable run,
in which each occurs once: copies within a chunk meet before anything is shuffled. Runs are cut
into the same key ranges everywhere, compressed as sorted differences, and merged range by range:

1. 48-bit fingerprints of all windows are merged; back to each chunk goes a bit for each of its
   fingerprints, set where another chunk has it too.
2. For those windows alone, 64-bit keys from an independent hash, with the smallest id that has
   the key in its chunk, are merged. This verifies step 1: different windows with one fingerprint
   have different keys. Back go the keys of which an earlier id exists in another chunk.
3. Each chunk marks the words its windows cover.

``FingerprintIndex`` does the same for batch after batch against history: it keeps sorted runs of
(key, first id) in Parquet, merge-joins each new batch with them, and compacts FANOUT runs of a
level into one of the next. The list of runs is a file beside them, so that any later process goes on.

Null text: no words. A row without id is kept whole and is nobody's earlier copy. Rows of one id
never remove each other's words. Documents of fewer words than a window lose none.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import blocks, prepare, scratch, table, text_bytes, utf8
from lattice.llm.kernels import gram_hashes, gram_starts, pack, pack_raw, span_hashes, unpack, unpack_raw, word_spans
from lattice.llm.media import filesystem

WINDOW = 13
CHUNK_BYTES, RANGE_KEYS = 8 << 20, 1 << 20
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
_SHIFT = np.uint64(16)


def _windows(t: pa.Table, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in order: hash and document of each window, and the words before each document."""
    hashes, docs, counts = [], [], []
    at = 0
    for b in blocks(t, "text"):
        data, off = utf8(b.column("text"))
        starts, ends, doc_words = word_spans(data, off)
        words = span_hashes(data, starts, ends, seed)
        first, per = gram_starts(doc_words, window)
        hashes.append(gram_hashes(words, window, seed)[first])
        docs.append(np.repeat(np.arange(at, at + b.num_rows), per))
        counts.append(np.diff(doc_words))
        at += b.num_rows
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(docs), np.append(0, np.cumsum(np.concatenate(counts)))


def _ordered(t: pa.Table) -> pa.Table:
    return t.select(["doc_id", "text"]).sort_by("doc_id")


def _identified(t: pa.Table) -> pa.Table:
    """Without the rows that have no id."""
    return t.filter(pa.compute.is_valid(t.column("doc_id"))) if t.column("doc_id").null_count else t


@functools.lru_cache(maxsize=4)
def _edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // ranges for k in range(ranges)] or [0], dtype=np.uint64)


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each of the equal key ranges begins among sorted keys."""
    return np.append(np.searchsorted(keys, _edges(ranges, bits)), len(keys))


def _filled(cut: np.ndarray) -> list[int]:
    """The ranges that have keys: a chunk makes no more rows than it has keys, however many ranges there are."""
    return np.flatnonzero(np.diff(cut)).tolist()


def _runs_of_fingerprints(window: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        h, _, _ = _windows(_identified(t), window, 0)
        keys = np.unique(h >> _SHIFT)
        cut = _cuts(keys, ranges, 48)
        rows = [{"range": k, "chunk": chunk, "keys": pack(keys[cut[k] : cut[k + 1]])} for k in _filled(cut)]
        return pa.Table.from_pylist(rows, _FINGERPRINTS)

    return run


_FINGERPRINTS = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary())])
_KEYS = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("owner", pa.binary()), ("ids", pa.binary())])
_BACK = pa.schema([("chunk", pa.int32()), ("range", pa.int32()), ("marks", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _shared(t: pa.Table) -> pa.Table:
    """Of one key range: for each chunk the bits of its keys that another chunk has."""
    t = t.sort_by("chunk")
    runs = [unpack(b.as_py()) for b in t.column("keys")]
    keys = np.concatenate(runs)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marks = np.empty(len(s), bool)
    marks[order] = twice
    rows, at = [], 0
    for chunk, r in zip(t.column("chunk").to_pylist(), runs, strict=True):
        own = marks[at : at + len(r)]
        at += len(r)
        if own.any():
            rows.append({"chunk": chunk, "range": t.column("range")[0].as_py(), "marks": zstandard.compress(np.packbits(own).tobytes(), 1)})
    return pa.Table.from_pylist(rows, _BACK)


def _signed(ids: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers as unsigned in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _unsigned_back(ids: np.ndarray) -> np.ndarray:
    return (ids ^ np.uint64(1 << 63)).view(np.int64)


def _key_rows(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, ranges: int, chunk: int) -> list[dict]:
    """Sorted unique keys with the position of their first document in ``ids``, cut into ranges."""
    cut = _cuts(keys, ranges, 64)
    rows = []
    for k in _filled(cut):
        a, b = cut[k], cut[k + 1]
        used, at = np.unique(owner[a:b], return_inverse=True)
        rows.append({"range": k, "chunk": chunk, "keys": pack(keys[a:b]), "owner": pack_raw(at), "ids": pack(_signed(ids[used]))})
    return rows


def _first_owner(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unique keys, sorted, and the first document (documents are in order) of each."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.empty(0, bool)
    return s[new], docs[order][new]


def _runs_of_keys(window: int, ranges: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows or not back.num_rows:
            return pa.Table.from_pylist([], _KEYS)
        chunk = t.column("chunk")[0].as_py()
        t = _ordered(_identified(t))
        h, docs, _ = _windows(t, window, 0)
        f = h >> _SHIFT
        keys = np.unique(f)
        cut = _cuts(keys, ranges, 48)
        shared = np.zeros(len(keys), bool)
        for r, m in zip(back.column("range").to_pylist(), back.column("marks"), strict=True):
            n = cut[r + 1] - cut[r]
            shared[cut[r] : cut[r + 1]] = np.unpackbits(np.frombuffer(zstandard.decompress(m.as_py()), np.uint8), count=n).astype(bool)
        take = np.flatnonzero(shared[np.searchsorted(keys, f)])
        del keys, f, h
        k, _, _ = _windows(t, window, 1)
        unique, owner = _first_owner(k[take], docs[take])
        return pa.Table.from_pylist(_key_rows(unique, owner, t.column("doc_id").to_numpy(), ranges, chunk), _KEYS)

    return run


def _unpack_keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of one range: keys, first ids (order-preserving, unsigned) and the number of keys in each row."""
    keys = [unpack(b.as_py()) for b in t.column("keys")]
    ids = [unpack(i.as_py())[unpack_raw(o.as_py())] for i, o in zip(t.column("ids"), t.column("owner"), strict=True)]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(ids), np.fromiter(map(len, keys), np.int64, len(keys))


def _earlier(t: pa.Table, history: pa.Table | None = None) -> pa.Table:
    """Of one key range: for each chunk its keys that a smaller id has elsewhere, in another chunk or in history."""
    keys, ids, per = _unpack_keys(t)
    if not len(keys):
        return pa.Table.from_pylist([], _BACK)
    if history is not None and history.num_rows:
        old, old_ids, _ = _unpack_keys(history)
    else:
        old, old_ids = np.empty(0, np.uint64), np.empty(0, np.uint64)
    every, first = np.concatenate([keys, old]), np.concatenate([ids, old_ids])
    order = np.lexsort((first, every))
    s, d = every[order], first[order]
    new = np.append(True, s[1:] != s[:-1])
    smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.empty(len(s), bool)
    late[order] = d > smallest
    rows, at = [], 0
    for chunk, n in zip(t.column("chunk").to_pylist(), per.tolist(), strict=True):
        own = keys[at : at + n][late[at : at + n]]
        at += n
        if len(own):
            rows.append({"chunk": chunk, "range": t.column("range")[0].as_py(), "marks": pack(own)})
    return pa.Table.from_pylist(rows, _BACK)


def _remove(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_pylist([], _DONE)
        t = _ordered(t)
        ids = t.column("doc_id")
        known = np.asarray(ids.is_valid())
        number = ids.fill_null(0).to_numpy()
        k, docs, words = _windows(t, window, 1)
        late = np.sort(np.concatenate([unpack(b.as_py()) for b in back.column("marks")])) if back.num_rows else np.empty(0, np.uint64)
        gone = np.zeros(len(k), bool)
        if len(k):
            usable = np.flatnonzero(known[docs])
            unique, owner = _first_owner(k[usable], docs[usable])
            if len(unique):
                gone[usable] = number[docs[usable]] > number[owner[np.searchsorted(unique, k[usable])]]
            if len(late):
                at = np.minimum(np.searchsorted(late, k[usable]), len(late) - 1)
                gone[usable] |= late[at] == k[usable]
        per = np.maximum(np.diff(words) - window + 1, 0)
        start = np.arange(len(k)) + np.repeat(words[:-1] - (np.cumsum(per) - per), per)
        edge = np.zeros(words[-1] + 1, np.int32)
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        kept, removed = [], []
        for i, text in enumerate(t.column("text")):
            own = keep[words[i] : words[i + 1]]
            parts = (text.as_py() or "").encode().split()
            n = len(own) - int(own.sum())
            kept.append((b" ".join(compress(parts, own.tolist())) if n else b" ".join(parts)).decode())
            removed.append(n)
        return pa.Table.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(np.diff(words), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=_DONE)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _chunked(docs: DataFrame, id_col: str, text_col: str, size: int, chunk_bytes: int) -> DataFrame:
    n = max(1, math.ceil(size / chunk_bytes))
    key = F.coalesce(F.xxhash64(F.col(id_col)) if id_col else None, F.lit(0))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(key)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(key, F.lit(n)).cast("int").alias("chunk"))
    return rows.repartition(n, "chunk")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces, a row for each row of ``docs``."""
    size = text_bytes(docs, text_col)
    ranges = max(1, math.ceil(size / 6 / RANGE_KEYS))
    base = _chunked(docs, id_col, text_col, size, chunk_bytes)
    prints = base.groupBy("chunk").applyInArrow(_runs_of_fingerprints(window, ranges), _ddl(_FINGERPRINTS))
    shared = prints.groupBy("range").applyInArrow(_shared, _ddl(_BACK))
    keys = base.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_runs_of_keys(window, ranges), _ddl(_KEYS))
    late = keys.groupBy("range").applyInArrow(lambda t: _earlier(t), _ddl(_BACK))
    return base.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(_remove(window), _ddl(_DONE))


class FingerprintIndex:
    """Sorted immutable runs of (window key, first id) under ``path``, for batches that arrive over time.

    ``add`` returns the batch with the words of known windows removed and appends the batch's run;
    runs of one level are compacted into the next as soon as there are FANOUT of them. A run counts
    only once the list of runs names it: what a failed ``add`` leaves is never read, and its number is
    not used again. Batches must come in the order of their ids for the result to be that of
    ``dedup`` on all of them; otherwise a batch is only judged against what came before. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = WINDOW, ranges: int = 64, fanout: int = FANOUT) -> None:
        self.spark, self.window, self.ranges, self.fanout = spark, window, ranges, fanout
        self.path = path or scratch(spark, "fingerprints")
        self._files, self._base = filesystem(self.path)
        known = self._read()
        if known and (known["window"], known["ranges"]) != (window, ranges):
            raise ValueError(f"the index at {self.path} has windows of {known['window']} words in {known['ranges']} ranges")

    def _read(self) -> dict:
        path = f"{self._base}/_runs.json"
        if self._files.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with self._files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _list(self, runs: list[tuple[str, int]]) -> None:
        self._files.create_dir(self._base, recursive=True)
        new = f"{self._base}/_runs.{uuid.uuid4().hex}"
        with self._files.open_output_stream(new) as f:
            f.write(json.dumps({"window": self.window, "ranges": self.ranges, "runs": runs}).encode())
        self._files.move(new, f"{self._base}/_runs.json")

    @property
    def runs(self) -> list[tuple[str, int]]:
        """(name, level) of each run, oldest first."""
        return [(n, level) for n, level in self._read().get("runs", [])]

    def history(self, runs: list[tuple[str, int]] | None = None) -> DataFrame:
        names = [f"{self.path}/{n}" for n, _ in (self.runs if runs is None else runs)]
        return self.spark.read.parquet(*names) if names else self.spark.createDataFrame([], _ddl(_KEYS))

    def _write(self, keys: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        keys.groupBy("range").applyInArrow(_merged(self.ranges), _ddl(_KEYS)).write.parquet(f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
        window, ranges = self.window, self.ranges
        base = _chunked(docs, id_col, text_col, text_bytes(docs, text_col), chunk_bytes)

        def batch_keys(t: pa.Table) -> pa.Table:
            chunk = t.column("chunk")[0].as_py()
            t = _ordered(_identified(t))
            k, docs_, _ = _windows(t, window, 1)
            unique, owner = _first_owner(k, docs_)
            return pa.Table.from_pylist(_key_rows(unique, owner, t.column("doc_id").to_numpy(), ranges, chunk), _KEYS)

        # the chunks' runs are hashed once, for the join with history and for the batch's own run
        where = f"{self.path}/batch-{uuid.uuid4().hex}"
        base.groupBy("chunk").applyInArrow(batch_keys, _ddl(_KEYS)).write.parquet(where)
        keys = self.spark.read.parquet(where)
        before = self.runs
        late = keys.groupBy("range").cogroup(self.history(before).groupBy("range")).applyInArrow(_earlier, _ddl(_BACK))
        out = base.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(_remove(window), _ddl(_DONE))
        self._list([*before, (self._write(keys), 0)])
        level = 0
        while sum(x == level for _, x in self.runs) >= self.fanout:
            self._merge(level)
            level += 1
        return out

    def _merge(self, level: int | None) -> None:
        """The runs of a level (of all, if null) in one of the next; the old ones stay on disk for readers that have begun."""
        runs = self.runs
        old = [r for r in runs if level is None or r[1] == level]
        if len(old) > 1:
            new = (self._write(self.history(old)), max(x for _, x in old) + 1)
            self._list([new if r == old[0] else r for r in runs if r == old[0] or r not in old])

    def compact(self) -> None:
        """One run in place of all."""
        self._merge(None)


def _merged(ranges: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        keys, ids, _ = _unpack_keys(t)
        order = np.lexsort((ids, keys))
        s, d = keys[order], ids[order]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.empty(0, bool)
        known, at = np.unique(d[new], return_inverse=True)
        row = {"range": t.column("range")[0].as_py(), "chunk": -1, "keys": pack(s[new]), "owner": pack_raw(at), "ids": pack(known)}
        return pa.Table.from_pylist([row] if len(s) else [], _KEYS)

    return run


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN firsts USING (h) WHERE f < doc_id),
every AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS t FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
