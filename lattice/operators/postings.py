"""Full-text postings in segments: documents are added and deleted without rewriting the index.

Each change writes the postings of its documents, by bucket of the term's hash, and their ids; ids that
were there before are hidden in earlier segments. Scores are those of ``text.tfidf`` over the live
documents: their number is kept in the log, and document frequencies are counted over the live postings
of the query's terms, for which only those terms' buckets are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators.segments import Conflict, Segments, Snapshot
from lattice.operators.text import bucket_of, query_terms, score_terms
from lattice.session import ship

#: Attempts of a change whose count of documents another writer has overtaken.
ATTEMPTS = 5
#: Postings that are packed at once.
ROWS = 200_000

_TERM = re.compile("[a-z0-9]+")


def _lists(b: pa.RecordBatch) -> pa.RecordBatch:
    """Postings (term, doc, tf and perhaps a change's number) as lists: a row for each term and change of the batch, in order."""
    by = [c for c in b.schema.names if c not in ("doc", "tf")]
    b = b.sort_by([(c, "ascending") for c in by])
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for c in by:
        new[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    at = pa.array(np.append(first, b.num_rows).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, b.column(c)) for c in ("doc", "tf")]
    return pa.record_batch([*(b.column(c).take(pa.array(first)) for c in by), *lists], [*by, "docs", "tfs"])


def document_postings(docs: DataFrame) -> DataFrame:
    """bucket, term, docs and tfs of documents (doc, text): lists of the postings of a batch of documents; nothing is shuffled. Terms are those of ``text.terms``."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, terms, counts = [], [], []

            def held(of: pa.Array = b.column("doc"), rows: list = rows, terms: list = terms, counts: list = counts) -> pa.RecordBatch:
                out = _lists(pa.record_batch([pa.array(terms, pa.string()), of.take(pa.array(rows, pa.int32())), pa.array(counts, pa.int32())], ["term", "doc", "tf"]))
                rows.clear(), terms.clear(), counts.clear()
                return out

            for k, text in enumerate(b.column("text")):
                found = Counter(_TERM.findall(text.as_py() or ""))
                rows.extend([k] * len(found))
                terms.extend(found)
                counts.extend(found.values())
                if len(rows) >= ROWS:
                    yield held()
            if rows:
                yield held()

    ship(docs.sparkSession)
    # letters are lowered where the queries' are
    counted = docs.select("doc", F.lower("text").alias("text")).mapInArrow(run, f"term string, docs array<{kind}>, tfs array<int>")
    return counted.select(bucket_of(F.col("term")).alias("bucket"), "term", "docs", "tfs")


def unpacked(lists: DataFrame) -> DataFrame:
    """A row for each posting: doc and tf in place of the lists."""
    rest = [c for c in lists.columns if c not in ("docs", "tfs")]
    return lists.select(*rest, F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select(*rest, F.col("p.docs").alias("doc"), F.col("p.tfs").cast("bigint").alias("tf"))


def packed(rows: DataFrame) -> DataFrame:
    """Postings as lists again, batch by batch, so that no list is longer than a batch."""
    rest = [c for c in rows.columns if c not in ("doc", "tf")]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    own = rows.select(*rest, "doc", F.col("tf").cast("int").alias("tf"))
    return own.mapInArrow(lambda batches: (_lists(b) for b in batches if b.num_rows), f"{kinds}, docs array<{rows.schema['doc'].dataType.simpleString()}>, tfs array<int>")


@dataclass
class Postings:
    spark: SparkSession
    root: str

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, self.root, "doc", {"postings": ["bucket"], "docs": []}, order={"postings": ["term"]}, unpack={"postings": unpacked}, pack={"postings": packed})

    @staticmethod
    def count(s: Snapshot) -> int:
        """Live documents, from the log alone."""
        return s.meta.get("documents", 0)

    def _change(self, docs: DataFrame | None, keys: DataFrame, token: str | None) -> None:
        """One commit, with the number of live documents after it; tried again if another commit came between."""
        seg = self.segments
        for attempt in range(ATTEMPTS):
            s = seg.snapshot()
            if token is not None and token in s.tokens:
                return
            known = seg.read("docs", s=s)
            keys = keys.distinct()
            # only what is there is hidden: a merge of new documents alone copies their lists
            gone = keys.limit(0) if known is None else known.join(keys, "doc", "left_semi")
            hidden, added = gone.count(), 0 if docs is None else keys.count()
            frames = {} if docs is None else {"postings": document_postings(docs), "docs": keys}
            try:
                seg.write(frames, gone if hidden else None, token=token, meta={"documents": self.count(s) - hidden + added}, base=s)
                return
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise

    def add(self, docs: DataFrame, *, key: str = "id", text: str = "text", token: str | None = None) -> None:
        """Documents, each key once, in place of earlier ones of their keys. Null texts have no terms but count as documents; null keys are left out."""
        own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
        self._change(own, own.select("doc"), token)

    def delete(self, keys: DataFrame, *, key: str = "id", token: str | None = None) -> None:
        self._change(None, keys.select(F.col(key).alias("doc")).where("doc IS NOT NULL"), token)

    def compact(self, keep: int | None = None) -> None:
        """Merges segments by tiers; with ``keep`` also deletes what the last ``keep`` versions do not name, which no reader or writer may be using."""
        self.segments.compact()
        if keep is not None:
            self.segments.vacuum(keep)

    def of(self, terms: list[str], s: Snapshot | None = None) -> DataFrame | None:
        """term, doc and tf of the live documents that hold one of ``terms``."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"))).distinct().collect()
        buckets = sorted(r[0] for r in asked)
        found = self.segments.read("postings", lambda df: df.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)), s)
        return None if found is None else found.select("term", "doc", "tf")

    def scores(self, query: str, *, key: str = "id") -> DataFrame:
        """key and score of every live document that holds a term of the query."""
        s = self.segments.snapshot()
        terms = query_terms(query)
        index = self.of(terms, s) if terms else None
        if index is None:
            known = self.segments.read("docs", s=s)
            empty = self.spark.createDataFrame([], "doc string") if known is None else known.limit(0)
            return empty.select(F.col("doc").alias(key), F.lit(0.0).alias("score"))
        total = self.spark.range(1).select(F.lit(self.count(s)).alias("__docs"))
        return score_terms(index, total, "doc").withColumnRenamed("doc", key)

    def search(self, query: str, n: int, *, key: str = "id", within: DataFrame | None = None) -> DataFrame:
        """The n documents of greatest score, as ``text.tfidf`` ranks them; only those of ``within`` (column ``key``), where given."""
        scored = self.scores(query, key=key)
        if within is not None:
            scored = scored.join(within.select(key), key, "left_semi")
        return scored.orderBy(F.desc("score"), key).limit(n)
