"""A stored approximate index of vectors: lists around coarse centroids, probed by query.

Centroids are fitted once, on a sample of at most SAMPLE vectors for each list, in which every row has
its place by the hash of its key. Every row lies in the list of its nearest centroid; later rows are
assigned without fitting again, as a segment of their own, and deletions are tombstones. How many lists a query
probes is measured at build time: exact searches of a sample of rows give the fewest lists that hold
TARGET of the true neighbours. A search of few queries reads the folders of their lists alone; one of many
is a join by list, with lists and queries dealt to tasks in blocks and scored as matrix products.

Vectors are compared by cosine. Null vectors, and those of length zero or with entries that are null or not finite, are not
indexed. Ties go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.operators.segments import Segments, Snapshot
from lattice.session import ship

#: Sampled vectors for each list, the most lists, queries that calibrate, neighbours that they look for and the share that must be in probed lists.
SAMPLE, MOST_LISTS, CALIBRATION, NEIGHBOURS, TARGET = 64, 4096, 256, 10, 0.95
#: Vectors and queries that meet in one task, and queries whose lists are named in the plan.
VECTORS, QUERIES, NAMED = 8192, 1024, 64

_META = ("centroids", "dimension", "probes", "lists")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _usable(df: DataFrame, embedding: str, dimension: int | None = None) -> DataFrame:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    ok = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad) & F.exists(embedding, lambda c: c != 0)
    return df.where(ok if dimension is None else ok & (F.size(embedding) == dimension))


def _ranks(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first."""
    scores = _unit(vectors) @ centroids.T
    n = min(n, scores.shape[1])
    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)


def _nearest_lists(df: DataFrame, key: str, embedding: str, centroids: np.ndarray, n: int) -> DataFrame:
    """id, vector, list and its place (from 0) for the n nearest lists of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, VECTORS):
                s = b.slice(at, VECTORS)
                found = _ranks(_matrix(s.column("vector")), centroids, n)
                rows = pa.array(np.repeat(np.arange(s.num_rows), found.shape[1]))
                yield pa.record_batch([s.column("id").take(rows), s.column("vector").take(rows), pa.array(found.ravel().astype(np.int32)), pa.array(np.tile(np.arange(found.shape[1], dtype=np.int32), s.num_rows))], ["id", "vector", "list", "place"])

    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    return own.mapInArrow(run, f"id {kind}, vector array<double>, list int, place int")


def _top(group: pa.Table, k: int) -> pa.Table:
    """The k best vectors of one block for each query of it."""
    is_query = group.column("query").to_numpy(zero_copy_only=False)
    q, v = group.filter(pa.array(is_query)).combine_chunks(), group.filter(pa.array(~is_query)).combine_chunks()
    schema = pa.schema([("query_id", group.schema.field("id").type), ("id", group.schema.field("id").type), ("score", pa.float64()), ("place", pa.int32())])
    if not q.num_rows or not v.num_rows:
        return schema.empty_table()
    # equal scores by key: vectors are in order of their keys, and the sort is stable
    v = v.sort_by("id")
    a, b = (_unit(_matrix(t.column("vector").combine_chunks())) for t in (q, v))
    scores = a @ b.T
    top = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(q.num_rows), top.shape[1])
    return pa.table([q.column("id").take(pa.array(rows)), v.column("id").take(pa.array(top.ravel())), pa.array(np.take_along_axis(scores, top, 1).ravel()), q.column("place").take(pa.array(rows))], schema=schema)


class VectorIndex:
    """The index stored at ``root``: build it once, then ``add``, ``delete``, ``search`` and ``compact``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        ship(spark)
        self.spark = spark
        self.segments = Segments(spark, root, "id", {"lists": ["list"]})

    # --- what was fitted
    def _model(self, s: Snapshot) -> tuple[np.ndarray, int]:
        if "centroids" not in s.meta:
            raise ValueError(f"no index at {self.segments.root}")
        return np.array(s.meta["centroids"]).reshape(s.meta["lists"], -1), s.meta["probes"]

    @property
    def probes(self) -> int:
        return self._model(self.segments.snapshot())[1]

    def build(self, df: DataFrame, *, key: str = "id", embedding: str = "embedding", lists: int | None = None) -> VectorIndex:
        """Fits the centroids on a bounded sample of ``df`` and assigns every row; the table must have a row with a usable vector."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        own = _usable(df, embedding)
        size = own.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if size is None:
            raise ValueError("no usable vector to fit an index on")
        own, n = own.where(F.size(embedding) == size["d"]), size["count"]
        lists = min(lists or max(1, math.isqrt(n)), MOST_LISTS)
        # every row has its place in a fixed order by hash; the first ones are the sample
        part = min(1.0, lists * SAMPLE / n)
        place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
        sample = own.where(place < part).select(array_to_vector(F.transform(embedding, lambda x: x.cast("double") / F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda t, y: t + y.cast("double") * y.cast("double"))))).alias("features"))
        fitted = KMeans(k=lists, distanceMeasure="cosine", seed=7, maxIter=10).fit(sample)
        centroids = _unit(np.array(fitted.clusterCenters()))
        rows = _nearest_lists(own, key, embedding, centroids, 1).drop("place")
        meta = {"centroids": np.round(centroids, 9).ravel().tolist(), "dimension": size["d"], "lists": len(centroids), "probes": len(centroids)}
        self.segments.write({"lists": rows}, meta=meta)
        asked = own.where(place < CALIBRATION / n).select(F.col(key).alias("id"), F.col(embedding).alias("embedding"))
        self.segments.write({}, meta={"probes": self._calibrated(asked, len(centroids))})
        return self

    def _calibrated(self, asked: DataFrame, lists: int) -> int:
        """The fewest lists that hold TARGET of the nearest NEIGHBOURS of the sampled rows."""
        found = self.search(asked, NEIGHBOURS, key="id", probes=lists, places=True)
        counts = {r["place"]: r["n"] for r in found.groupBy("place").agg(F.count("*").alias("n")).collect()}
        total, reached = sum(counts.values()), 0
        for place in range(lists):
            reached += counts.get(place, 0)
            if reached >= TARGET * total:
                return place + 1
        return lists

    # --- changes
    def add(self, df: DataFrame, *, key: str = "id", embedding: str = "embedding", token: str | None = None) -> None:
        """New vectors, and new ones of known keys in place of the old: one segment, nothing is fitted again."""
        s = self.segments.snapshot()
        centroids, _ = self._model(s)
        rows = _nearest_lists(_usable(df, embedding, s.meta["dimension"]), key, embedding, centroids, 1).drop("place")
        self.segments.write({"lists": rows}, df.select(F.col(key).alias("id")), token=token)

    def delete(self, keys: DataFrame, *, key: str = "id") -> None:
        self.segments.delete(keys.select(F.col(key).alias("id")))

    def compact(self) -> None:
        self.segments.compact()

    def vectors(self, lists: Sequence[int] | None = None) -> DataFrame:
        """id, vector and list of the live rows; of some lists only their folders are read."""
        only = None if lists is None else lambda df: df.where(F.col("list").isin(*map(int, lists)))
        return self.segments.read("lists", only)

    # --- searches
    def search(self, queries: DataFrame, k: int, *, key: str = "id", embedding: str = "embedding", probes: int | None = None, places: bool = False) -> DataFrame:
        """query_id, rank (from 1), id and cosine score of the k nearest rows of each query within its probed lists.

        With ``places`` also the place of the neighbour's list among the query's. Queries without a usable vector have no rows.
        """
        s = self.segments.snapshot()
        centroids, usual = self._model(s)
        asked = _nearest_lists(_usable(queries, embedding, s.meta["dimension"]), key, embedding, centroids, probes or usual)
        few = asked.select("list").distinct().limit(NAMED * len(centroids)).collect() if queries.limit(NAMED + 1).count() <= NAMED else None
        stored = self.vectors(None if few is None else [r["list"] for r in few])
        # lists in blocks of VECTORS rows, the queries of a list in blocks of QUERIES: every block of the one meets every block of the other
        size = stored.groupBy("list").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("blocks")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "list")
        spread = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        kind = queries.schema[key].dataType
        small = F.broadcast(size)  # at most MOST_LISTS rows
        a = asked.join(small, "list").select(F.lit(True).alias("query"), F.col("id").cast(kind), "vector", "list", "place", every("blocks").alias("block"), spread("id", "parts").alias("part"))
        b = stored.join(small, "list").select(F.lit(False).alias("query"), F.col("id").cast(kind), "vector", "list", F.lit(0).alias("place"), spread("id", "blocks").alias("block"), every("parts").alias("part"))
        schema = f"query_id {kind.simpleString()}, id {kind.simpleString()}, score double, place int"
        found = a.unionByName(b).groupBy("list", "block", "part").applyInArrow(lambda t: _top(t, k), schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))
        out = found.withColumn("rank", rank).where(F.col("rank") <= k)
        return out.select("query_id", F.col("rank").cast("int"), "id", "score", *(["place"] if places else []))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact neighbours (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
