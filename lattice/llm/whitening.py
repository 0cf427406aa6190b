"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration over distributed passes.

A vector's entries c become integers x = floor(256 c). The fit list holds each distinct x once and is
stored; every pass over it adds up centred XᵀXQ for a thin block Q, task by task, and sums the
tasks' blocks in a tree, so that the driver sees at most FAN blocks of dimension x BLOCK numbers.
The covariance itself is never formed. A polynomial recurrence of such passes damps the unwanted part
of the spectrum, QR and Rayleigh-Ritz follow, until the residuals of the wanted components certify them.

Defined results: vectors that are null, empty, or hold null or non-finite entries (or entries whose
x is no long) are dropped, and so are vectors of another length than the commonest of the distinct
ones (ties: the longer). Rows with a null id and rows of one id stay as they are. Components without
variance are not returned, so that equal vectors, a single one and an empty table give no rows. A
deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import prepare, scratch, table

#: Columns of the block: the wanted components and guards.
BLOCK = 32
#: Most blocks that one task or the driver adds up.
FAN = 64
#: Certified residual relative to the largest eigenvalue, the bound below which stagnation counts as certified, and the passes after which it is an error.
TOLERANCE, ACCEPTED, MOST_PASSES = 2e-15, 1e-12, 400
#: Largest degree of a filter, and the largest ratio of amplifications in it.
DEGREE, RATIO = 12, 1e10
#: Vectors handled at once in a task.
ROWS = 8192

Kernel = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """What was fitted: the fit list's size and exact sums, components as columns, eigenvalues, and checks."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(vector: str) -> tuple[Column, Column]:
    """Whether a vector is usable, and its entries as integers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= 2.0**55)
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)
    return fit, F.transform(vector, lambda c: F.floor(c.cast("double") * 256))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _tree_sum(rows: DataFrame, kernel: Kernel, dtype: str) -> np.ndarray | None:
    """The sum of ``kernel`` over all batches of ``rows``: one block from each task, added in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in _slices(b):
                part = kernel(_matrix(s, "x"))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.astype(dtype).tobytes()], pa.binary())], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("v"):
                part = np.frombuffer(v.as_py(), dtype)
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts, tasks = rows.mapInArrow(partial, "v binary"), rows.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(add, "v binary")
    blocks = [np.frombuffer(r["v"], dtype) for r in parts.collect()]
    return sum(blocks[1:], blocks[0]) if blocks else None


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums: entries are cut in three limbs, whose sums fit in a long up to 2**41 vectors."""

    def kernel(x: np.ndarray) -> np.ndarray:
        low = (1 << 21) - 1
        return np.concatenate([[len(x)], (x & low).sum(0), ((x >> 21) & low).sum(0), (x >> 42).sum(0)])

    found = _tree_sum(rows, kernel, "<i8")
    if found is None:
        return 0, []
    a, b, c = (list(map(int, p)) for p in np.split(found[1:], 3))
    return int(found[0]), [x + (y << 21) + (z << 42) for x, y, z in zip(a, b, c, strict=True)]


def _degree(residual: float, at: float, top: float) -> int:
    """Degree that takes the residual to the tolerance; ``at`` and ``top`` are the last wanted and the largest eigenvalue on the filter's scale."""
    slow, fast = np.arccosh(max(at, 1 + 1e-9)), np.arccosh(max(top, 1 + 1e-9))
    need = np.log(max(residual / TOLERANCE, 2.0)) / slow
    most = np.log(RATIO) / max(fast - slow, 1e-9)
    return int(np.clip(np.ceil(min(need, most)), 2, DEGREE))


def _leading(times: Callable[[np.ndarray], np.ndarray], d: int, components: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(vectors, values, relative residual, passes) of the operator ``times``, of which a pass is one call."""
    k = min(d, max(BLOCK, 2 * components))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, k)))[0]
    w, passes, low, before = times(q), 1, np.inf, np.inf
    while True:
        h = q.T @ w
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, w = q @ u, w @ u
        if values[0] <= 0:
            return q[:, :0], values[:0], 0.0, passes
        residual = float(np.linalg.norm(w[:, :components] - q[:, :components] * values[:components], axis=0).max() / values[0])
        if residual <= TOLERANCE or k == d or (residual <= ACCEPTED and residual > before / 2):
            return q[:, :components], values[:components], residual, passes
        if passes >= MOST_PASSES:
            raise ArithmeticError(f"components are not certified after {passes} passes: residual {residual:.1e}")
        before = residual
        # what is damped: from the least Ritz value seen to one of the guards
        low, high = min(low, max(values[-1], 0.0)), values[min(components, k - 1) + 3 * (k - 1 - min(components, k - 1)) // 4]
        centre, half = (low + high) / 2, max((high - low) / 2, 1e-9 * values[0])
        last = values[min(components, k) - 1]
        degree = _degree(residual, (last - centre) / half, (values[0] - centre) / half)
        sigma = half / (values[0] - centre)
        tau = 2 / sigma
        old, now = q, (w - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (tau - sigma)
            old, now = now, (times(now) - centre * now) * (2 * following / half) - (sigma * following) * old
            sigma, passes = following, passes + 1
        q = np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), 1e-300))[0]
        w, passes = times(q), passes + 1


def fit(df: DataFrame, *, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """The leading components of the distinct vectors of ``df``; None if there is no usable vector.

    The fit list is written to scratch once and read by every pass.
    """
    spark = df.sparkSession
    prepare(spark)
    usable, x = integers(vector)
    path = scratch(spark, "whitening")
    df.where(usable).select(x.alias("x")).distinct().write.parquet(path)
    stored = spark.read.parquet(path)
    size = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    rows, d = stored.where(F.size("x") == size["d"]), size["d"]
    n, sums = _sums(rows)
    mean = np.array([s / n for s in sums])

    def times(q: np.ndarray) -> np.ndarray:
        def kernel(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return (c.T @ (c @ q)).ravel()

        return _tree_sum(rows, kernel, "<f8").reshape(q.shape) / n

    trace = float(_tree_sum(rows, lambda x: np.array([((x - mean) ** 2).sum()]), "<f8")[0] / n)
    if trace <= 0:
        return Whitening(n, tuple(sums), np.empty((d, 0)), np.empty(0), 0.0, 0.0, 0.0, 0)
    vectors, values, residual, passes = _leading(times, d, components)
    real = values > d * np.finfo(float).eps * values[0]
    vectors, values = vectors[:, real], values[real]
    scale = vectors / np.sqrt(values)
    c = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scale
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    m = _tree_sum(rows, moments, "<f8") / n
    error = float(np.abs(m[: c * c].reshape(c, c) - np.outer(m[c * c :], m[c * c :]) - np.eye(c)).max())
    return Whitening(n, tuple(sums), vectors, values, trace, error, residual, passes + 3)


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exact; null beyond a long."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if len(sums) * most**2 < 2**63:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1).tolist()
    return [v if v < 2**63 else None for v in exact]


def transform(df: DataFrame, model: Whitening | None, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every usable row of ``df``."""
    prepare(df.sparkSession)
    usable, x = integers(vector)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [df.schema[key].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(a, b) for a, b in zip(names, kinds, strict=True)])
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], schema)
    n, sums, mean, c, error = model.n, model.sums, model.mean, len(model.eigenvalues), model.identity_error
    scale, explained = model.components / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _slices(b):
                x = _matrix(s, "x")
                rows = len(x)
                columns = [
                    s.column("id").take(pa.array(np.repeat(np.arange(rows), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows)), pa.array(np.full(rows * c, n, np.int64)),
                    pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), c))), pa.array(np.einsum("ij,jk->ik", x - mean, scale).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * c, error)),
                ]
                yield pa.record_batch(columns, names)

    rows = df.where(usable & (F.size(vector) == len(sums))).select(F.col(key).alias("id"), x.alias("x"))
    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``df`` fitted and transformed."""
    return transform(df, fit(df, vector=vector, components=components), key=key, vector=vector)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
