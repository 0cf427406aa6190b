"""Whitening against numpy's own eigenvectors, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.llm import whitening as W

DDL = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0) for k, v in rows], DDL)


def reference(rows):
    x = np.unique(np.floor(256 * np.array(rows, np.float32).astype(float)).astype(np.int64), axis=0)
    v = np.cov(x.T, bias=True)
    e, q = np.linalg.eigh(v)
    return x, e[::-1], q[:, ::-1], np.trace(v)


@pytest.mark.parametrize("d", [3, 6, 40, 70])
def test_whitened_equals_numpy(spark, d):
    rng = np.random.default_rng(d)
    rows = (rng.standard_normal((300, d)) * np.linspace(1, 2, d)).astype(np.float32).tolist()
    rows += rows[:50] * 4  # copies do not weigh
    df = frame(spark, list(enumerate(rows))).repartition(70)  # more tasks than one task adds up
    model = W.fit(df)
    x, e, q, trace = reference(rows)
    c = min(4, d)
    assert model.n == len(x) and model.sums == tuple(x.sum(0).tolist()) and len(model.eigenvalues) == c
    assert np.allclose(model.eigenvalues, e[:c], rtol=1e-12) and abs(model.trace / trace - 1) < 1e-12 and model.identity_error < 1e-9
    assert np.allclose(np.abs((q[:, :c] * model.components).sum(0)), 1, atol=1e-12)
    got = {(r["vec_id"], r["component"]): r for r in W.transform(df, model).collect()}
    assert len(got) == len(rows) * c
    own = np.floor(256 * np.array(rows, np.float32).astype(float)).astype(np.int64)
    sign = np.sign((q[:, :c] * model.components).sum(0))
    want = (own - x.sum(0) / len(x)) @ (q[:, :c] * sign) / np.sqrt(e[:c])
    deviation = ((len(x) * own - x.sum(0)) ** 2).sum(1)
    for k in range(len(rows)):
        for j in range(c):
            r = got[k, j + 1]
            assert abs(r["whitened"] - want[k, j]) < 1e-9 and r["deviation"] == deviation[k] and abs(r["explained"] - e[j] / trace) < 1e-12


def test_close_eigenvalues_are_certified(spark):
    """Leading values that differ in the third digit, one far larger, and a tail of zeros."""
    rng = np.random.default_rng(2)
    d = 48
    scale = np.concatenate([[400], 20 + 0.02 * np.arange(20)[::-1], np.zeros(27)])
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    rows = ((rng.standard_normal((3000, d)) * scale) @ basis.T / 256 * 16).astype(np.float32).tolist()
    model = W.fit(frame(spark, list(enumerate(rows))))
    x, e, q, _ = reference(rows)
    assert model.residual <= W.ACCEPTED and np.allclose(model.eigenvalues, e[:4], rtol=1e-11) and model.identity_error < 1e-9
    v = np.cov(x.T, bias=True)
    assert np.abs(v @ model.components - model.components * model.eigenvalues).max() <= 1e-11 * e[0]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []), (None, [0.5, -0.25]), (0, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [3e38, 0.0]), (9, [-0.0, 1.0])]
    df = frame(spark, rows).withColumn("x", F.lit("clash")).withColumn("component", F.lit(1))
    got = W.whiten(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted([(False, 0, c) for c in (1, 2)] * 2 + [(False, k, c) for k in (1, 9) for c in (1, 2)] + [(True, 0, 1), (True, 0, 2)])
    assert {r["n"] for r in got} == {3} and all(np.isfinite(r["whitened"]) for r in got)
    same = {(r["component"], r["whitened"]) for r in got if r["vec_id"] in (1, 9)}
    assert len(same) == 2  # negative zero is zero
    # no variance, one vector, none
    assert W.whiten(frame(spark, [(0, [1.0, 2.0])] * 5)).count() == 0 == W.whiten(frame(spark, [])).count() == W.whiten(frame(spark, [(1, None)])).count()
    # one direction of variance gives one component
    line = W.whiten(frame(spark, [(k, [float(k), 2.0 * k, -3.0 * k]) for k in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_large_sums_stay_exact(spark):
    big = [float(2**40 + 7 * k) for k in range(3)]
    df = spark.createDataFrame([(k, [v, -v, 1.0]) for k, v in enumerate(big)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    model = W.fit(df)
    x = [[int(256 * v), -int(256 * v), 256] for v in big]
    assert model.sums == tuple(sum(c) for c in zip(*x, strict=True))
    got = {r["vec_id"]: r["deviation"] for r in W.transform(df, model).where("component = 1").collect()}
    assert got == {k: sum((3 * a - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for k, row in enumerate(x)}
    far = spark.createDataFrame([(0, [2.0**50]), (1, [-(2.0**50)])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert {r["deviation"] for r in W.whiten(far).collect()} == {None}
