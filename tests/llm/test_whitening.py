"""Whitening against numpy on the whole table, and its odd rows."""

from __future__ import annotations

import math

import numpy as np
from gleanline.llm import op13_whitening as op

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "clash", 1) for k, v in vectors], SCHEMA).repartition(3)


def want(vectors, k):
    x = np.floor(64 * np.array([v for _, v in vectors], dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    z = (n * fit - total) / n
    cov = z.T @ z / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(1), (n * x - total) / n @ parts / np.sqrt(values), values / np.trace(cov)


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.3
    vectors = [(k, [float(c) for c in v]) for k, v in enumerate(base)] + [(1000 + k, [float(c) for c in base[0]]) for k in range(150)]
    odd = [(5000, None), (5001, []), (5002, [None] + [0.0] * 19), (5003, [math.nan] * 20), (5004, [math.inf] * 20), (5005, [0.0] * 19), (5006, [3e38] * 20), (None, vectors[0][1])]
    rows = op.whiten(frame(spark, vectors + odd)).collect()
    n, deviation, whitened, explained = want(vectors, op.COMPONENTS)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == 16 * 451 and set(by) == {(v, j) for v in [*dict(vectors), None] for j in range(1, 17)}
    mine = np.array([[by[v, j].whitened for j in range(1, 17)] for v, _ in vectors])
    assert np.allclose(mine * np.sign((mine * whitened).sum(0)), whitened, atol=1e-9)
    assert [by[v, 1].deviation for v, _ in vectors] == deviation.tolist()
    assert np.allclose([by[0, j].explained for j in range(1, 17)], explained, rtol=1e-10)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_few_vectors_have_components_without_variance(spark):
    vectors = [(1, [0.5, 0.25, 1.0, 0.0]), (2, [0.5, 0.75, 1.0, 0.0]), (3, [0.0, 0.0, 9.0, 0.0])]
    rows = sorted(op.whiten(frame(spark, vectors)).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(rows) == 12 and [r.whitened is None for r in rows[:4]] == [False, False, True, True] and rows[3].explained == 0
    assert rows[0].identity_error < 1e-9
    same = op.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, None)}


def test_deviations_beyond_a_long_are_null(spark):
    rows = op.whiten(frame(spark, [(1, [6e13, 0.0]), (2, [-6e13, 1.0]), (3, [0.0, 0.0])])).collect()
    assert len(rows) == 6 and {r.deviation for r in rows if r.vec_id == 1} == {None}


def test_empty_table(spark):
    assert op.whiten(frame(spark, [])).collect() == []
    assert op.whiten(frame(spark, [(1, None), (2, [])])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
