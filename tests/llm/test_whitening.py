from __future__ import annotations

import numpy as np
import pytest

from xrel.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, n string, component string, x string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def plain(vectors, most=4):
    """Rows (index, component, n, deviation, whitened, explained), signs as numpy has them."""
    whole = [(i, [int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v]) for i, v in enumerate(vectors) if v and all(c is not None and np.isfinite(c) for c in v)]
    if not whole:
        return []
    x = np.array([v for _, v in whole], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    off = fit - s / n
    cov = off.T @ off / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    k = min(most, int((e > 1e-12 * max(e[0], 1e-300)).sum()))
    out = []
    for (i, _), row in zip(whole, x, strict=True):
        deviation = sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True))
        for c in range(k):
            out.append((i, c + 1, n, deviation, float((row - s / n) @ w[:, c] / np.sqrt(e[c])), float(e[c] / np.trace(cov))))
    return out


def compared(spark, vectors):
    got = sorted(tuple(r) for r in W.whitened_embeddings(table(spark, vectors)).collect())
    want = plain(vectors)
    assert [(g[0], g[1], g[2], int(g[3])) for g in got] == [w[:4] for w in want]
    for c in {w[1] for w in want}:
        mine, other = (np.array([(r[4], r[5]) for r in rows if r[1] == c]) for rows in (got, want))
        sign = 1 if (mine[:, 0] * other[:, 0]).sum() > 0 else -1
        assert np.allclose(sign * mine[:, 0], other[:, 0], atol=1e-7) and np.allclose(mine[:, 1], other[:, 1], rtol=1e-9)
    assert all(g[6] < 1e-6 for g in got)


def vectors(n, scales, seed=0):
    return (np.random.default_rng(seed).normal(size=(n, len(scales))) * scales).astype(np.float32).tolist()


def test_against_eigenvectors(spark):
    some = vectors(200, [5, 3, 2, 1, 0.5, 0.2])
    bad = [None, [], [1.0, None, 0.0], [float("nan"), 0.0], [0.0, float("inf")]]
    compared(spark, [*some, *bad, *([some[3]] * 90), *([[-0.0] * 6] * 20)])


def test_hard_spectra(spark):
    compared(spark, vectors(300, [1e5, 1e2, 1.0, 0.5, 0.01]))
    # Without full rank: a constant entry, and one that repeats another.
    base = np.array(vectors(100, [4, 2, 1]))
    compared(spark, np.column_stack([base, base[:, 0], np.full(100, 7.0)]).tolist())
    # Fewer vectors than dimensions.
    compared(spark, vectors(3, [3, 2, 1, 1, 1, 1]))


def test_edges(spark):
    assert W.whitened_embeddings(table(spark, [])).count() == 0
    assert W.whitened_embeddings(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert W.whitened_embeddings(table(spark, [None, [None]])).count() == 0
    # Another length than most have; rows without id and with the same id stay apart.
    mixed = [[1.0, 2.0], [2.0, 1.0], [3.0, 5.0], [1.0], [1.0, 2.0, 3.0]]
    got = W.whitened_embeddings(table(spark, mixed, [None, 7, 7, 8, 9])).where("component = 1").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 7), (False, 7), (True, 0)] and {r.n for r in got} == {3}


def test_exact_deviations():
    learnt = W.Whitening(2, 10**7, [5 * 10**15, -(10**15)], np.eye(2), np.ones(2), 1.0, 3)
    x = np.array([[2**31, -(2**31)], [3, 4]])
    assert [int(v) for v in learnt.deviations(x).to_pylist()] == [sum((10**7 * int(v) - s) ** 2 for v, s in zip(r, learnt.sums, strict=True)) for r in x]


def test_sums_beyond_64_bits(spark):
    rows = spark.createDataFrame([([2**62, -(2**62), -1],)] * 5, "x array<bigint>").repartition(3)
    assert W._exact_sums(rows, 3) == [5 * 2**62, -5 * 2**62, -5]


@pytest.mark.parametrize("shape", [(40, 7), (500, 5)])
def test_passes_end_early_with_full_rank(spark, shape):
    rows = np.unique(np.random.default_rng(2).integers(-500, 500, shape), axis=0)
    fit = spark.createDataFrame([(r,) for r in rows.tolist()], "x array<bigint>")
    assert W.fitted(fit, shape[1], len(rows)).passes == W.LEAST_PASSES
