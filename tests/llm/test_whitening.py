"""Eigensolver and whitening against numpy's dense solver."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening


@pytest.mark.parametrize("size, rows, wanted", [(120, 900, 6), (64, 300, 32), (40, 15, 32), (3, 50, 8), (1, 5, 4)])
def test_eigenvectors_to_double_precision(size, rows, wanted):
    draw = np.random.default_rng(size)
    z = draw.standard_normal((rows, size)) / np.sqrt(np.arange(1, size + 1))
    z -= z.mean(axis=0)
    v = z.T @ z / rows
    values, vectors = whitening.jacobi_davidson(lambda b: z.T @ (z @ b) / rows, size, wanted)
    best = np.linalg.eigvalsh(v)[::-1][:wanted]
    assert np.abs(values - best).max() <= 1e-13 * best[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * best[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_repeated_eigenvalues_and_large_spaces():
    d = np.concatenate([np.full(5, 3.0), np.linspace(2, 1, 195)])
    products = []
    values, vectors = whitening.jacobi_davidson(lambda b: (products.append(b.shape[1]), d[:, None] * b)[1], 200, 7)
    assert np.allclose(values, [3] * 5 + d[5:7].tolist(), atol=1e-12)
    assert max(products) < 20  # never the whole operator


def test_minres_solves_indefinite_systems():
    draw = np.random.default_rng(2)
    a = draw.standard_normal((30, 30))
    a = a + a.T
    right = draw.standard_normal((30, 3))
    got = whitening.minres(lambda x: a @ x, right, 200, 1e-12)
    assert np.linalg.norm(a @ got - right) < 1e-6


def brute(rows, components):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, size = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(size)]
    dev = [[n * r[d] - s[d] for d in range(size)] for r in x]
    z = np.array([[d / n for d in r] for r in dev])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return [i for i, _ in kept], [sum(d * d for d in r) for r in dev], z @ q / np.sqrt(e), e / np.trace(v)


def against(spark, rows, components=32):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, block string").repartition(3)
    got = whitening.whiten(frame, components).collect()
    ids, deviations, whitened, explained = brute(rows, components)
    by_row = {}
    for r in got:
        by_row.setdefault((str(r.vec_id), int(r.deviation_exact)), []).append(r)
    assert sum(map(len, by_row.values())) == len(ids) * len(explained)
    sign = np.zeros(len(explained))
    for i, d, w in zip(ids, deviations, whitened):
        for r in by_row[str(i), d]:
            k = r.component - 1
            sign[k] = sign[k] or np.sign(w[k] * r.whitened)
            assert abs(w[k] - sign[k] * r.whitened) < 1e-8 and r.n == len(ids)
            assert r.deviation == (d if d < 1 << 63 else None)
            assert abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-10
    return got


def test_whitening(spark):
    draw = np.random.default_rng(4)
    rows = [(k, (draw.standard_normal(12) * np.linspace(3, 1, 12)).tolist()) for k in range(150)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, None), (501, [1.0] * 11 + [None]), (502, [math.nan] + [1.0] * 11), (503, [math.inf] * 12)]
    against(spark, rows)
    assert {r.component for r in against(spark, rows, 5)} == {1, 2, 3, 4, 5}


def test_integers_beyond_a_long(spark):
    draw = np.random.default_rng(5)
    got = against(spark, [(k, (draw.standard_normal(3) * [1e12, 1e11, 1e10]).tolist()) for k in range(40)])
    assert any(r.deviation is None for r in got)


def test_nothing_to_whiten(spark):
    def of(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    assert whitening.whiten(of([])).count() == 0
    assert whitening.whiten(of([(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(of([(k, [float(k), 2.0 * k]) for k in range(6)] + [(9, [1.0])])).collect()  # one direction, one other length
    assert {r.component for r in line} == {1} and len(line) == 6 and all(abs(r.explained - 1) < 1e-9 for r in line)
