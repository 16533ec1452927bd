"""Exact spectra against known ones, and whitened vectors against plain numpy and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fieldpulse.llm import charpoly, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, key int"


def scatter(rows):
    x = np.array(rows, object)
    s = x.sum(0)
    return [[int(v) for v in r] for r in len(x) * x.T.dot(x) - np.outer(s, s)]


def polynomial(m):
    """Characteristic polynomial by Faddeev and LeVerrier in fractions."""
    d = len(m)
    a, c = np.array([[Fraction(v) for v in r] for r in m], object), [Fraction(1)]
    now = np.array([[Fraction(i == j) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        now = a.dot(now)
        c.append(-sum(now[i, i] for i in range(d)) / k)
        for i in range(d):
            now[i, i] += c[-1]
    return [int(v) for v in reversed(c)]


@pytest.mark.parametrize("d, n, span", [(1, 5, 9), (2, 9, 3), (5, 30, 50), (7, 4, 9), (12, 40, 10 ** 12)])
def test_polynomial_is_exact(d, n, span):
    m = scatter(np.random.default_rng(d).integers(-span, span, (n, d)).tolist())
    assert charpoly.characteristic_polynomial(m) == polynomial(m)


def test_spectra_with_equal_and_zero_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(6, 6)))
    reflect = [[9 * (i == j) * 2 - 4 for j in range(3)] for i in range(3)]  # eigenvalues 18, 18 and 6
    shares, vectors = charpoly.eigen(reflect, 16)
    assert np.allclose(shares, [18 / 42, 18 / 42, 6 / 42], rtol=1e-15)
    assert np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(3), atol=1e-15)
    assert charpoly.eigen([[0, 0], [0, 0]], 2) == ([], []) and charpoly.eigen([], 2) == ([], [])
    assert [s for s in charpoly.eigen([[4, 0], [0, 0]], 2)[0]] == [1.0]
    near = [[10 ** 15 + 1, 0, 1], [0, 10 ** 15, 0], [1, 0, 10 ** 15 - 1]]  # gaps far below double precision
    shares, vectors = charpoly.eigen(near, 3)
    half = Fraction(math.isqrt(2 * 10 ** 60), 10 ** 30)  # eigenvalues: 10**15 and 10**15 +- sqrt(2)
    top = np.array([float(1 + half), 0, 1]) / math.hypot(float(1 + half), 1)
    assert abs(abs(np.dot(vectors[0], top)) - 1) < 1e-15 and abs(abs(vectors[1][1]) - 1) < 1e-15


def plain(rows):
    """``{vec_id: (deviation, {component: |whitened|}, shares)}`` with numpy's own eigenvectors."""
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for k, v in good]
    fit = np.array(sorted({x for _, x in whole}), object)
    n, s = len(fit), fit.sum(0)
    v = np.array(scatter(fit.tolist()), float) / n ** 2
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    out = []
    for k, x in whole:
        off = n * np.array(x, object) - s
        out.append((k, int((off * off).sum()), (off / n).astype(float) @ axes / np.sqrt(e), e / np.trace(v)))
    return n, out


def write(spark, path, rows):
    spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], SCHEMA).write.parquet(f"{path}/embeddings.parquet")


def test_query_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(20, 20)) * np.linspace(2, 0.1, 20)
    rows = [(i, (rng.normal(size=20) @ mix / 8).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (5, rows[5][1]), (None, rows[7][1]), (301, None), (302, [None] + rows[1][1][1:]), (303, [math.nan] + rows[1][1][1:]),
             (304, [math.inf] + rows[1][1][1:]), (305, [1.0, 2.0])]
    write(spark, tmp_path, rows)
    frame = queries.op11_whitening(spark, str(tmp_path))
    assert dict(frame.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                  "whitened": "double", "explained": "double", "identity_error": "double"}
    got = frame.collect()
    n, want = plain(rows[:-1])
    assert len(got) == 16 * len(want) and {r.n for r in got} == {n} == {300}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    ours = {}
    for r in got:
        ours.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for k, deviation, w, shares in want:
        for c in range(1, 17):
            for r in ours[k, c]:
                assert r.deviation == deviation or k is None
                assert abs(r.explained - shares[c - 1]) < 1e-12
                if k is not None and abs(w[c - 1]) > 1e-3:
                    sign = signs.setdefault(c, math.copysign(1, w[c - 1] * r.whitened))
                    assert abs(sign * r.whitened - w[c - 1]) < 1e-8


def test_large_entries_stay_exact(spark, tmp_path):
    rows = [(i, [float(2.0 ** 40 * (i % 5)), float(i), float(-i * i)]) for i in range(1, 60)]
    write(spark, tmp_path, rows)
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, str(tmp_path)).collect()}
    _, want = plain(rows)
    model, vectors = whitening.fit(whitening.quantised(spark.read.parquet(f"{tmp_path}/embeddings.parquet")))
    exact = {r.key: int(r.deviation) for r in whitening.whiten(vectors, model).collect()}
    for k, deviation, _, shares in want:
        assert exact[k] == deviation
        assert got[k, 1].deviation == (deviation if deviation < 1 << 63 else None)
        assert abs(got[k, 1].explained - shares[0]) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5]), (2, [0.5])]])
def test_tables_without_variance_give_no_rows(spark, tmp_path, rows):
    write(spark, tmp_path, rows)
    assert queries.op11_whitening(spark, str(tmp_path)).count() == 0


def test_rank_below_sixteen(spark, tmp_path):
    write(spark, tmp_path, [(1, [0.0, 0.0, 1.0]), (2, [0.0, 0.5, 1.0]), (3, [0.0, 0.5, 1.0])])
    got = queries.op11_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got) == [
        (1, 1, 2, 32 ** 2, 1.0, 1.0), (2, 1, 2, 32 ** 2, 1.0, 1.0), (3, 1, 2, 32 ** 2, 1.0, 1.0)]
