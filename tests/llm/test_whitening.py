"""Whitening against numpy's eigendecomposition of the whole covariance."""

import math
import random

import numpy as np
import pytest

from flowsentry.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x long, component string"


def rows_of(seed=1, n=400, width=12):
    rng = random.Random(seed)
    scale = [3 / (1 + i) for i in range(width)]
    rows = [(i, [rng.gauss(0.1 * i % 3, s) for s in scale]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]            # one vector on a third of all rows
    rows += [(5, rows[5][1]), (None, rows[6][1]), (7, rows[8][1])]  # repeated and null ids
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [math.nan] + rows[0][1][1:]),
             (2003, [math.inf] + rows[0][1][1:]), (2004, []), (2005, rows[0][1][1:]), (2006, [-0.0] * width)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, 2, 3, "c") for i, v in rows], SCHEMA).repartition(parts)


def expected(rows, width, components=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, mean = len(x), x.mean(0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sums = [sum(int(v) for v in col) for col in x.T]
    out = []
    for i, v in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        y = (np.array(v) - mean) @ vectors / np.sqrt(values)
        out += [(i, c + 1, n, deviation, y[c], values[c] / ((x - mean) ** 2).sum() * n) for c in range(components)]
    return out


def compare(got, want):
    plain = lambda r: (str(r[0]), r[1], r[3])
    got = sorted([(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got], key=plain)
    want = sorted(want, key=plain)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == c]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)


def test_whitening_equals_the_whole_decomposition(spark):
    got = w.whiten(frame(spark, rows_of())).collect()
    compare(got, expected(rows_of(), 12))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_cut_spectra_are_refined_over_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(w, "DIRECTIONS", 5)
    compare(w.whiten(frame(spark, rows_of(2)), components=3).collect(), expected(rows_of(2), 12, 3))


def test_degenerate_tables(spark):
    one = w.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = w.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert line[0].identity_error < 1e-12
    huge = w.whiten(frame(spark, [(i, [float(i << 40), 1.0]) for i in range(9)]), components=1).collect()
    assert {r.vec_id: r.deviation for r in huge} == {i: 0 if i == 4 else None for i in range(9)}
    for none in (frame(spark, rows_of()).limit(0), frame(spark, [(1, None), (2, [])])):
        assert w.whiten(none).isEmpty()


@pytest.mark.parametrize("kind", ["normal", "few", "equal", "flat", "copies"])
def test_rank_one_updates_keep_the_scatter_matrix(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(0, 40, (300, 16)), "few": rng.normal(0, 1, (7, 16)), "equal": np.repeat(np.eye(8), 4, 0),
         "flat": np.zeros((9, 4)), "copies": np.repeat(rng.integers(-3, 3, (12, 6)), 5, 0) * [1, 1, 1e5, 1e-3, 0, 1]}[kind]
    parts = [w.Spectrum.of_none(x.shape[1]) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    for p in parts[1:]:
        parts[0].join(p)
    got, away = parts[0], x - x.mean(0)
    scatter = away.T @ away
    assert np.allclose(got.basis @ got.basis.T, np.eye(len(got.basis)), atol=1e-12)
    assert np.allclose(got.basis.T @ np.diag(got.values) @ got.basis, scatter, atol=1e-11 * max(1, np.abs(scatter).max()))
    assert np.allclose(got.mean, x.mean(0)) and got.n == len(x)


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 20):
        for tiny in (1, 1e-6):
            d, z = np.sort(rng.random(k)) * 10, rng.normal(0, 1, k) * np.where(rng.random(k) < 0.5, tiny, 1)
            roots, gaps = w.secular_roots(d, z)
            assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-11)
            assert np.allclose(gaps, d - roots[:, None], atol=1e-12)
