"""Whitening against eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidegauge.llm import queries, whitening
from conftest import DATA
from test_llm import importable, table  # noqa: F401

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def entries(vector):
    return None if vector is None or any(c is None or not math.isfinite(c) for c in vector) else [math.floor(1024 * c) + 100000 for c in vector]


def brute(rows, most=8):
    """(ids, exact deviations, whitened, shares) by numpy's eigenvectors of the covariance."""
    ids, x = zip(*((i, e) for i, v in rows if (e := entries(v)) is not None))
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = min(most, len(values))
    return list(ids), deviations, centred @ vectors[:, :used] / np.sqrt(values[:used]), values[:used] / values.sum()


def collected(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.vec_id, []).append(r)
    return {i: sorted(rows, key=lambda r: r.component) for i, rows in found.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    df = queries.op13_whitening(spark, str(DATA / sf))
    assert df.columns == COLUMNS
    got = collected(df)
    ids, deviations, want, shares = brute([(r.vec_id, r.embedding) for r in table(spark, "embeddings", sf).collect()])
    assert sorted(got) == sorted(ids)
    mine = np.array([[r.whitened for r in got[i]] for i in ids])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-9
    for i, deviation in zip(ids, deviations):
        assert [(r.component, r.n, r.deviation) for r in got[i]] == [(k + 1, len(ids), deviation) for k in range(8)]
    assert np.allclose([r.explained for r in got[ids[0]]], shares, rtol=1e-10)
    errors = {r.identity_error for rows in got.values() for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-10


def made(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, row string, component string").repartition(4)


def test_odd_rows(spark):
    """NULLs, non-finite entries, other lengths and repeated rows; columns named like inner ones."""
    draw = np.random.Generator(np.random.PCG64(2))
    rows = [(i, draw.normal(size=3).tolist(), "r", "c") for i in range(40)] + [(7, [0.5, 0.25, -0.75], "r", "c")] * 50
    wrong = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (None, None)]
    vectors = made(spark, rows + [(i, v, None, None) for i, v in wrong])
    model = whitening.fit(vectors)
    out = whitening.whiten(vectors, model, keep=["vec_id", "row", "component"])
    assert out.columns == ["vec_id", "row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [(r[0], r[1]) for r in rows]
    ids, deviations, want, shares = brute(kept)
    assert model.n == len(kept) and np.allclose(model.variances / model.trace, shares, rtol=1e-12) and model.identity_error < 1e-12
    got = out.collect()
    assert len(got) == 3 * len(kept) and {r.row for r in got} == {"r"}
    assert sorted({(r.vec_id, r.deviation) for r in got}) == sorted(set(zip(ids, deviations)))
    assert not any(r.vec_id is None or r.vec_id >= 90 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, [])]])
def test_nothing_varies(spark, rows):
    vectors = made(spark, [(i, v, None, None) for i, v in rows])
    model = whitening.fit(vectors)
    assert model.components.shape[1] == 0 and model.identity_error == 0.0
    assert whitening.whiten(vectors, model).count() == 0


def test_badly_conditioned(spark):
    """Variances twenty powers of ten apart, with a repeated and a constant dimension that have no component."""
    draw = np.random.Generator(np.random.PCG64(4))
    scales = np.array([1e8, 1e3, 1.0, 1e-2])
    x = np.floor(draw.normal(size=(400, 4)) * scales * 1024) / 1024
    x = np.concatenate([x, x[:, :1], np.full((400, 1), 3.0)], axis=1)
    model = whitening.fit(made(spark, [(i, r.tolist(), None, None) for i, r in enumerate(x)], "double"))
    assert model.components.shape == (6, 4) and model.identity_error < 1e-6
    # The exact eigenvalues of what the two equal dimensions leave, by singular values of the centred rows.
    centred = np.floor(x * 1024) - np.floor(x * 1024).mean(axis=0)
    assert np.allclose(np.sqrt(model.variances), np.linalg.svd(centred, compute_uv=False)[:4] / 20, rtol=1e-6)


def test_large_entries(spark):
    """Deviations beyond a long are NULL; entries that are no exact whole number any more are left out."""
    vectors = made(spark, [(1, [2.0**40, 0.0], "", ""), (2, [0.0, 1.0], "", ""), (3, [1.0, 3.0], "", ""), (4, [1e300, 0.0], "", "")], "double")
    model = whitening.fit(vectors)
    got = whitening.whiten(vectors, model).collect()
    assert model.n == 3 and {r.vec_id for r in got} == {1, 2, 3} and {r.deviation for r in got} == {None}


def test_triangular_solve():
    draw = np.random.Generator(np.random.PCG64(1))
    for d in (1, 2, 7, 33):
        r = np.triu(draw.normal(size=(d, d))) + 5 * np.eye(d)
        x = draw.normal(size=(11, d))
        assert np.allclose(whitening.solve_upper(r, x) @ r, x)


def test_passes_orthogonalise(spark):
    """A wide table: one more pass than the shifted one is needed, and the identity is reached."""
    draw = np.random.Generator(np.random.PCG64(9))
    x = draw.normal(size=(500, 20)) @ draw.normal(size=(20, 20))
    vectors = made(spark, [(i, r.tolist(), None, None) for i, r in enumerate(x)], "double")
    model = whitening.fit(vectors, components=20)
    assert model.components.shape == (20, 20) and model.identity_error < 1e-9
    assert np.allclose(model.components.T @ model.components, np.eye(20), atol=1e-13)
