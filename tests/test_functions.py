from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftfield.functions import basis as bases
from driftfield.functions import numerics as nm
from driftfield.functions.expr import Var, cos, exp, log, sin, sqrt, tanh
from driftfield.operators import grid
from driftfield.operators import sparse as sp
from driftfield.operators.simulate import conserved_noise, euler, rk4

X, Y = Var("x0"), Var("x1")


@settings(max_examples=40, deadline=None)
@given(st.floats(0.2, 2.0), st.floats(0.2, 2.0))
def test_derivatives_match_differences(a, b):
    for e in (sin(X * Y) + X**3, exp(-X) / Y, tanh(X) * sqrt(Y + X**2), log(X + Y) * cos(Y), (X - Y) ** -2 if abs(a - b) > 0.1 else X):
        for name, h in (("x0", (1e-6, 0)), ("x1", (0, 1e-6))):
            up = e.numpy({"x0": np.float64(a + h[0]), "x1": np.float64(b + h[1])})
            down = e.numpy({"x0": np.float64(a - h[0]), "x1": np.float64(b - h[1])})
            assert math.isclose(e.diff(name).numpy({"x0": np.float64(a), "x1": np.float64(b)}), (up - down) / 2e-6, rel_tol=1e-4, abs_tol=1e-4)


def test_columns_agree_with_numpy(spark):
    e = (sin(X * Y) + X**3) / (1 + Y**2)
    df = spark.createDataFrame([(0.3, 1.2), (-1.0, 2.0)], "x0 double, x1 double")
    got = [r[0] for r in df.select(e.column()).collect()]
    assert np.allclose(got, e.numpy({"x0": np.array([0.3, -1.0]), "x1": np.array([1.2, 2.0])}))


def test_basis_algebra():
    b = bases.monomials_up_to(2, 2)
    assert b.labels == ["1", "x0", "x1", "x0^2", "x0*x1", "x1^2"]
    v = b.vectorize()
    assert (v.n_features, v.rank) == (12, 1)
    assert v.d_x().values.shape == (12, 2, 2)
    assert bases.symmetric_matrices(3).n_features == 6
    assert (b * b).n_features == 36
    assert v.rank_to_features().n_features == 24
    assert v.rank_to_features().features_to_rank().values.shape == v.values.shape
    dot = bases.position(2).dot(bases.position(2)).numpy({"x0": np.array([3.0]), "x1": np.array([4.0])})
    assert dot.ravel().tolist() == [25.0]
    with pytest.raises(ValueError):
        b & v


def test_square_roots_of_matrices():
    m = bases.Basis(np.array([[[2.0 + X**2, X], [X, 1.0 + Y**2]]], object), 2)
    env = {"x0": np.array([0.7]), "x1": np.array([1.1])}
    root = m.sqrtm().numpy(env)[0, 0]
    assert np.allclose(root @ root, m.numpy(env)[0, 0])


def test_special_functions():
    assert math.isclose(nm.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(nm.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(nm.chi2_sf(31.410432844230918, 20), 0.05, rel_tol=1e-9)
    assert nm.ks_pvalue(0.5, 100) < 1e-10 < 0.9 < nm.ks_pvalue(0.01, 100)
    root = nm.sqrtm_psd(np.array([[2.0, 0.5], [0.5, 1.0]]))
    assert np.allclose(root @ root, [[2.0, 0.5], [0.5, 1.0]])
    rosen = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    assert np.allclose(nm.lbfgs(rosen, np.array([-1.2, 1.0])), [1, 1], atol=1e-3)
    x, cost = nm.gauss_newton(lambda p: np.array([p[0] - 3, p[1] - 0.5]), np.array([0.0, 0.0]), np.zeros(2), np.ones(2))
    assert np.allclose(x, [1, 0.5]) and math.isclose(cost, 4)


def test_selection_recovers_a_sparse_model():
    rng = np.random.default_rng(1)
    f = rng.normal(size=(4000, 8))
    y = f @ np.array([0, 2.0, 0, 0, -1.0, 0, 0, 0]) + rng.normal(size=4000) * 0.5
    g, m = f.T @ f / 0.25, f.T @ y / 0.25
    for method in sp.STRATEGIES:
        front = sp.search(g, m, method)
        k = sp.select(front, "PASTIS", n=8, tau=4000)
        assert front.support[k] == (1, 4), method
        assert sp.overlap(front.support[k], [1, 4])["exact"] == 1
    assert sp.criterion_value("SIC", 1.0, 1, 8, 1, 1, 1, 0.0) == -math.inf


def test_stencils_compose():
    assert grid.biharmonic(2)[(0, 0)] == 20 and grid.biharmonic(2)[(1, 1)] == 2
    assert len(grid.biharmonic(2)) == 13
    assert grid.compose(grid.central(1, 0), grid.central(1, 0)) == {(2,): 0.25, (0,): -0.5, (-2,): 0.25}
    assert set(grid.curl3d(["a", "b", "c"])) == {"curl0", "curl1", "curl2"}


def test_flows():
    decay = lambda x, v: -x
    assert np.allclose(rk4(decay, np.array([[1.0]]), 1.0, 20), math.exp(-1), atol=1e-7)
    assert np.allclose(euler(decay, np.array([[1.0]]), 1.0, 4000), math.exp(-1), atol=1e-3)
    assert abs(conserved_noise((8, 8), np.random.default_rng(0)).sum()) < 1e-9


def test_parameters_of_datasets_and_their_derivatives():
    from driftfield.functions.expr import as_expr, sin

    b = bases.per_dataset_scalar(1, "k", 3)
    env = {"dataset_id": np.array([0.0, 1.0, 2.0]), "k0": 5.0, "k1": 6.0, "k2": 7.0}
    assert np.allclose(b.numpy(env)[:, 0], [5, 6, 7])
    assert np.allclose(b.specialize(1).numpy({"x0": np.zeros(2), "k0": 5.0, "k1": 6.0, "k2": 7.0})[:, 0], 6)
    field = [Var("a") * sin(Var("x0") * Var("b"))]
    d = bases.d_theta(field, ["a", "b"]).numpy({"x0": np.array([0.3, 1.0]), "a": 2.0, "b": 1.5})
    x = np.array([0.3, 1.0])
    assert np.allclose(d[:, 0, 0], np.sin(1.5 * x)) and np.allclose(d[:, 1, 0], 2 * x * np.cos(1.5 * x))
    assert as_expr(0.0).diff("a") is not None


def test_arrays_round_trip(spark):
    from driftfield.sources.tables import from_arrays, to_arrays

    x = np.random.default_rng(0).normal(size=(6, 3, 2))
    x[2, 1] = np.nan
    mask = np.ones((6, 3), bool)
    mask[4, 0] = False
    df = from_arrays(spark, x, dt=0.5, mask=mask, dataset=4)
    back, t, there = to_arrays(df, 4)
    want = mask & ~np.isnan(x).any(axis=2)
    assert (there == want).all() and np.allclose(back[want], x[want]) and np.allclose(t, np.arange(6) * 0.5)
    assert df.count() == 16 and from_arrays(spark, x[:, 0]).columns == ["dataset_id", "particle_id", "time_idx", "t", "x0", "x1"]
