"""Operators against brute force, and recovery of known models from simulated data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.functions import basis as bases
from driftfield.functions.expr import Var, exp, tanh
from driftfield.operators import diagnostics as dg
from driftfield.operators import interactions as ia
from driftfield.operators import parametric, reduce, simulate, sparse
from driftfield.operators.linear import Fit, Overdamped, Underdamped
from driftfield.operators.reduce import dataset_index, dataset_weights, gram
from driftfield.operators.streams import with_streams
from driftfield.sources import tables


@pytest.fixture(scope="module")
def trap(spark):
    force = [-2.0 * Var("x0"), -1.0 * Var("x1")]
    return simulate.simulate(spark, force, np.eye(2) * 0.5, replicas=16, frames=400, dt=0.05, seed=3).cache()


def test_overdamped_recovery(trap):
    model = Overdamped(trap, 2)
    model.diffusion_constants("msd")
    assert np.allclose(model.diffusion, np.eye(2) * 0.5, atol=0.06)
    fit = model.infer_force(bases.monomials_up_to(2, 2, "vector"), "clean")
    sparse, front = model.sparsify(fit)
    assert {fit.basis.labels[i] for i in sparse.support} == {"x0*e0", "x1*e1"}
    c = dict(zip(fit.basis.labels, sparse.coefficients, strict=True))
    assert abs(c["x0*e0"] + 2) < 0.35 and abs(c["x1*e1"] + 1) < 0.25
    assert model.compare_to_exact(sparse, [-2.0 * Var("x0"), -1.0 * Var("x1")])["nmse"] < 0.05
    assert abs(model.entropy_production(bases.linear(2).vectorize())["debiased"]) < 30
    assert model.holdout_score(sparse, trap) < 1
    assert [r["feature"] for r in model.summary(sparse)] == [fit.basis.labels[i] for i in sparse.support]
    again = Fit.from_json(sparse.to_json(), fit.basis)
    assert np.allclose(again.coefficients, sparse.coefficients)
    band = sparse.predict_ci(trap.limit(5)).collect()
    assert all(r["f0_low"] <= r["f0"] <= r["f0_high"] for r in band)


def test_gram_strategies_agree(trap):
    s = with_streams(trap, (1,), ["x0", "x1"])
    cols = [F.col("x0"), F.col("x1"), F.col("x0") * F.col("x1"), F.lit(1.0)]
    small = gram(s, cols, cols, F.lit(1.0))
    wide = gram(s, cols * 4, cols * 4, F.lit(1.0))
    assert np.allclose(np.tile(small, (4, 4)), wide)


def test_underdamped_recovery(spark):
    df = simulate.simulate(spark, [-1.0 * Var("x0") - 0.5 * Var("v0")], np.eye(1), replicas=8, frames=2000, dt=0.05, inertia=True, seed=2)
    model = Underdamped(df, 1)
    fit = model.infer_force(bases.linear(1, with_v=True).vectorize(), "clean")
    assert np.allclose(fit.coefficients, [-1, -0.5], atol=0.25)
    even, odd = model.time_reversal_split(fit)
    at = {"x0": np.array([2.0, 2.0]), "v0": np.array([3.0, -3.0])}
    assert np.allclose(odd[0].numpy(at), fit.coefficients[1] * at["v0"]) and np.allclose(even[0].numpy(at), fit.coefficients[0] * 2.0)
    assert dg.classify_dynamics(df).verdict == "underdamped"


def test_residuals_of_the_true_model(trap):
    z = dg.od_residuals(trap, [-2.0 * F.col("x0"), -1.0 * F.col("x1")], np.eye(2) * 0.5)
    m = dg.moments(z).first()
    assert abs(m["mean"]) < 0.06 and abs(m["std"] - 1) < 0.08
    assert dg.classify_dynamics(trap, 2).verdict == "overdamped"


def test_innovations_against_a_dense_solve(spark):
    rng = np.random.default_rng(0)
    r, dt, a, lam = rng.normal(size=6), np.full(6, 0.5), 2.0, 1.5
    rows = spark.createDataFrame([(0, 0, k if k < 4 else k + 3, float(dt[k]), float(r[k])) for k in range(6)], "dataset_id int, particle_id long, time_idx long, dt double, r0 double")
    z = dg.innovations(rows, np.array([[a]]), np.array([[lam]]), 1, F.col("dt"), F.lit(2.0), F.lit(-1.0)).toPandas().sort_values("time_idx")
    cov = np.diag(dt * a + 2 * lam) - lam * (np.eye(6, k=1) + np.eye(6, k=-1))
    cov[3, 4] = cov[4, 3] = 0
    assert np.isclose((z["z0"] ** 2).sum(), r @ np.linalg.solve(cov, r))


def test_parametric_whitening_against_a_dense_solve():
    rng = np.random.default_rng(1)
    r, psi = rng.normal(size=(5, 1)), rng.normal(size=(5, 1, 2))
    cov, off = np.full((5, 1, 1), 3.0), np.full((5, 1, 1), -1.0)
    start = np.array([True, False, False, True, False])
    z, w, logdet = parametric.block_whiten(r, psi, cov, off, start)
    dense = np.diag(np.full(5, 3.0)) - np.eye(5, k=1) - np.eye(5, k=-1)
    dense[2, 3] = dense[3, 2] = 0
    assert np.isclose((z**2).sum(), r[:, 0] @ np.linalg.solve(dense, r[:, 0]))
    assert np.isclose(logdet, 0.5 * np.linalg.slogdet(dense)[1])
    assert np.allclose(np.einsum("tdp,td->p", w, z), psi[:, 0].T @ np.linalg.solve(dense, r[:, 0]))


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(7, 0.5, 1.0, 2.0), (7, 1.5, 2.0, 3.0), (3, 0.5, None, 1.0), (3, 1.5, 4.0, 5.0)], "track_id long, time double, a double, b double")
    df = tables.from_dataframe(rows)
    assert sorted((r["particle_id"], r["time_idx"], r["x0"], r["x1"]) for r in df.collect()) == [(3, 1, 4.0, 5.0), (7, 0, 1.0, 2.0), (7, 1, 2.0, 3.0)]
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        tables.save(df, path, fmt, {"dt": 1.0})
        again, meta = tables.load(spark, path)
        assert meta == {"dt": 1.0} and again.count() == 3 and set(again.columns) == set(df.columns)
    with pytest.raises(ValueError):
        tables.from_dataframe(rows.withColumn("frame", F.lit(1)))
    with pytest.raises(NotImplementedError):
        tables.load_hdf5("x.h5")
    text = tmp_path / "one.csv"
    text.write_text("# dt: 0.1\nparticle,frame,x,y\n0,0,1.0,2.0\n0,1,1.5,2.5\n")
    assert tables.load_csv(spark, str(text)).count() == 2


def test_collections(spark):
    df = spark.createDataFrame([(d, 0, t, float(t), float(d)) for d in range(3) for t in range(4 * (d + 1))], "dataset_id int, particle_id long, time_idx long, t double, x0 double")
    s = with_streams(df, (-1, 1), ["x0"])
    w = {r[0]: r[1] for r in dataset_weights(s, "per_dataset", ["dX"]).collect()}
    assert np.isclose(w[0] * 3, w[1] * 7) and np.isclose(w[1] * 7, w[2] * 11)
    assert {r[0]: r[1] for r in dataset_weights(s, "explicit", ["dX"], {1: 2.5}).collect()} == {0: 0.0, 1: 2.5, 2: 0.0}
    named = df.withColumn("uuid", F.when(F.col("dataset_id") == 0, "b").otherwise("a"))
    assert {r["uuid"]: r["dataset_index"] for r in dataset_index(named, "uuid").collect()} == {"b": 0, "a": 1}


def test_streaming(spark, tmp_path):
    from driftfield.streaming import online

    path = str(tmp_path / "in")
    rows = [(d, float(t), float((t * 7 + d) % 5)) for d in range(2) for t in range(30)]
    spark.createDataFrame(rows, "dataset_id long, t double, x0 double").write.parquet(path)
    stream = spark.readStream.schema("dataset_id long, t double, x0 double").parquet(path)
    q = online.increments(stream).writeStream.format("memory").queryName("steps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = online.running_estimates(spark.table("steps")).collect()
    assert {r["n"] for r in got} == {28}
    x = [(t * 7) % 5 for t in range(30)]
    want = np.mean([-(x[t + 1] - x[t]) * (x[t] - x[t - 1]) for t in range(1, 29)])
    assert np.isclose({r["dataset_id"]: r["noise"] for r in got}[0], want)


def test_trap_and_springs_are_told_apart(spark):
    """Interacting particles: simulated with a trap, springs and a short repulsion, fitted by features of pairs."""
    spring, push = [0.3 * d for d in ia.separation(2)], ia.central(2, lambda r: -2.0 * exp(-1.0 * r))
    df = simulate.simulate(
        spark, [-1.0 * Var("x0"), -1.0 * Var("x1")], np.eye(2), replicas=12, frames=250, dt=0.01, particles=4, pair=[a + b for a, b in zip(spring, push, strict=True)],
        spread=1.0,
    )
    rows, features, names = ia.gathered(df, {"spring": ia.separation(2), "push": ia.central(2, lambda r: exp(-1.0 * r))}, ia.all_pairs(df))
    for preset in ("clean", "legacy"):
        fit = Overdamped(rows, 2, names).infer_force(bases.position(2) & features, preset)
        error = np.abs(fit.coefficients - [-1.0, 0.3, -2.0])
        assert (error < 4 * fit.stderr + 0.1).all(), (preset, fit.coefficients)


def test_jacobian_of_pair_features(spark):
    rng = np.random.default_rng(3)
    places = rng.normal(size=(5, 2))
    table = lambda x: spark.createDataFrame([(0, 0, i, 0.0, float(a), float(b)) for i, (a, b) in enumerate(x)], "dataset_id long, time_idx long, particle_id long, t double, x0 double, x1 double")
    kernel = {"k": ia.central(2, lambda r: exp(-1.0 * r))}

    def values(x):
        df = table(x)
        return ia.gathered(df, kernel, ia.all_pairs(df))[0].orderBy("particle_id").toPandas()

    found, h = values(places), 1e-5
    for axis in range(2):
        moved = places.copy()
        moved[2, axis] += h
        other = values(moved)
        for i in range(2):
            assert np.isclose((other[f"pair0_{i}"][2] - found[f"pair0_{i}"][2]) / h, found[f"pair0_{i}_d{axis}"][2], atol=1e-3)


def test_state_dependent_diffusion(spark):
    df = simulate.simulate(spark, [-1.0 * Var("x0")], np.array([[1.0 + 0.5 * Var("x0") ** 2]], object), replicas=24, frames=500, dt=0.01)
    fit = Overdamped(df, 1).infer_diffusion(bases.monomials(1, [0, 2]).tensorize(), "weak")
    assert np.allclose(fit.coefficients, [1.0, 0.5], atol=0.12)


def test_long_tracks_are_cut_to_blocks(trap):
    one, cut = (Overdamped(trap, 2, block=b).infer_force(bases.monomials_up_to(2, 1, "vector"), "robust") for b in (1 << 16, 7))
    assert np.allclose(one.coefficients, cut.coefficients) and np.allclose(one.gram, cut.gram)


def test_null_and_nan_features_on_both_paths(spark, monkeypatch):
    """A null leaves out its own sums; NaN and infinity go through, however wide the dictionary is."""
    rows = [(1.0, 2.0), (None, 3.0), (4.0, float("inf")), (5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    columns = [F.col("a"), F.col("b"), F.lit(1.0)]
    narrow = reduce.gram(df, columns, columns, F.lit(1.0))
    monkeypatch.setattr(reduce, "SUM_COLUMNS", 0)
    assert np.array_equal(narrow, reduce.gram(df, columns, columns, F.lit(1.0)), equal_nan=True)
    assert narrow[0, 0] == 42 and np.isinf(narrow[0, 1]) and narrow[2, 2] == 4
    broken = reduce.gram(df.withColumn("b", F.lit(float("nan"))), columns, columns, F.lit(1.0))
    assert np.isnan(broken[0, 1]) and broken[0, 0] == 42


def test_thresholds_and_penalties_act_on_raw_coefficients():
    """A feature of large size and small coefficient goes first, unless features are scaled."""
    g, m = np.diag([1e4, 1.0, 1.0]), np.array([1e3, 1.0, 0.5])
    assert sparse.search(g, m, "stlsq", thresholds=[0.2]).support[2] == (1, 2)
    assert 2 not in sparse.search(g, m, "stlsq", thresholds=[0.2], scaled=True).support
    assert sparse.search(g, m, "stlsq", thresholds=[0.6], mode="absolute").support[1] == (1,)
    # Raw penalties: the largest moment enters first; of the scaled, that of the largest information.
    assert sparse.search(g, m, "lasso", penalties=[10.0]).support[1] == (0,)


def test_likelihood_fit_recovers_a_saturating_force(spark):
    force = [Var("a") * -1.0 * tanh(Var("x0") * Var("b"))]
    df = simulate.simulate(spark, [e.bind({"a": 2.0, "b": 1.5}) for e in force], np.eye(1) * 0.5, replicas=8, frames=200, dt=0.05)
    fit = parametric.infer(df, force, {"a": 1.0, "b": 1.0}, rounds=8)
    assert abs(fit.theta["a"] * fit.theta["b"] - 3.0) < 0.8 and abs(fit.diffusion - 0.5) < 0.05
