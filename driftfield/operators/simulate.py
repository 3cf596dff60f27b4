"""Simulated Langevin ensembles: replicas in parallel, NumPy in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions.expr import as_expr
from driftfield.operators.linear import Fit
from driftfield.operators.streams import difference, mask, with_streams

Field = Callable[[np.ndarray, np.ndarray], np.ndarray]


def field_of(expressions: Sequence) -> Field:
    """A NumPy field of (x, v) from expressions."""

    def f(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        env = {f"x{i}": x[:, i] for i in range(x.shape[1])} | {f"v{i}": v[:, i] for i in range(x.shape[1])}
        return np.stack([np.broadcast_to(np.asarray(e.numpy(env), float), len(x)) for e in expressions], axis=1)

    return f


def rk4(f: Field, x: np.ndarray, dt: float, steps: int = 1) -> np.ndarray:
    """The flow of dx = f(x) dt over dt."""
    h, v = dt / steps, np.zeros_like(x)
    for _ in range(steps):
        a = f(x, v)
        b = f(x + h / 2 * a, v)
        c = f(x + h / 2 * b, v)
        x = x + h / 6 * (a + 2 * b + 2 * c + f(x + h * c, v))
    return x


def euler(f: Field, x: np.ndarray, dt: float, steps: int = 1) -> np.ndarray:
    for _ in range(steps):
        x = x + dt / steps * f(x, np.zeros_like(x))
    return x


def conserved_noise(shape: Sequence[int], rng: np.random.Generator) -> np.ndarray:
    """White noise filtered by the wave number on a periodic grid, so that its sum is 0."""
    k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n)) ** 2 for n in shape], indexing="ij")))
    return np.fft.ifftn(np.fft.fftn(rng.normal(size=tuple(shape))) * k).real


def interacting(force: Field, pair: Sequence, box: Sequence[float] | None = None) -> Field:
    """``force`` plus the sum over all other particles of a pair force, given by expressions of the displacement d0.. to the other."""

    def f(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = x[None, :, :] - x[:, None, :]
        if box is not None:
            d = d - np.rint(d / box) * np.asarray(box)
        env = {f"d{k}": d[:, :, k] for k in range(d.shape[2])}
        each = np.stack([np.broadcast_to(np.asarray(e.numpy(env), float), d.shape[:2]) for e in pair], axis=2)
        return force(x, v) + np.where(np.eye(len(x), dtype=bool)[:, :, None], 0.0, each).sum(axis=1)

    return f


def roots(diffusion: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The noise's amplitude, sqrt(2 D) as a lower triangle, for each particle; D is numbers, or expressions of its state."""
    diffusion = np.asarray(diffusion)
    if diffusion.dtype != object:
        root = np.linalg.cholesky(2 * diffusion.astype(float))
        return lambda x, v: root[None]
    dim = len(diffusion)
    field = field_of([e if hasattr(e, "numpy") else as_expr(e) for e in diffusion.reshape(-1)])
    return lambda x, v: np.linalg.cholesky(2 * field(x, v).reshape(-1, dim, dim))


def trajectory(
    force: Field, root: Callable[[np.ndarray, np.ndarray], np.ndarray], frames: int, dt: float, x0: np.ndarray, rng: np.random.Generator, inertia: bool, oversampling: int,
    prerun: int, heun: bool = False,
) -> np.ndarray:
    """Positions of particles (frame, particle, axis): Euler-Maruyama (in Ito's sense) or Heun steps, or kick, drift, kick with a velocity."""
    x, v, h = x0.copy(), np.zeros_like(x0), dt / oversampling
    out = np.empty((frames, *x.shape))
    for t in range(-prerun * oversampling, frames * oversampling):
        if t >= 0 and t % oversampling == 0:
            out[t // oversampling] = x
        kick = np.einsum("pij,pj->pi", np.broadcast_to(root(x, v), (len(x), x.shape[1], x.shape[1])), rng.normal(size=x.shape)) * np.sqrt(h)
        if inertia:
            v = v + h / 2 * force(x, v)
            x = x + h * v
            v = v + kick + h / 2 * force(x, v)
        elif heun:
            there = x + h * force(x, v) + kick
            x = x + h / 2 * (force(x, v) + force(there, v)) + kick
        else:
            x = x + h * force(x, v) + kick
    return out


def simulate(
    spark: SparkSession, force: Sequence, diffusion: np.ndarray, replicas: int, frames: int, dt: float, inertia: bool = False, seed: int = 0,
    oversampling: int = 4, prerun: int = 100, noise: float = 0.0, heun: bool = False, particles: int = 1, pair: Sequence | None = None,
    box: Sequence[float] | None = None, spread: float = 0.0,
) -> DataFrame:
    """A collection of independent replicas (dataset_id) of one or more particles, each from its own seed.

    ``force`` has an expression per axis; ``pair`` one per axis of the
    displacement d0.. to another particle (in a periodic ``box``). ``diffusion``
    is a matrix of numbers or of expressions. Particles start normally spread.
    Replicas are dealt to tasks; a rerun gives the same rows.
    """
    dim, root = len(force), roots(diffusion)
    names = [f"x{i}" for i in range(dim)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = field_of(force)
        if pair is not None:
            f = interacting(f, pair, box)
        for batch in batches:
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                start = spread * rng.normal(size=(particles, dim)) if spread else np.zeros((particles, dim))
                path = trajectory(f, root, frames, dt, start, rng, inertia, oversampling, prerun, heun)
                path = path + noise * rng.normal(size=path.shape)
                for i in range(particles):
                    base = {"dataset_id": np.full(frames, k), "particle_id": np.full(frames, i), "time_idx": np.arange(frames), "t": np.arange(frames) * dt}
                    yield pd.DataFrame(base | dict(zip(names, path[:, i].T, strict=True)))

    schema = "dataset_id long, particle_id long, time_idx long, t double" + "".join(f", {n} double" for n in names)
    return spark.range(replicas).repartition(min(replicas, 64)).mapInPandas(run, schema)


def bootstrap(spark: SparkSession, fit: Fit, diffusion: np.ndarray, **options) -> DataFrame:
    """Trajectories of a fitted model."""
    return simulate(spark, list(fit.field().reshape(-1)), diffusion, **options)


def observables(df: DataFrame, force: Sequence, diffusion: np.ndarray) -> DataFrame:
    """Information and entropy along the tracks: sums of dX D**-1 F / 4, and of dX D**-1 (F + F_next) / 2."""
    dim, inv = len(force), np.linalg.inv(np.asarray(diffusion, float))
    rows = with_streams(df, (1,), [f"x{i}" for i in range(dim)])
    now = [e.column() for e in force]
    after = [e.column({f"x{i}": F.col(f"x{i}_p1") for i in range(dim)}) for e in force]
    pair = lambda f: sum((difference(f"x{i}", 0) * float(inv[i, j]) * f[j] for i in range(dim) for j in range(dim)), F.lit(0.0))
    ok = mask(["dX"])
    return rows.agg(
        F.sum(F.when(ok, pair(now) / 4)).alias("information"), F.sum(F.when(ok, pair([(a + b) / 2 for a, b in zip(now, after, strict=True)]))).alias("entropy")
    )
