"""Parametric inference: force fields that are not linear in their parameters, by likelihood of flow residuals.

Each evaluation is one pass over the cached tracks: every group of tracks
returns its sums (Gram matrix, gradient, likelihood), a few numbers that the
driver adds before it takes a Gauss-Newton step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.functions.basis import Basis
from driftfield.functions.expr import Expr
from driftfield.functions.numerics import lbfgs, scaled_pinv
from driftfield.operators.simulate import rk4


@dataclass
class Parametric:
    """Fitted parameters, their covariance, diffusion, localisation noise, and the likelihood."""

    theta: dict[str, float]
    covariance: np.ndarray
    diffusion: float
    noise: float
    nll: float
    rounds: int

    def field(self, force: Sequence[Expr]) -> list[Expr]:
        return [e.bind(self.theta) for e in force]


def block_whiten(r: np.ndarray, psi: np.ndarray, cov: np.ndarray, off: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Whiten a sequence whose neighbours are correlated, by a block LDL recursion that restarts where ``start`` is true.

    r (T, d), psi (T, d, p), cov (T, d, d), off (T, d, d): covariance of r[t] with r[t - 1].
    Returns whitened r and psi, and half the log determinant.
    """
    z, w, logdet = np.empty_like(r), np.empty_like(psi), 0.0
    s = e = q = None
    for t in range(len(r)):
        if t and not start[t]:
            gain = off[t] @ np.linalg.inv(s)
            s, e, q = cov[t] - gain @ off[t].T, r[t] - gain @ e, psi[t] - gain @ q
        else:
            s, e, q = cov[t], r[t], psi[t]
        root = np.linalg.cholesky(s)
        z[t], w[t] = np.linalg.solve(root, e), np.linalg.solve(root, q)
        logdet += float(np.log(np.diag(root)).sum())
    return z, w, logdet


def evaluate(pdf: pd.DataFrame, force: Sequence[Expr], names: Sequence[str], theta: np.ndarray, diffusion: float, noise: float, substeps: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums of one track: Gram matrix, gradient, negative log-likelihood, rows.

    Residuals are X_next less the flow of X over dt. Their covariance is 2 D dt
    plus the noise of both ends, carried through the flow's Jacobian; consecutive
    residuals share a noisy position.
    """
    dim, p = len(force), len(names)
    pdf = pdf.sort_values("time_idx")
    x = pdf[[f"x{i}" for i in range(dim)]].to_numpy()
    t, k = pdf["t"].to_numpy(), pdf["time_idx"].to_numpy()
    ok = np.flatnonzero(np.diff(k) == 1)
    if not len(ok):
        return np.zeros((p, p)), np.zeros(p), 0.0, 0
    x0, x1, dt = x[ok], x[ok + 1], (t[ok + 1] - t[ok])[:, None]

    def flow(values: np.ndarray, params: np.ndarray) -> np.ndarray:
        env = {n: np.full(len(values), v) for n, v in zip(names, params, strict=True)}

        def f(y: np.ndarray, _: np.ndarray) -> np.ndarray:
            here = env | {f"x{i}": y[:, i] for i in range(dim)}
            return np.stack([np.broadcast_to(np.asarray(e.numpy(here), float), len(y)) for e in force], axis=1)

        return rk4(lambda y, v: f(y, v) * dt, values, 1.0, substeps)

    base = flow(x0, theta)
    r = x1 - base
    psi = np.empty((len(r), dim, p))
    for j in range(p):
        h = 1e-5 * max(1.0, abs(theta[j]))
        step = np.zeros(p)
        step[j] = h
        psi[:, :, j] = (flow(x0, theta + step) - flow(x0, theta - step)) / (2 * h)
    jac = np.empty((len(r), dim, dim))
    for j in range(dim):
        h = 1e-5 * max(1.0, float(np.abs(x0).mean()))
        step = np.zeros(dim)
        step[j] = h
        jac[:, :, j] = (flow(x0 + step, theta) - flow(x0 - step, theta)) / (2 * h)
    eye = np.eye(dim)
    # The process noise as the flow carries it, by Simpson's rule between its ends.
    half = (eye + jac) / 2
    q = 2 * diffusion * dt[:, :, None] / 6 * (eye + 4 * half @ half.transpose(0, 2, 1) + jac @ jac.transpose(0, 2, 1))
    cov = q + noise * (eye + jac @ jac.transpose(0, 2, 1))
    start = np.concatenate([[True], np.diff(ok) != 1])
    if noise > 0:
        z, w, logdet = block_whiten(r, psi, cov, -noise * jac, start)
    else:
        root = np.linalg.cholesky(cov)
        z = np.linalg.solve(root, r[:, :, None])[:, :, 0]
        w = np.linalg.solve(root, psi)
        logdet = float(np.log(np.diagonal(root, axis1=1, axis2=2)).sum())
    nll = 0.5 * float((z * z).sum()) + logdet + 0.5 * r.size * np.log(2 * np.pi)
    return np.einsum("tdp,tdq->pq", w, w), np.einsum("tdp,td->p", w, z), nll, len(r)


def infer(
    df: DataFrame, force: Sequence[Expr], start: dict[str, float], diffusion: float | None = None, noise: float = 0.0, rounds: int = 30, profile: bool = True,
    substeps: int = 2,
) -> Parametric:
    """Fit the parameters of ``force`` (an expression per axis) by damped Gauss-Newton steps on the likelihood.

    The diffusion (and, if ``profile``, the localisation noise) follow from the
    likelihood at the first fit, then the parameters are refitted. Tracks are
    grouped once and cached; a track must fit in one task.
    """
    names, dim = list(start), len(force)
    cols = [f"x{i}" for i in range(dim)]
    tracks = df.select("dataset_id", "particle_id", "time_idx", "t", *cols).repartition("dataset_id", "particle_id").cache()

    def total(theta: np.ndarray, d: float, lam: float) -> tuple[np.ndarray, np.ndarray, float]:
        p = len(names)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            g, f, nll, n = evaluate(pdf, force, names, theta, d, lam, substeps)
            return pd.DataFrame({"s": [[*g.ravel(), *f, nll, float(n)]]})

        sums = tracks.groupBy("dataset_id", "particle_id").applyInPandas(run, "s array<double>")
        rows = sums.select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # p * p + p + 2 numbers
        v = np.array([r["v"] for r in rows])
        return v[: p * p].reshape(p, p), v[p * p : p * p + p], float(v[-2])

    from driftfield.operators.linear import Overdamped

    moment = Overdamped(df, dim).diffusion_constants()
    d = float(np.trace(moment["od_msd" if noise == 0 else "od_noisy"]) / dim) if diffusion is None else diffusion
    theta, used = np.array([start[n] for n in names], float), 0

    def descend(theta: np.ndarray, d: float, lam: float) -> tuple[np.ndarray, np.ndarray, float, int]:
        damping = 1e-3
        g, f, nll = total(theta, d, lam)
        for k in range(rounds):
            step = np.linalg.lstsq(g + damping * np.diag(np.diag(g) + 1e-12), f, rcond=1e-10)[0]
            for share in (1.0, 0.5, 0.25, 0.1):
                g2, f2, nll2 = total(theta + share * step, d, lam)
                if nll2 <= nll:
                    break
            else:
                return theta, g, nll, k
            small = nll - nll2 < 1e-8 * max(1.0, abs(nll))
            theta, g, f, nll, damping = theta + share * step, g2, f2, nll2, damping / 4
            if small:
                return theta, g, nll, k + 1
        return theta, g, nll, rounds

    theta, g, nll, used = descend(theta, d, noise)
    if profile and diffusion is None:
        logs = lambda x: total(theta, float(np.exp(x[0])), float(np.exp(x[1])) if noise > 0 else 0.0)[2]
        x = lbfgs(logs, np.log([d, noise] if noise > 0 else [d]), rounds=8, tol=1e-6)
        d, noise = float(np.exp(x[0])), float(np.exp(x[1])) if noise > 0 else 0.0
        theta, g, nll, more = descend(theta, d, noise)
        used += more
    tracks.unpersist()
    return Parametric(dict(zip(names, theta.tolist(), strict=True)), scaled_pinv(g), d, noise, nll, used)


def from_basis(basis: Basis, prefix: str = "c") -> tuple[list[Expr], dict[str, float]]:
    """A vector basis as a parametric force: coefficients as parameters, from 0."""
    from driftfield.functions.expr import Const, Var

    total: list[Expr] = [Const(0.0)] * basis.dim
    for a, feature in enumerate(basis.values):
        total = [t + Var(f"{prefix}{a}") * f for t, f in zip(total, feature, strict=True)]
    return total, {f"{prefix}{a}": 0.0 for a in range(basis.n_features)}
