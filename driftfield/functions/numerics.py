"""Small dense numerics on the driver: solves, special functions, optimisers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def scaled_pinv(g: np.ndarray, rtol: float = 1e-12) -> np.ndarray:
    """Pseudo-inverse after scaling the diagonal to 1."""
    scale = 1 / np.sqrt(np.maximum(np.abs(np.diag(g)), 1e-300))
    return np.linalg.pinv(g * np.outer(scale, scale), rcond=rtol) * np.outer(scale, scale)


def solve_normal(g: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Coefficients of G c = M, scaled; by least squares where G is singular."""
    scale = 1 / np.sqrt(np.maximum(np.abs(np.diag(g)), 1e-8))
    a, b = g * np.outer(scale, scale), m * scale
    try:
        return scale * np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return scale * np.linalg.lstsq(a, b, rcond=None)[0]


def sqrtm_psd(a: np.ndarray) -> np.ndarray:
    """Square root of a symmetric matrix; negative eigenvalues count as 0."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def norm_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def norm_ppf(p: float) -> float:
    """Quantile of the normal law, by bisection on the distribution function and two Newton steps."""
    low, high = -40.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if norm_cdf(mid) < p else (low, mid)
    x = (low + high) / 2
    for _ in range(2):
        density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        x -= (norm_cdf(x) - p) / density if density > 0 else 0
    return x


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - lead * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead * h


def chi2_sf(x: float, k: float) -> float:
    return gamma_q(k / 2, x / 2)


def ks_pvalue(d: float, n: int) -> float:
    """Asymptotic p-value of the Kolmogorov-Smirnov statistic, with Stephens' correction for small n."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    out = np.empty_like(x)
    for i in range(len(x)):
        h = step * max(1.0, abs(x[i]))
        e = np.zeros_like(x)
        e[i] = h
        out[i] = (f(x + e) - f(x - e)) / (2 * h)
    return out


def lbfgs(f: Callable[[np.ndarray], float], x: np.ndarray, rounds: int = 200, memory: int = 8, tol: float = 1e-9) -> np.ndarray:
    """Minimise by limited-memory BFGS with central differences and a backtracking search."""
    x = np.asarray(x, float).copy()
    value, g = f(x), gradient(f, x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        direction = -q if q @ g > 0 else -g
        step = 1.0 if pairs else min(1.0, 1 / max(1e-12, np.abs(g).sum()))
        while step > 1e-14:
            new = x + step * direction
            there = f(new)
            if math.isfinite(there) and there <= value + 1e-4 * step * (g @ direction):
                break
            step /= 2
        else:
            return x
        ng = gradient(f, new)
        s, y = new - x, ng - g
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - there) <= tol * max(1.0, abs(value))
        x, value, g = new, there, ng
        if done:
            return x
    return x


def gauss_newton(residual: Callable[[np.ndarray], np.ndarray], x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Least squares within bounds, by damped Gauss-Newton steps projected on the box. Returns (x, sum of squares)."""
    x, damping = np.clip(np.asarray(x, float), low, high), 1e-3
    r = residual(x)
    best = float(r @ r)
    for _ in range(rounds):
        jac = np.empty((len(r), len(x)))
        for i in range(len(x)):
            h = 1e-6 * max(1e-3, abs(x[i]))
            h = -h if x[i] + h > high[i] else h
            e = x.copy()
            e[i] += h
            jac[:, i] = (residual(e) - r) / h
        a, b = jac.T @ jac, -jac.T @ r
        improved = False
        for _ in range(12):
            step = np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), b, rcond=None)[0]
            new = np.clip(x + step, low, high)
            there = residual(new)
            cost = float(there @ there)
            if cost < best:
                improved = best - cost > 1e-14 * best
                x, r, best, damping = new, there, cost, damping / 5
                break
            damping *= 4
        if not improved:
            break
    return x, best
