"""Linear inference of forces and diffusions: one fused aggregation, then small solves on the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.functions.basis import Basis
from driftfield.functions.expr import is_zero
from driftfield.functions.numerics import norm_ppf, scaled_pinv, solve_normal, sqrtm_psd
from driftfield.operators import estimators as est
from driftfield.operators.reduce import Product, products
from driftfield.operators.sparse import Front, select, search
from driftfield.operators.streams import at, difference, mask, with_halo, with_streams

OD_PRESETS = {"robust": ("strato", "shift"), "clean": ("ito", "trapeze"), "km": ("ito", "rectangle"), "legacy": ("strato", "rectangle")}
UD_PRESETS = {
    "robust": ("symmetric", "trapeze", "noisy"), "clean": ("symmetric", "trapeze", "weak"), "legacy-clean": ("early", "rectangle", "msd"),
    "legacy-noisy": ("symmetric", "rectangle", "noisy"),
}
UD_SHIFT = {"symmetric": 1.0, "early": 1 / 3, "anticipated": 0.0}


#: Frames of a track that share a window; longer tracks are cut to blocks with halos.
BLOCK = 1 << 16


def sparse(basis: Basis, names: dict[str, Column]) -> np.ndarray:
    """The features as Columns, None where a component is 0 by construction."""
    out = basis.columns(names)
    out[np.vectorize(is_zero, otypes=[bool])(basis.values)] = None
    return out


def placed(basis: Basis, k: int, names: Sequence[str]) -> np.ndarray:
    """The features at frame k, of the columns ``names`` that are known there."""
    return sparse(basis, {n: at(n, k) for n in names})


def moving(basis: Basis, x: Sequence[Column], v: Sequence[Column]) -> np.ndarray:
    """The features at given positions and velocities."""
    return sparse(basis, {f"x{i}": c for i, c in enumerate(x)} | {f"v{i}": c for i, c in enumerate(v)})


def total(terms: Iterable[Column | None]) -> Column | None:
    """A sum of Columns, None if there is none."""
    found = [t for t in terms if t is not None]
    return reduce(add, found) if found else None


def times(column: Column | None, factor: float) -> Column | None:
    return None if column is None or not factor else column * F.lit(float(factor))


def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, object)
    for k in np.ndindex(a.shape):
        out[k] = times(total([a[k], b[k]]), 0.5)
    return out


def against(features: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Each feature's last axis contracted with a matrix, so that the sums over rows are of p x p products only."""
    out = np.empty(features.shape, object)
    for k in np.ndindex(features.shape):
        out[k] = total(times(features[k[:-1]][n], inverse[k[-1], n]) for n in range(inverse.shape[1]))
    return out


def row_of(columns: Sequence[Column]) -> np.ndarray:
    out = np.empty((1, len(columns)), object)
    out[0, :] = columns
    return out


@dataclass
class Fit:
    """A fitted linear field: coefficients over a basis, with what selection and errors need."""

    basis: Basis
    coefficients: np.ndarray
    gram: np.ndarray
    moments: np.ndarray
    support: list[int]
    covariance: np.ndarray | None = None
    meta: dict = field(default_factory=dict)

    @property
    def information(self) -> float:
        return float(0.5 * self.coefficients @ self.moments)

    @property
    def stderr(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0))

    def field(self) -> np.ndarray:
        return self.basis.combine(self.coefficients)

    def predict(self, df: DataFrame, prefix: str = "f") -> DataFrame:
        """Add the field's components as columns."""
        parts = self.field().reshape(-1)
        return df.withColumns({f"{prefix}{i}": e.column() for i, e in enumerate(parts)})

    def predict_ci(self, df: DataFrame, level: float = 0.95, prefix: str = "f") -> DataFrame:
        """Add the field with a confidence band by the delta method."""
        z = norm_ppf((1 + level) / 2)
        out = self.predict(df, prefix)
        features = self.basis.columns().reshape(self.basis.n_features, -1)
        for i in range(features.shape[1]):
            var = F.lit(0.0)
            for a in range(len(features)):
                for b in range(len(features)):
                    if self.covariance[a, b]:
                        var = var + F.lit(float(self.covariance[a, b])) * features[a, i] * features[b, i]
            half = F.lit(z) * F.sqrt(F.greatest(var, F.lit(0.0)))
            out = out.withColumns({f"{prefix}{i}_low": F.col(f"{prefix}{i}") - half, f"{prefix}{i}_high": F.col(f"{prefix}{i}") + half})
        return out

    def restricted(self, support: Sequence[int]) -> Fit:
        support = list(support)
        c = np.zeros(len(self.moments))
        g = self.gram[np.ix_(support, support)]
        c[support] = solve_normal(g, self.moments[support])
        cov = np.zeros_like(self.gram)
        cov[np.ix_(support, support)] = scaled_pinv((g + g.T) / 2)
        return Fit(self.basis, c, self.gram, self.moments, support, cov, dict(self.meta))

    def coeff_block(self, *labels: str) -> tuple[list[str], np.ndarray, np.ndarray | None]:
        """Labels, coefficients and covariance of the features whose label has one of ``labels`` as a factor."""
        at_ = [i for i, name in enumerate(self.basis.labels) if set(name.split("*")) & set(labels) or name in labels]
        return [self.basis.labels[i] for i in at_], self.coefficients[at_], None if self.covariance is None else self.covariance[np.ix_(at_, at_)]

    def to_json(self) -> str:
        return json.dumps(
            {"labels": self.basis.labels, "coefficients": self.coefficients.tolist(), "support": self.support, "meta": self.meta,
             "gram": self.gram.tolist(), "moments": self.moments.tolist(), "covariance": None if self.covariance is None else self.covariance.tolist()},
            sort_keys=True,
        )

    @classmethod
    def from_json(cls, text: str, basis: Basis) -> Fit:
        d = json.loads(text)
        if d["labels"] != basis.labels:
            raise ValueError("the basis has other labels than the one that was fitted")
        cov = None if d["covariance"] is None else np.array(d["covariance"])
        return cls(basis, np.array(d["coefficients"]), np.array(d["gram"]), np.array(d["moments"]), d["support"], cov, d["meta"])


class Langevin:
    """What over- and underdamped inference share: streams, constant diffusion, errors, selection, comparison."""

    reach: tuple[int, ...]
    kinds: tuple[str, ...]

    def __init__(self, df: DataFrame, dim: int, extras: Sequence[str] = (), block: int = BLOCK):
        """Windows run along blocks of ``block`` frames of each track, so that a long track is many tasks.

        ``extras`` are columns that features use and that change with the frame,
        such as sums over pairs.
        """
        self.dim, self.extras, state = dim, list(extras), [f"x{i}" for i in range(dim)]
        self.names = [*state, *self.extras, "t"]
        cut = with_halo(df, block, max(map(abs, self.reach)))
        rows = with_streams(cut, self.reach, [*state, *self.extras], keys=("dataset_id", "particle_id", "block"))
        self.rows = rows.where("not halo").drop("block", "halo")
        self.diffusion: np.ndarray | None = None

    def diffusion_constants(self, method: str = "auto") -> dict[str, np.ndarray]:
        """All constant estimators in one pass, each over its own rows; sets the diffusion by ``method``."""
        d = self.dim
        terms = []
        for kind in self.kinds:
            ok = mask(est.NEEDS[kind])
            terms += [F.avg(F.when(ok, est.tensor(kind, i, j))).alias(f"{kind}_{i}{j}") for i in range(d) for j in range(d)]
        row = self.rows.agg(*terms, F.sum(F.when(mask(["X"]), est.step())).alias("tau"), F.count(F.when(mask(["X"]), 1)).alias("n")).first()
        found = {k: np.array([[row[f"{k}_{i}{j}"] for j in range(d)] for i in range(d)], float) for k in self.kinds}
        self.tau, self.n_rows, self.noise = row["tau"], row["n"], found[self.kinds[0]]
        if method == "auto":
            method = "noisy" if np.trace(self.noise) > 0 else "weak"
        self.diffusion = found[f"{self.kinds[0][:2]}_{method.lower()}"]
        return found

    @property
    def inverse(self) -> np.ndarray:
        """A ** -1 with A = 2 D."""
        if self.diffusion is None:
            self.diffusion_constants()
        return np.linalg.inv(2 * self.diffusion)

    @property
    def noise_amplitude(self) -> np.ndarray:
        return sqrtm_psd(2 * self.diffusion)

    def finish(self, basis: Basis, g: np.ndarray, m: np.ndarray, **meta) -> Fit:
        n = len(m)
        fit = Fit(basis, solve_normal(g, m), g, m, list(range(n)), scaled_pinv((g + g.T) / 2), meta)
        info = fit.information
        fit.meta["nmse_pred"] = float(np.trace(g @ fit.covariance) / (2 * info)) if info else math.nan
        return fit

    @staticmethod
    def _solved(found: dict[str, np.ndarray]) -> tuple[np.ndarray | None, np.ndarray | None]:
        """The Gram matrix and the moments, from the sums of their parts."""
        parts = [v for k, v in found.items() if k[0] == "g"]
        m = found["m"][0] - (found["drift"][0] if "drift" in found else 0) if "m" in found else None
        return (sum(parts) / len(parts) if parts else None), m

    def _regress(self, b: np.ndarray, kind: str, weight: Column, basis: Basis) -> Fit:
        """Least squares of an estimator's matrices on a dictionary of matrices, in one pass."""
        b = b.reshape(len(b), -1)
        seen = row_of([est.tensor(kind, i, j) for i in range(self.dim) for j in range(self.dim)])
        trace, one = row_of([est.tensor(kind, i, i) for i in range(self.dim)]), row_of([F.lit(1.0)] * self.dim)
        found = products(self.rows, {"g": Product(b, b, weight), "m": Product(seen, b, weight), "d": Product(trace, one, weight), "n": Product(one, one, weight)})
        fit = self.finish(basis, found["g"], found["m"][0], kind=kind)
        # Errors as if the diffusion were its mean everywhere: a row's estimate then scatters by 2 D ** 2.
        effective = found["d"][0, 0] / found["n"][0, 0] if found["n"][0, 0] else math.nan
        fit.covariance = 2 * effective**2 * fit.covariance
        return fit

    def sparsify(self, fit: Fit, criterion: str = "PASTIS", method: str = "beam", p0: float = 0.05, **options) -> tuple[Fit, Front]:
        front = search(fit.gram, fit.moments, method, **options)
        chosen = select(front, criterion, n=len(fit.moments), tau=self.tau, p0=p0)
        return fit.restricted(front.support[chosen]), front

    def holdout_score(self, fit: Fit, other: DataFrame) -> float:
        """Residual error of a fitted force on other data, normalised by the residual of no force."""
        model = type(self)(other, self.dim, self.extras)
        x, a = [F.col(f"x{i}") for i in range(self.dim)], self.inverse
        v = [difference(f"x{i}", 0) / est.step() for i in range(self.dim)]
        f = [e.column({f"v{i}": v[i] for i in range(self.dim)} | {f"x{i}": x[i] for i in range(self.dim)}) for e in fit.field().reshape(-1)]
        move = [v[i] if self.kinds[0] == "od_lambda" else est.ud_acceleration("symmetric", i) for i in range(self.dim)]
        square = lambda u: sum((u[i] * u[j] * float(a[i, j]) for i in range(self.dim) for j in range(self.dim)), F.lit(0.0)) * est.step()
        ok = mask(["dX"] if self.kinds[0] == "od_lambda" else ["dX", "dX_minus"])
        row = model.rows.where(ok).agg(F.sum(square([m - g for m, g in zip(move, f, strict=True)])).alias("r"), F.sum(square(move)).alias("n")).first()
        return row["r"] / row["n"]

    def summary(self, fit: Fit) -> list[dict]:
        """A row per feature of the support: label, coefficient, standard error, and their ratio."""
        return [
            {"feature": fit.basis.labels[i], "coefficient": float(fit.coefficients[i]), "stderr": float(e), "ratio": float(abs(fit.coefficients[i]) / e) if e else math.inf}
            for i, e in enumerate(fit.stderr) if i in set(fit.support)
        ]

    def compare_to_exact(self, fit: Fit, exact: Sequence) -> dict[str, float]:
        """Mean squared error of the force in units of the noise, and normalised by the fitted force's own square."""
        ai, d = self.inverse, self.dim
        f = [e.column() for e in fit.field().reshape(-1)]
        e = [f[i] - exact[i].column() for i in range(d)]
        square = lambda u: sum((u[i] * u[j] * float(ai[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
        row = self.rows.where(mask(["X"])).agg(F.avg(square(e)).alias("mse"), F.avg(square(f)).alias("norm")).first()
        return {"mse": row["mse"], "norm": row["norm"], "nmse": row["mse"] / (row["norm"] + 1e-12)}


class Overdamped(Langevin):
    """dx = F dt + sqrt(2 D) dW, seen with localisation noise."""

    reach = (-1, 1, 2)
    kinds = ("od_lambda", "od_msd", "od_noisy", "od_weak")

    def preset(self, name: str) -> tuple[str, str]:
        if name == "auto":
            _ = self.inverse
            name = "robust" if np.trace(self.noise) > 0 else "clean"
        return OD_PRESETS[name.lower()]

    def _gram(self, basis: Basis, mode: str) -> dict[str, Product]:
        now, after = placed(basis, 0, self.names), placed(basis, 1, self.names)
        weight = F.when(mask(["X"]), est.step())
        other = {"rectangle": [now], "trapeze": [now, after], "shift": [after]}[mode]
        return {f"g{k}": Product(now, against(b, self.inverse), weight) for k, b in enumerate(other)}

    def _moments(self, basis: Basis, mode: str) -> dict[str, Product]:
        d = self.dim
        dx = row_of([difference(f"x{i}", 0) for i in range(d)])
        one = lambda needs: F.when(mask(needs), F.lit(1.0))
        if mode == "ito":
            return {"m": Product(dx, against(placed(basis, 0, self.names), self.inverse), one(["dX"]))}
        if mode == "ito_shift":
            return {"m": Product(dx, against(placed(basis, -1, self.names), self.inverse), one(["dX", "X_minus"]))}
        out = {"m": Product(dx, against(mean(placed(basis, 0, self.names), placed(basis, 1, self.names)), self.inverse), one(["dX"]))}
        if mode == "strato":
            slope = against(placed(basis.d_x(), 0, self.names), self.inverse)  # feature, derivative n, component m
            noisy = row_of([est.tensor("od_noisy", m, n) for m in range(d) for n in range(d)])
            out["drift"] = Product(noisy, slope.transpose(0, 2, 1).reshape(len(slope), d * d), F.when(mask(est.NEEDS["od_noisy"]), est.step()))
        return out

    def force_gram(self, basis: Basis, mode: str) -> np.ndarray:
        """Sum of dt b A**-1 b over rows, by rectangles, trapezes, or shifted by a frame."""
        return self._solved(products(self.rows, self._gram(basis, mode)))[0]

    def force_moments(self, basis: Basis, mode: str) -> np.ndarray:
        """Sum of dX A**-1 b in Ito's sense (at the start, or a frame before), or Stratonovich's less its noise-induced part."""
        return self._solved(products(self.rows, self._moments(basis, mode)))[1]

    def infer_force(self, basis: Basis, preset: str = "auto") -> Fit:
        """One pass for the diffusion, and one for all sums of the Gram matrix and the moments."""
        m_mode, g_mode = self.preset(preset)
        g, m = self._solved(products(self.rows, self._gram(basis, g_mode) | self._moments(basis, m_mode)))
        return self.finish(basis, g, m, modes=[m_mode, g_mode])

    def infer_diffusion(self, basis: Basis, method: str = "noisy") -> Fit:
        """State-dependent diffusion over symmetric matrices, by per-row regression."""
        kind = f"od_{method}"
        return self._regress(placed(basis, 0, self.names), kind, F.when(mask(est.NEEDS[kind]), F.lit(1.0)), basis)

    def entropy_production(self, basis: Basis, gram: str = "auto") -> dict[str, float]:
        """Entropy produced along the tracks: 2 Mv G+ Mv with the current's moments, its bias 2 Nb, and its error."""
        g_mode = self.preset("auto")[1] if gram == "auto" else gram
        g, mv = self._solved(products(self.rows, self._gram(basis, g_mode) | self._moments(basis, "current")))
        total = float(2 * mv @ scaled_pinv((g + g.T) / 2) @ mv)
        n = len(mv)
        return {"delta_s": total, "debiased": total - 2 * n, "rate": (total - 2 * n) / self.tau, "error": math.sqrt(2 * max(total, 0) + (2 * n) ** 2)}


class Underdamped(Langevin):
    """dv = F(x, v) dt + sqrt(2 D) dW, seen through positions."""

    reach = (-2, -1, 1, 2)
    kinds = ("ud_lambda", "ud_msd", "ud_noisy", "ud_weak")

    def _kinematics(self, mode: str) -> tuple[list[Column], list[Column], list[Column], list[str]]:
        d = range(self.dim)
        needs = ["dX", "dX_plus"] if mode == "anticipated" else ["dX", "dX_minus"]
        needs = needs + ["dX_minus"] if mode == "anticipated" else needs
        return [est.ud_position(mode, i) for i in d], [est.ud_velocity(mode, i) for i in d], [est.ud_acceleration(mode, i) for i in d], needs

    def _gram(self, basis: Basis, mode: str) -> dict[str, Product]:
        d = range(self.dim)
        here = lambda k: ([at(f"x{i}", k) for i in d], [difference(f"x{i}", k) / est.step() for i in d])
        now, before, after = (moving(basis, *here(k)) for k in (0, -1, 1))
        pair = {
            "rectangle": [(now, now, ["dX"])], "shift": [(now, before, ["dX", "dX_minus"])],
            "trapeze": [(now, now, ["dX", "dX_minus"]), (now, before, ["dX", "dX_minus"])], "doubleshift": [(after, before, ["dX_plus", "dX_minus"])],
        }[mode]
        # Transposed, as the moments contract it: the second factor's features come first.
        return {f"g{k}": Product(against(b, self.inverse), a, F.when(mask(needs), est.step())) for k, (a, b, needs) in enumerate(pair)}

    def _moments(self, basis: Basis, mode: str, diffusion: str) -> dict[str, Product]:
        x, v, a, needs = self._kinematics(mode)
        kind = f"ud_{diffusion}"
        out = {"m": Product(row_of(a), against(moving(basis, x, v), self.inverse), F.when(mask(needs), est.step()))}
        if share := UD_SHIFT[mode]:
            d = self.dim
            slope = against(moving(basis.d_v(), x, v), share * self.inverse)  # feature, derivative m, component n
            inst = row_of([est.tensor(kind, m, n) for m in range(d) for n in range(d)])
            out["drift"] = Product(inst, slope.reshape(len(slope), d * d), F.when(mask([*needs, *est.NEEDS[kind]]), est.step()))
        return out

    def force_gram(self, basis: Basis, mode: str) -> np.ndarray:
        """As seen from secant velocities; all of them divide by the row's own step."""
        return self._solved(products(self.rows, self._gram(basis, mode)))[0]

    def force_moments(self, basis: Basis, mode: str, diffusion: str) -> np.ndarray:
        """Sum of dt a A**-1 b at the estimated position and velocity, less the share of noise in the velocity."""
        return self._solved(products(self.rows, self._moments(basis, mode, diffusion)))[1]

    def infer_force(self, basis: Basis, preset: str = "robust") -> Fit:
        """One pass for the diffusion, and one for all sums of the Gram matrix and the moments."""
        mode, g_mode, diffusion = UD_PRESETS["robust" if preset == "auto" else preset.lower()]
        g, m = self._solved(products(self.rows, self._gram(basis, g_mode) | self._moments(basis, mode, diffusion)))
        return self.finish(basis, g, m, modes=[mode, g_mode, diffusion])

    def infer_diffusion(self, basis: Basis, method: str = "noisy") -> Fit:
        kind, d = f"ud_{method}", range(self.dim)
        how = "weak" if method == "weak" else "noisy"
        x, v = [est.ud_position(how, i) for i in d], [est.ud_velocity(how, i) for i in d]
        ok = F.when(mask([*est.NEEDS[kind], "X_plusplus"] if how == "noisy" else est.NEEDS[kind]), F.lit(1.0))
        return self._regress(moving(basis, x, v), kind, ok, basis)

    def time_reversal_split(self, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """The reversible and irreversible parts of a force: even and odd in the velocity."""
        f = fit.field()
        flipped = np.vectorize(lambda e: e.bind({f"v{i}": -1.0 * _v(i) for i in range(self.dim)}), otypes=[object])(f)
        return (f + flipped) * 0.5, (f - flipped) * 0.5

    def entropy_production(self, basis: Basis, preset: str = "robust") -> dict[str, float]:
        """From a dictionary's odd part: 2 C.phi - 2 C G C over the features odd in velocity, its bias 2 rank, and its error."""
        fit = self.infer_force(basis, preset)
        odd = [a for a in range(basis.n_features) if _odd(basis, a, self.dim)]
        g, m, c = fit.gram[np.ix_(odd, odd)], fit.moments[odd], fit.coefficients[odd]
        total = float(2 * c @ m - 2 * c @ g @ c) if odd else 0.0
        rank = int(np.linalg.matrix_rank(g, tol=1e-5 * np.abs(g).max())) if odd else 0
        return {"delta_s": total, "debiased": total - 2 * rank, "rate": (total - 2 * rank) / self.tau, "error": math.sqrt(2 * abs(total) + (2 * rank) ** 2)}


def _v(i: int):
    from driftfield.functions.expr import Var

    return Var(f"v{i}")


def _odd(basis: Basis, a: int, dim: int) -> bool:
    """Whether a feature changes sign with the velocity, seen at a few fixed states."""
    rng = np.random.default_rng(0)
    env = {f"{c}{i}": rng.normal(size=5) for c in "xv" for i in range(dim)}
    there = basis[[a]].numpy(env)
    back = basis[[a]].numpy({k: -v if k[0] == "v" else v for k, v in env.items()})
    return bool(np.allclose(there, -back) and np.abs(there).max() > 0)
