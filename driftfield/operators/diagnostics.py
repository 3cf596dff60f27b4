"""Residuals of fitted models and what they should look like; classification of the dynamics' order."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.functions.numerics import chi2_sf, gauss_newton, ks_pvalue, scaled_pinv
from driftfield.operators import estimators as est
from driftfield.operators.streams import difference, mask, with_streams

#: Below this share of the thermal noise, localisation noise is left out of whitening.
SMALL_NOISE = 0.2
#: Coefficients of the rational approximation of the normal distribution (Abramowitz and Stegun 26.2.17).
PHI = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
PHI_P = 0.2316419


def norm_cdf(x: Column) -> Column:
    """The normal distribution function as an expression, to 7.5e-8."""
    t = 1 / (1 + PHI_P * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(PHI):
        poly = (poly + c) * t
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def od_residuals(df: DataFrame, force: Sequence[Column], diffusion: np.ndarray, noise: np.ndarray | None = None) -> DataFrame:
    """Whitened residuals z0.. of dX - F dt, with covariance dt A + 2 L.

    If the localisation noise L is small beside the thermal part, whitening is
    row by row. If not, steps are correlated: innovations follow from a recursion
    along each track, restarted at gaps, in batches of whole tracks.
    """
    dim = len(force)
    rows = with_streams(df, (-1, 1), [f"x{i}" for i in range(dim)]).where(mask(["dX"]))
    rows = rows.select("dataset_id", "particle_id", "time_idx", est.step().alias("dt"), *[(difference(f"x{i}", 0) - force[i] * est.step()).alias(f"r{i}") for i in range(dim)])
    return _whitened(rows, 2 * np.asarray(diffusion, float), noise, dim, F.col("dt"), F.lit(2.0), F.lit(-1.0), 1)


def _whitened(rows: DataFrame, a: np.ndarray, noise: np.ndarray | None, dim: int, thermal: Column, own: Column, shared: Column, stride: int) -> DataFrame:
    """z0.. of residuals r0.. whose covariance is thermal A + own L, with shared L between rows ``stride`` frames apart.

    Where own L is small beside thermal A in the mean, it is left out.
    """
    if noise is not None and np.any(noise):
        noise = np.asarray(noise, float)
        mean = rows.agg(F.avg(thermal), F.avg(own)).first()
        if mean[0] is not None and np.trace(noise) * mean[1] >= SMALL_NOISE * np.trace(a) * mean[0]:
            return innovations(rows, a, noise, dim, thermal, own, shared, stride)
    w = np.linalg.inv(np.linalg.cholesky(a))
    return rows.withColumns({f"z{i}": sum((F.col(f"r{j}") * float(w[i, j]) for j in range(i + 1)), F.lit(0.0)) / F.sqrt(thermal) for i in range(dim)})


def innovations(rows: DataFrame, a: np.ndarray, noise: np.ndarray, dim: int, thermal: Column, own: Column, shared: Column, stride: int = 1) -> DataFrame:
    """Sequential whitening of residuals whose neighbours share O = shared L: S_k = C_k - O S_{k-1}^-1 O, e_k = r_k - O S_{k-1}^-1 e_{k-1}."""
    schema = rows.schema.simpleString()[7:-1] + "".join(f",z{i}:double" for i in range(dim))

    def run(pdf):
        pdf = pdf.sort_values("time_idx")
        r, k = pdf[[f"r{i}" for i in range(dim)]].to_numpy(), pdf["time_idx"].to_numpy()
        c = pdf["thermal_"].to_numpy()[:, None, None] * a + pdf["own_"].to_numpy()[:, None, None] * noise
        off = pdf["shared_"].to_numpy()[:, None, None] * noise
        z = np.empty_like(r)
        s = e = None
        for t in range(len(r)):
            if t and k[t] == k[t - 1] + stride:
                gain = off[t] @ np.linalg.inv(s)
                s, e = c[t] - gain @ off[t], r[t] - gain @ e
            else:
                s, e = c[t], r[t]
            z[t] = np.linalg.solve(np.linalg.cholesky(s), e)
        for i in range(dim):
            pdf[f"z{i}"] = z[:, i]
        return pdf.drop(columns=["thermal_", "own_", "shared_"])

    scaled = rows.withColumns({"thermal_": thermal.cast("double"), "own_": own.cast("double"), "shared_": shared.cast("double")})
    return scaled.groupBy("dataset_id", "particle_id").applyInPandas(run, schema)


def ud_residuals(df: DataFrame, force: Sequence[Column], diffusion: np.ndarray, noise: np.ndarray | None = None) -> DataFrame:
    """Whitened residuals of the secant acceleration, every second frame of a dataset from its second on.

    Covariance 2/3 A / dt + 6 L / dt ** 4 with each row's own step; rows two
    frames apart share L / dt ** 4. ``force`` may use x0.. and v0.., which stand
    for the mean of three positions and the secant velocity.
    """
    dim = len(force)
    first = df.groupBy("dataset_id").agg(F.min("time_idx").alias("first_"))  # a row per dataset
    rows = with_streams(df, (-1, 1), [f"x{i}" for i in range(dim)]).where(mask(["dX", "dX_minus"])).join(first, "dataset_id")
    rows = rows.where((F.col("time_idx") - F.col("first_")) % 2 == 1)
    acc = [est.ud_acceleration("symmetric", i).alias(f"a{i}") for i in range(dim)]
    state = [est.ud_position("symmetric", i).alias(f"x{i}") for i in range(dim)] + [est.ud_velocity("symmetric", i).alias(f"v{i}") for i in range(dim)]
    rows = rows.select("dataset_id", "particle_id", "time_idx", est.step().alias("dt"), *acc, *state)
    rows = rows.select("dataset_id", "particle_id", "time_idx", "dt", *[(F.col(f"a{i}") - force[i]).alias(f"r{i}") for i in range(dim)])
    dt = F.col("dt")
    fourth = 1 / (dt * dt * dt * dt)
    return _whitened(rows, 2 * np.asarray(diffusion, float), noise, dim, 2 / (3 * dt), 6 * fourth, fourth, 2)


def moments(rows: DataFrame, name: str = "z0") -> DataFrame:
    """n, mean, std (n - 1), skewness and excess kurtosis, the last two by the sample's std; from power sums in one pass."""
    z = F.col(name)
    s = rows.agg(F.count(z).cast("double").alias("n"), F.avg(z).alias("m"), F.avg(z * z).alias("m2"), F.avg(z * z * z).alias("m3"), F.avg(z * z * z * z).alias("m4"))
    n, m = F.col("n"), F.col("m")
    var = (F.col("m2") - m * m) * n / (n - 1)
    c3 = F.col("m3") - 3 * m * F.col("m2") + 2 * m * m * m
    c4 = F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * m * m * m * m
    std = F.sqrt(var)
    return s.select(n.cast("long").alias("n"), m.alias("mean"), std.alias("std"), (c3 / (std * std * std)).alias("skew"), (c4 / (var * var) - 3).alias("kurtosis"))


def covariance(rows: DataFrame, dim: int) -> DataFrame:
    """(i, j, cov): sample covariances of the components z0.. of whitened residuals, in one pass."""
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    one = rows.agg(*[F.covar_samp(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs]
    return one.select(F.inline(F.array(*cells)))


def autocorrelation(rows: DataFrame, name: str = "z0", lags: int = 20, keys: Sequence[str] = ("dataset_id", "particle_id")) -> DataFrame:
    """(lag, acf, q): pooled autocorrelation within tracks, gaps closed up, and the Ljung-Box sum up to that lag."""
    order = Window.partitionBy(*keys).orderBy("time_idx")
    mean = rows.agg(F.avg(name).alias("mean_"), F.count(name).alias("n_"))
    z = rows.crossJoin(F.broadcast(mean)).withColumn("c_", F.col(name) - F.col("mean_"))
    sums = z.withColumns({f"l{k}": F.lag("c_", k).over(order) for k in range(1, lags + 1)})
    one = sums.agg(F.first("n_").cast("double").alias("n"), F.sum(F.col("c_") * F.col("c_")).alias("s0"), *[F.sum(F.col("c_") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    each = one.select("n", "s0", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(1, lags + 1)])))
    acf = F.col("s") / F.col("s0")
    upto = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(acf * acf / (F.col("n") - F.col("lag"))).over(upto)
    return each.select("lag", acf.alias("acf"), q.alias("q"))


def ks_statistic(rows: DataFrame, name: str = "z0", buckets: int = 1024) -> DataFrame:
    """The Kolmogorov-Smirnov distance from the normal law.

    Ranks come from counts per bucket of the distribution function and ranks
    inside buckets, so the sample is never sorted in one place.
    """
    z = rows.select(F.col(name).alias("z")).where("z is not null").withColumn("p", norm_cdf(F.col("z")))
    z = z.withColumn("b", F.least(F.lit(buckets - 1), F.floor(F.col("p") * buckets)))
    counts = z.groupBy("b").agg(F.count("*").alias("k"))
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("b", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("ahead"), F.sum("k").over(Window.partitionBy(F.lit(1))).cast("double").alias("n"))
    ranked = z.join(counts, "b").withColumn("i", F.col("ahead") + F.row_number().over(Window.partitionBy("b").orderBy("p")))
    gap = F.greatest(F.col("i") / F.col("n") - F.col("p"), F.col("p") - (F.col("i") - 1) / F.col("n"))
    return ranked.agg(F.max("n").cast("long").alias("n"), F.max(gap).alias("ks"))


def mse_consistency(rows: DataFrame, dim: int) -> DataFrame:
    """The mean of |z| ** 2 less dim, as a z-score, and per component."""
    sq = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(dim)), F.lit(0.0))
    s = rows.agg(F.count("*").cast("double").alias("n"), F.avg(sq).alias("m"))
    return s.select(F.col("m").alias("mean_square"), ((F.col("m") - dim) / F.sqrt(2 * dim / F.col("n"))).alias("z_score"))


def four_point(rows: DataFrame, name: str = "r0") -> DataFrame:
    """Covariance of residuals two frames apart, which noise in positions leaves at 0."""
    order = Window.partitionBy("dataset_id", "particle_id").orderBy("time_idx")
    two = F.when(F.lag("time_idx", 2).over(order) == F.col("time_idx") - 2, F.lag(name, 2).over(order))
    return rows.withColumn("two_", two).agg(F.count("two_").alias("n"), F.covar_pop(name, "two_").alias("cov2"))


@dataclass
class Report:
    n: int
    mean: float
    std: float
    skew: float
    kurtosis: float
    ks: float
    ks_p: float
    q: float
    q_p: float
    q_square: float
    q_square_p: float
    z_score: float
    flags: list[str]

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)


def assess(rows: DataFrame, dim: int, alpha: float = 0.01, lags: int = 20) -> list[Report]:
    """A report per component of the whitened residuals."""
    out = []
    consistency = mse_consistency(rows, dim).first()
    for i in range(dim):
        name = f"z{i}"
        m, ks = moments(rows, name).first(), ks_statistic(rows, name).first()
        q = autocorrelation(rows, name, lags).orderBy(F.desc("lag")).first()["q"]
        q2 = autocorrelation(rows.withColumn(name, F.col(name) * F.col(name)), name, lags).orderBy(F.desc("lag")).first()["q"]
        flags = []
        ks_p, q_p, q2_p = ks_pvalue(ks["ks"], ks["n"]), chi2_sf(q, lags), chi2_sf(q2, lags)
        if abs(m["mean"]) > 4 / math.sqrt(m["n"]):
            flags.append("mean")
        if not 0.5 <= m["std"] <= 2:
            flags.append("scale")
        for name_, p in (("normality", ks_p), ("autocorrelation", q_p), ("volatility", q2_p)):
            if p < alpha:
                flags.append(name_)
        if abs(consistency["z_score"]) > 5:
            flags.append("mse")
        out.append(Report(m["n"], m["mean"], m["std"], m["skew"], m["kurtosis"], ks["ks"], ks_p, q, q_p, q2, q2_p, consistency["z_score"], flags))
    return out


def lag_covariances(df: DataFrame, strides: Sequence[int], dim: int = 1) -> DataFrame:
    """(stride, n, n_pair, dt, c0, c1, c2): traces of the displacements' covariances at lags 0, 1, 2, for every stride in one job.

    Rows of all strides are exploded from one scan; each stride keeps the frames
    that it divides, renumbered. Means are weighted by dt.
    """
    rows = df.withColumn("stride", F.explode(F.array(*[F.lit(s) for s in strides]))).where("time_idx % stride = 0")
    rows = rows.withColumn("time_idx", (F.col("time_idx") / F.col("stride")).cast("long"))
    rows = with_streams(rows, (-1, 1, 2), [f"x{i}" for i in range(dim)], keys=("dataset_id", "particle_id", "stride"))
    out = [F.count(F.when(mask(["dX"]), 1)).alias("n"), F.count(F.when(mask(["dX_minus", "dX_plus"]), 1)).alias("n_pair"), F.avg(F.when(mask(["dX"]), est.step())).alias("dt")]
    for k in range(3):
        kind = f"lag{k}"
        ok = mask(est.NEEDS[kind])
        trace = sum((est.tensor(kind, i, i) for i in range(dim)), F.lit(0.0)) / dim
        out.append((F.sum(F.when(ok, trace * est.step())) / F.sum(F.when(ok, est.step()))).alias(f"c{k}"))
    return rows.groupBy("stride").agg(*out)


def order_model(dt: np.ndarray, noise: float, d: float, v2: float, gamma: float) -> np.ndarray:
    """Covariances at lags 0, 1, 2 of displacements over dt: noise, diffusion, and a velocity that forgets at rate gamma."""
    g = np.maximum(gamma, 1e-12) * dt
    free = 2 * v2 * dt**2 * np.where(g < 1e-4, 0.5 - g / 6, (g - 1 + np.exp(-g)) / g**2)
    shared = v2 * dt**2 * np.where(g < 1e-4, 1 - g, ((1 - np.exp(-g)) / g) ** 2)
    return np.stack([2 * noise + 2 * d * dt + free, -noise + shared, shared * np.exp(-g)])


#: The AICc gap and the significance of the velocity's variance from which inertia is preferred, and the
#: lag-2 persistence at the finest step above which it is resolved, and below which the data look overdamped.
AICC_MARGIN, V_SIGNIFICANCE = 2.0, 3.0
RESOLVED, UNRESOLVED = 0.15, 0.05


@dataclass
class OrderReport:
    verdict: str
    aicc_gap: float
    v_significance: float
    persistence: float
    slope: float
    noise: float
    diffusion: float
    v2: float
    gamma: float
    table: list[dict]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def scaling(dt: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """From covariances at lags 0, 1, 2 over steps dt, free of localisation noise: the lag-2 persistence
    c2 / (c0 + 2 c1) at each step, and the power of dt that the apparent kinetic energy (c0 + 2 c1) / dt ** 2 follows."""
    free = c[0] + 2 * c[1]
    persistence = np.divide(c[2], free, out=np.zeros_like(free), where=free != 0)
    energy = free / dt**2
    good = energy > 0
    return persistence, float(np.polyfit(np.log(dt[good]), np.log(energy[good]), 1)[0]) if good.sum() > 1 else math.nan


def classify_dynamics(df: DataFrame, dim: int = 1, most: int = 6, least_rows: int = 200) -> OrderReport:
    """Overdamped or underdamped, from how displacement covariances scale with the stride.

    A full model (noise, diffusion, velocity and its rate) is fitted against one
    without a velocity, weighted by the number of samples. Inertia is preferred if
    the AICc gap and the velocity's significance are large; the verdict also asks
    for the lag-2 persistence at the finest step.
    """
    frames = df.agg(F.max("time_idx") + 1).first()[0]
    strides = [2**k for k in range(most) if frames // 2**k >= min(least_rows, frames)]
    table = [r.asDict() for r in lag_covariances(df, strides or [1], dim).orderBy("stride").collect()]  # a row per stride
    dt = np.array([r["dt"] for r in table])
    c = np.array([[r[f"c{k}"] or 0.0 for r in table] for k in range(3)])
    weight = np.sqrt(np.maximum([r["n_pair"] for r in table], 1)) / max(float(np.median(np.abs(c[0]))), 1e-12)
    scale = max(c[0].max(), 1e-300)
    top = np.array([scale, scale / dt.min(), scale / dt.min() ** 2, 1e3 / dt.min()])
    slowest = 1e-3 / dt.max() / top[3]

    def residual(full: np.ndarray) -> np.ndarray:
        return ((order_model(dt, *(full * top)) - c) * weight).ravel()

    def fit(free: Sequence[int]) -> tuple[np.ndarray, float]:
        spread = lambda x: np.array([x[list(free).index(k)] if k in free else 0.0 for k in range(4)])
        low = np.array([slowest if k == 3 else 0.0 for k in free])
        guesses = [[c[0][0] / 2 / top[0], c[0][-1] / 2 / dt[-1] / top[1], max(c[2][0], 0) / dt[0] ** 2 / top[2], g / np.median(dt) / top[3]] for g in (0.1, 1.0, 10.0)]
        starts = [np.clip([x[k] for k in free], low, 1.0) for x in guesses] + [np.maximum(low, share) for share in (0.01, 0.1, 0.5)]
        return min((gauss_newton(lambda x: residual(spread(x)), s, low, np.ones(len(free))) for s in starts), key=lambda x: x[1])

    m = c.size
    aicc = lambda ssr, k: m * math.log(max(ssr, 1e-300) / m) + 2 * k + (2 * k * (k + 1) / (m - k - 1) if m > k + 1 else 0)
    x, null = fit([0, 1, 2, 3])[0], fit([0, 1])[0]
    ssr, ssr0 = (float((residual(v) ** 2).sum()) for v in (x, np.append(null, [0.0, 0.0])))
    gap = aicc(ssr0, 2) - aicc(ssr, 4)
    h = 1e-6 * np.maximum(x, 1e-6)
    jac = np.stack([(residual(x + h * (np.arange(4) == k)) - residual(x - h * (np.arange(4) == k))) / (2 * h[k]) for k in range(4)], axis=1)
    variance = np.diag(scaled_pinv(jac.T @ jac)) * ssr / max(m - 4, 1)
    significance = float(x[2] / math.sqrt(variance[2])) if variance[2] > 0 else math.inf
    persistence, slope = scaling(dt, c)
    fine = float(persistence[int(np.argmin(dt))])
    inertia = gap > AICC_MARGIN and significance > V_SIGNIFICANCE
    verdict = "underdamped" if inertia and fine > RESOLVED else "overdamped" if not inertia or fine < UNRESOLVED else "inconclusive"
    noise, d, v2, gamma = (float(v) for v in x * top)
    return OrderReport(verdict, float(gap), significance, fine, slope, noise, d, v2, gamma, table)
