"""Queries of residual diagnostics, dynamics order, selection, simulation and parametric fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import basis as bases
from driftfield.functions.expr import Var, tanh
from driftfield.operators import diagnostics as dg
from driftfield.operators import parametric, simulate
from driftfield.operators import sparse as sp
from driftfield.operators.linear import Fit, Overdamped, Underdamped
from driftfield.plans.overdamped import STREAMS_SQL, rounded
from driftfield.plans.underdamped import EVEN_SQL, even
from driftfield.sources.tables import LINES_SQL, events, lines

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


#: Residuals of a trap around 50 with rate 0.01, whitened with D = 500.
RESIDUAL_SQL = STREAMS_SQL + """,
z as (select dataset_id, time_idx, u - 0.01 * (50 - x0) * dt r, (u - 0.01 * (50 - x0) * dt) / sqrt(1000 * dt) z from l where u is not null)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.od_residuals(events(spark, sf_dir), [(50 - F.col("x0")) * 0.01], np.array([[500.0]]))


@register(
    "residual_moments",
    RESIDUAL_SQL + """,
s as (select count(*)::double n, avg(z) m, avg(z * z) m2, avg(z * z * z) m3, avg(z * z * z * z) m4 from z),
v as (select *, (m2 - m * m) * n / (n - 1) var from s)
select n::bigint n, round(m, 7) mean, round(sqrt(var), 7) std, round((m3 - 3 * m * m2 + 2 * m * m * m) / (sqrt(var) * var), 6) skew,
       round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / (var * var) - 3, 6) kurtosis from v""",
)
def residual_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dg.moments(residuals(spark, sf_dir))
    return m.select("n", rounded("mean", F.col("mean"), 7), rounded("std", F.col("std"), 7), rounded("skew", F.col("skew")), rounded("kurtosis", F.col("kurtosis")))


@register(
    "residual_covariance",
    f"""with {LINES_SQL},
l as (select a.*, b.x0 - a.x0 u, b.x1 - a.x1 v from traj a join traj b on b.dataset_id = a.dataset_id and b.time_idx = a.time_idx + 1),
z as (select u / sqrt(2.0) z0, (v - 0.5 * u) / sqrt(1.5) z1 from l)
select 0 i, 0 j, round(covar_samp(z0, z0), 6) cov from z union all select 0, 1, round(covar_samp(z0, z1), 6) from z union all select 1, 1, round(covar_samp(z1, z1), 6) from z""",
)
def residual_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of two whitened components, with a correlated diffusion."""
    z = dg.od_residuals(lines(spark, sf_dir), [F.lit(0.0), F.lit(0.0)], np.array([[1.0, 0.5], [0.5, 1.0]]))
    return dg.covariance(z, 2).select("i", "j", rounded("cov", F.col("cov")))


@register(
    "residual_acf_ljungbox",
    RESIDUAL_SQL + """,
c as (select dataset_id, row_number() over (partition by dataset_id order by time_idx) k, z - (select avg(z) from z) c from z),
a as (select x lag, (select sum(p.c * q.c) from c p join c q on p.dataset_id = q.dataset_id and p.k = q.k + x) / (select sum(c * c) from c) acf from (select unnest(range(1, 21)) x))
select lag::int lag, round(acf, 7) acf,
       round((select count(*) from c) * ((select count(*) from c) + 2.0) * sum(acf * acf / ((select count(*) from c) - lag)) over (order by lag), 5) q from a""",
)
def residual_acf_ljungbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = dg.autocorrelation(residuals(spark, sf_dir))
    return a.select("lag", rounded("acf", F.col("acf"), 7), rounded("q", F.col("q"), 5))


@register(
    "ks_statistic",
    RESIDUAL_SQL + """,
t as (select z, 1 / (1 + 0.2316419::double * abs(z)) t from z),
p as (select z, exp(-z * z / 2) / 2.5066282746310002 * (((((1.330274429::double * t - 1.821255978::double) * t + 1.781477937::double) * t - 0.356563782::double) * t + 0.319381530::double) * t) up from t),
f as (select case when z >= 0 then 1 - up else up end p, row_number() over (order by case when z >= 0 then 1 - up else up end) i, count(*) over () n from p)
select max(n)::bigint n, round(max(greatest(i / n - p, p - (i - 1) / n)), 6) ks from f""",
)
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = dg.ks_statistic(residuals(spark, sf_dir))
    return k.select("n", rounded("ks", F.col("ks")))


@register("mse_consistency", RESIDUAL_SQL + " select round(avg(z * z), 7) mean_square, round((avg(z * z) - 1) / sqrt(2.0 / count(*)), 6) z_score from z")
def mse_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dg.mse_consistency(residuals(spark, sf_dir), 1)
    return m.select(rounded("mean_square", F.col("mean_square"), 7), rounded("z_score", F.col("z_score")))


@register("four_point_test", RESIDUAL_SQL + " select count(*)::bigint n, round(covar_pop(a.z, b.z), 6) cov2 from z a join z b on a.dataset_id = b.dataset_id and a.time_idx = b.time_idx + 2")
def four_point_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dg.four_point(residuals(spark, sf_dir), "z0")
    return f.select("n", rounded("cov2", F.col("cov2")))


@register(
    "lag_covariances_scan",
    STREAMS_SQL + """,
e as (select dataset_id, s stride, time_idx // s k, x0, t from traj, (select unnest([1, 2, 4]) s) where time_idx % s = 0),
j as (select *, (lead(x0) over w) - x0 u, x0 - (lag(x0) over w) m, (lead(x0, 2) over w) - (lead(x0) over w) p, (lead(t) over w) - t dt
      from e window w as (partition by dataset_id, stride order by k))
select stride::int stride, count(u)::bigint n, round(sum(dt * u * u) / sum(dt), 4) c0,
       round(sum(case when m is not null then dt * u * m end) / sum(case when m is not null then dt end), 4) c1,
       round(sum(case when m is not null and p is not null then dt * m * p end) / sum(case when m is not null and p is not null then dt end), 4) c2
from j group by stride""",
)
def lag_covariances_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dg.lag_covariances(events(spark, sf_dir), [1, 2, 4])
    return c.select("stride", "n", *[rounded(k, F.col(k), 4) for k in ("c0", "c1", "c2")])


@register(
    "residual_innovations",
    RESIDUAL_SQL.replace("with ", "with recursive ", 1) + """,
n as (select l.dataset_id, l.time_idx, r, 1000 * dt + 20000 c from z join l using (dataset_id, time_idx)),
w as (
  select dataset_id, time_idx, c::double s, r::double e from n where time_idx = 0
  union all
  select n.dataset_id, n.time_idx, n.c - 100000000 / w.s, n.r + 10000 * w.e / w.s from w join n on n.dataset_id = w.dataset_id and n.time_idx = w.time_idx + 1)
select dataset_id, time_idx, round(e / sqrt(s), 6) z0 from w""",
)
def residual_innovations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential whitening under heavy localisation noise."""
    z = dg.od_residuals(events(spark, sf_dir), [(50 - F.col("x0")) * 0.01], np.array([[500.0]]), np.array([[10000.0]]))
    return z.select("dataset_id", "time_idx", rounded("z0", F.col("z0")))


@register(
    "ud_residuals",
    EVEN_SQL.replace("with ", "with recursive ", 1) + """,
n as (select dataset_id, time_idx, u - m + 0.2 * (u + m) / 2 r from l where u is not null and m is not null and time_idx % 2 = 1),
w as (
  select dataset_id, time_idx, (20 / 3 + 6)::double s, r::double e from n where time_idx = 1
  union all
  select n.dataset_id, n.time_idx, 20 / 3 + 6 - 1 / w.s, n.r - w.e / w.s from w join n on n.dataset_id = w.dataset_id and n.time_idx = w.time_idx + 2)
select dataset_id, time_idx, round(e / sqrt(s), 6) z0 from w""",
)
def ud_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of friction alone under localisation noise, whitened along every second frame."""
    z = dg.ud_residuals(even(spark, sf_dir), [F.col("v0") * -0.2], np.array([[5.0]]), np.array([[1.0]]))
    return z.select("dataset_id", "time_idx", rounded("z0", F.col("z0")))


@register(
    "ud_residuals_uneven",
    STREAMS_SQL + """
select dataset_id, time_idx, round((u - m) / (dt * dt) / sqrt(2.0 / 3 * 1000 / dt), 6) z0 from l where u is not null and m is not null and time_idx % 2 = 1""",
)
def ud_residuals_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is whitened with its own step."""
    z = dg.ud_residuals(events(spark, sf_dir), [F.lit(0.0)], np.array([[500.0]]))
    return z.select("dataset_id", "time_idx", rounded("z0", F.col("z0")))


@register("diagnostics_report")
def diagnostics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dg.assess(residuals(spark, sf_dir), 1)
    return spark.createDataFrame([(i, r.to_json(), ",".join(r.flags)) for i, r in enumerate(found)], "component int, report string, flags string")


@register("classify_dynamics")
def classify_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dg.classify_dynamics(even(spark, sf_dir))
    names = ("verdict", "aicc_gap", "v_significance", "persistence", "slope", "noise", "diffusion", "v2", "gamma")
    return spark.createDataFrame([tuple(getattr(r, n) for n in names)], "verdict string, " + ", ".join(f"{n} double" for n in names[1:]))


@register(
    "order_scaling",
    STREAMS_SQL.split(",\nl as")[0] + """,
e as (select dataset_id, s stride, time_idx // s k, x0, t from traj, (select unnest([1, 2, 4]) s) where time_idx % s = 0),
j as (select *, (lead(x0) over w) - x0 u, x0 - (lag(x0) over w) m, (lead(x0, 2) over w) - (lead(x0) over w) p, (lead(t) over w) - t dt
      from e window w as (partition by dataset_id, stride order by k)),
c as (
  select stride, sum(dt * u * u) / sum(dt) c0, sum(case when m is not null then dt * u * m end) / sum(case when m is not null then dt end) c1,
         sum(case when m is not null and p is not null then dt * m * p end) / sum(case when m is not null and p is not null then dt end) c2, avg(dt) dt from j group by stride)
select stride::int stride, round(c2 / (c0 + 2 * c1), 5) persistence, round((c0 + 2 * c1) / (dt * dt), 4) energy from c""",
)
def order_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the dynamics' order that localisation noise leaves alone, by stride."""
    table = [r.asDict() for r in dg.lag_covariances(events(spark, sf_dir), [1, 2, 4]).orderBy("stride").collect()]  # a row per stride
    dt, c = np.array([r["dt"] for r in table]), np.array([[r[f"c{k}"] for r in table] for k in range(3)])
    persistence, _ = dg.scaling(dt, c)
    energy = (c[0] + 2 * c[1]) / dt**2
    return spark.createDataFrame([(r["stride"], round(float(a), 5), round(float(b), 4)) for r, a, b in zip(table, persistence, energy, strict=True)], "stride int, persistence double, energy double")


def quartic(spark: SparkSession, sf_dir: str, degree: int = 4) -> tuple[Overdamped, Fit]:
    """A polynomial force fitted to the events. Their values hardly remember the last, so diffusion is estimated without room for noise."""
    model = Overdamped(events(spark, sf_dir).withColumn("x0", F.col("x0") / 100), 1)
    model.diffusion_constants("weak")
    return model, model.infer_force(bases.monomials_up_to(1, degree, "vector"), "clean")


def _selection(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, fit = quartic(spark, sf_dir)
        options = {"width": 3} if method == "beam" else {}
        front = sp.search(fit.gram, fit.moments, method, **options)
        return spark.createDataFrame(
            [(k, float(front.information[k]), ",".join(fit.basis.labels[i] for i in front.support[k])) for k in front.information], "k int, information double, support string"
        )

    return query


for _method in sp.STRATEGIES:
    register(f"sparsity_{_method}")(_selection(_method))


@register("sparsify_criteria")
def sparsify_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each information criterion picks from one front."""
    model, fit = quartic(spark, sf_dir)
    front = sp.search(fit.gram, fit.moments)
    names = ("AIC", "BIC", "EBIC", "PASTIS", "SIC")
    return spark.createDataFrame([(c, sp.select(front, c, n=len(fit.moments), tau=model.tau)) for c in names], "criterion string, k int")


TRAP = [Var("k") * -1.0 * Var("x0")]


@register("simulate_trap")
def simulate_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trapped particle's replicas: variance near D / k."""
    df = simulate.simulate(spark, [e.bind({"k": 2.0}) for e in TRAP], np.eye(1), replicas=16, frames=500, dt=0.05)
    return df.groupBy("dataset_id").agg(F.count("*").alias("n"), F.var_pop("x0").alias("variance"))


@register("simulate_inertial")
def simulate_inertial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simulate.simulate(spark, [-1.0 * Var("x0") - 0.5 * Var("v0")], np.eye(1), replicas=8, frames=500, dt=0.05, inertia=True)
    return df.groupBy("dataset_id").agg(F.count("*").alias("n"), F.var_pop("x0").alias("variance"))


@register("bootstrap_fit")
def bootstrap_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the model fitted to the events, refitted."""
    model, fit = quartic(spark, sf_dir, 1)
    again = Overdamped(simulate.bootstrap(spark, fit, model.diffusion, replicas=8, frames=300, dt=0.001), 1).infer_force(fit.basis, "clean")
    return spark.createDataFrame([(n, float(a), float(b)) for n, a, b in zip(fit.basis.labels, fit.coefficients, again.coefficients, strict=True)], "feature string, fitted double, refitted double")


@register(
    "entropy_production_ud",
    EVEN_SQL + """,
s as (select sum(x0 * (x0 + xm)) / 2 gxx, sum(u * (x0 + xm)) / 2 gxv, sum(x0 * (u + m)) / 2 gvx, sum(u * (u + m)) / 2 gvv from l where u is not null and m is not null),
k as (select sum(case when u is not null and m is not null then (u - m) * (xm + x0 + xp) / 3 end) mx,
         sum(case when u is not null and m is not null then (u - m) * (u + m) / 2 end)
         - sum(case when m is not null and p is not null then (-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 11 end) mv, count(u) tau from l),
d as (
  select avg((10 * u * u + m * m + p * p + 8 * p * m - 10 * u * p - 10 * u * m) / 44) lam, avg((-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 11) noisy,
         (select avg((2 * u - m - p) * (2 * u - m - p) / 2) from l where m is not null and p is not null) weak from l where m is not null and p is not null),
f as (select *, (mv * gxx - mx * gvx) / (gxx * gvv - gxv * gvx) cv, 2 * case when lam > 0 then noisy else weak end a from s, k, d),
y as (select *, (2 * cv * mv - 2 * cv * cv * gvv) / a total from f)
select round(total, 4) delta_s, round(total - 2, 4) debiased, round((total - 2) / tau, 8) rate, round(sqrt(2 * abs(total) + 4), 5) error from y""",
)
def entropy_production_ud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Underdamped(even(spark, sf_dir), 1).entropy_production(bases.linear(1, with_v=True).vectorize())
    digits = {"delta_s": 4, "debiased": 4, "rate": 8, "error": 5}
    return spark.createDataFrame([tuple(round(float(e[k]), n) for k, n in digits.items())], ", ".join(f"{k} double" for k in digits))


@register("parametric_trap")
def parametric_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saturating force around an unknown centre, fitted by likelihood to all events in steps of one."""
    force = [Var("a") * -1.0 * tanh((Var("x0") - Var("c")) * 0.5)]
    fit = parametric.infer(even(spark, sf_dir), force, {"a": 1.0, "c": 4.0}, rounds=4, profile=False)
    return spark.createDataFrame([(k, float(v), float(fit.diffusion)) for k, v in fit.theta.items()], "parameter string, value double, diffusion double")
