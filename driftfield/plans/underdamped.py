"""Queries of underdamped estimation on the events table, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import basis as bases
from driftfield.operators import estimators as est
from driftfield.operators.linear import Underdamped
from driftfield.operators.reduce import integrate
from driftfield.operators.streams import at, difference, mask, with_streams
from driftfield.plans.overdamped import rounded
from driftfield.sources.tables import EVENTS_SQL, events

QUERIES = {}
ORACLES = {}

#: Unit time steps: the event's number stands for its time, since kinematics presume even sampling.
EVEN_SQL = f"""with {EVENTS_SQL},
e as (select dataset_id, time_idx, time_idx::double t, x0 / 10 x0 from traj),
l as (
  select *, lead(x0) over w xp, lag(x0) over w xm, lead(x0, 2) over w xpp, lag(x0, 2) over w xmm,
         (lead(x0) over w) - x0 u, x0 - (lag(x0) over w) m, (lead(x0, 2) over w) - (lead(x0) over w) p
  from e window w as (partition by dataset_id order by time_idx))"""
#: Hours between events, uneven.
UNEVEN_SQL = f"""with {EVENTS_SQL},
l as (
  select *, (lead(x0) over w) - x0 u, x0 - (lag(x0) over w) m, (lead(x0, 2) over w) - (lead(x0) over w) p,
         (lead(t) over w) - t d, t - (lag(t) over w) dm, (lead(t, 2) over w) - (lead(t) over w) dp
  from traj window w as (partition by dataset_id order by time_idx))"""


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def even(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("dataset_id", "particle_id", "time_idx", F.col("time_idx").cast("double").alias("t"), (F.col("x0") / 10).alias("x0"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_streams(even(spark, sf_dir), (-2, -1, 1, 2), ["x0"])


KINDS = {
    "ud_lambda": ("(10 * u * u + m * m + p * p + 8 * p * m - 10 * u * p - 10 * u * m) / 44", "m is not null and p is not null"),
    "ud_msd": ("(u - m) * (u - m) * 0.75", "u is not null and m is not null"),
    "ud_weak": ("(2 * u - m - p) * (2 * u - m - p) / 2", "m is not null and p is not null"),
    "ud_noisy": ("(-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 11", "m is not null and p is not null"),
}


def _constant(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = rows(spark, sf_dir)
        one = integrate(s, {"value": est.tensor(kind, 0, 0)}, {"value": est.NEEDS[kind]}, weight_by_dt=False, mean=True, by=["dataset_id"])
        return one.where("value is not null").select("dataset_id", rounded("value", F.col("value"), 6))

    return query


for _kind, (_term, _ok) in KINDS.items():
    _name = _kind if _kind == "ud_lambda" else "ud_d_" + _kind[3:]
    register(_name, EVEN_SQL + f' select dataset_id, round(avg({_term}), 6) "value" from l where {_ok} group by dataset_id')(_constant(_kind))


@register(
    "ud_d_noisy_uneven",
    UNEVEN_SQL + """,
q as (select *, dm - d dv, dp - d dw, d + (dm + dp - 2 * d) / 3 mean from l where m is not null and p is not null)
select count(*)::bigint n, round(avg((-u * u + m * m + p * p - 3 * p * m + u * p + u * m - (dv * dv + dw * dw - 3 * dv * dw) * p * m / (dm * dp)) * 3 / 11 * mean), 5) weighted
from q where mean > 0""",
)
def ud_d_noisy_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uneven-sampling form, weighted by the fourth power of the mean step so that short steps don't rule."""
    s = with_streams(events(spark, sf_dir), (-1, 1, 2), ["x0"])
    mean = est.step() + (est.step(-1) + est.step(1) - 2 * est.step()) / 3
    value = est.tensor("ud_noisy", 0, 0) * mean * mean * mean * mean
    ok = mask(est.NEEDS["ud_noisy"]) & (mean > 0)
    return s.where(ok).agg(F.count("*").alias("n"), rounded("weighted", F.avg(value), 5))


def _kinematics(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = rows(spark, sf_dir)
        needs = ["dX", "dX_minus", "dX_plus"] if mode == "anticipated" else ["dX", "dX_minus"]
        out = [est.ud_position(mode, 0), est.ud_velocity(mode, 0), est.ud_acceleration(mode, 0)]
        return s.where(mask(needs)).select("dataset_id", "time_idx", *[rounded(n, c) for n, c in zip("xva", out, strict=True)])

    return query


for _mode, _cols, _ok in (
    ("symmetric", "(xm + x0 + xp) / 3, (u + m) / 2, u - m", "u is not null and m is not null"),
    ("early", "x0, m, u - m", "u is not null and m is not null"),
    ("anticipated", "(x0 + xp + xpp) / 3, m, p - u", "p is not null and m is not null"),
):
    _x, _v, _a = _cols.split(", ")
    register(f"ud_kinematics_{_mode}", EVEN_SQL + f" select dataset_id, time_idx, round({_x}, 6) x, round({_v}, 6) v, round({_a}, 6) a from l where {_ok}")(_kinematics(_mode))


def _gram(mode: str):
    """Gram matrices of (x, v), row by row of the first factor's frame."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = rows(spark, sf_dir)
        here = lambda k: (at("x0", k) / 10, difference("x0", k) / 10 / est.step())
        pairs = {
            "rectangle": [(0, 0, ["dX"])], "shift": [(0, -1, ["dX", "dX_minus"])], "trapeze": [(0, 0, ["dX", "dX_minus"]), (0, -1, ["dX", "dX_minus"])],
            "doubleshift": [(1, -1, ["dX_plus", "dX_minus"])],
        }[mode]
        needs = pairs[0][2]
        terms = {f"g{j}{i}": sum((here(a)[i] * here(b)[j] for a, b, _ in pairs), F.lit(0.0)) / len(pairs) for i in range(2) for j in range(2)}
        return integrate(s, terms, dict.fromkeys(terms, needs), mean=True).select(*[rounded(k, F.col(k), 7) for k in sorted(terms)])

    return query


for _mode, _pairs, _ok in (
    ("rectangle", [("x0", "u", "x0", "u")], "u is not null"),
    ("shift", [("x0", "u", "xm", "m")], "u is not null and m is not null"),
    ("trapeze", [("x0", "u", "x0", "u"), ("x0", "u", "xm", "m")], "u is not null and m is not null"),
    ("doubleshift", [("xp", "p", "xm", "m")], "p is not null and m is not null"),
):
    _cells = [
        f"round(avg(({' + '.join(f'{q[i]} / 10 * {q[2 + j]} / 10' for q in _pairs)}) / {len(_pairs)}), 7) g{j}{i}" for i in range(2) for j in range(2)
    ]
    register(f"ud_gram_{_mode}", EVEN_SQL + f" select {', '.join(_cells)} from l where {_ok}")(_gram(_mode))


@register(
    "ud_moments_phi",
    EVEN_SQL + """
select round(avg(case when u is not null and m is not null then (u - m) * (xm + x0 + xp) / 30 end), 7) mx,
       round((sum(case when u is not null and m is not null then (u - m) * (u + m) / 20 end)
         - sum(case when m is not null and p is not null then (-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 110 end))
         / count(case when u is not null and m is not null then 1 end), 7) mv
from l""",
)
def ud_moments_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of acceleration with (x, v), the velocity's less the noise-induced part (weight 1: symmetric secants)."""
    s = rows(spark, sf_dir)
    x, v, a = (f("symmetric", 0) for f in (est.ud_position, est.ud_velocity, est.ud_acceleration))
    terms = {"mx": a * x / 10, "mv": a * v / 10, "n": F.lit(1.0), "drift": est.tensor("ud_noisy", 0, 0) / 10}
    needs = dict.fromkeys(("mx", "mv", "n"), ["dX", "dX_minus"]) | {"drift": est.NEEDS["ud_noisy"]}
    f = integrate(s, terms, needs)
    return f.select(rounded("mx", F.col("mx") / F.col("n"), 7), rounded("mv", (F.col("mv") - F.col("drift")) / F.col("n"), 7))


@register(
    "ud_fit_p2",
    EVEN_SQL + """,
s as (select sum(x0 * (x0 + xm)) / 2 gxx, sum(u * (x0 + xm)) / 2 gxv, sum(x0 * (u + m)) / 2 gvx, sum(u * (u + m)) / 2 gvv from l where u is not null and m is not null),
k as (select sum(case when u is not null and m is not null then (u - m) * (xm + x0 + xp) / 3 end) mx,
         sum(case when u is not null and m is not null then (u - m) * (u + m) / 2 end)
         - sum(case when m is not null and p is not null then (-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 11 end) mv from l)
select round((mx * gvv - mv * gxv) / (gxx * gvv - gxv * gvx), 6) cx, round((mv * gxx - mx * gvx) / (gxx * gvv - gxv * gvx), 6) cv from s, k""",
)
def ud_fit_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference object: a force linear in position and velocity, robust preset."""
    fit = Underdamped(even(spark, sf_dir), 1).infer_force(bases.linear(1, with_v=True).vectorize(), "robust")
    return spark.createDataFrame([tuple(round(float(c), 6) for c in fit.coefficients)], "cx double, cv double")


def _preset(name: str, gram: tuple[str, str, str, str], need: str, mx: str, mv: str, drift: str):
    """``gram`` has xx, xv, vx, vv: the second factor's feature first."""
    sql = EVEN_SQL + f""",
s as (select {", ".join(f"sum({x}) {k}" for x, k in zip(gram, ("gxx", "gxv", "gvx", "gvv"), strict=True))} from l where {need}),
k as (select sum(case when u is not null and m is not null then {mx} end) mx, sum(case when u is not null and m is not null then {mv} end) - {drift} mv from l)
select round((mx * gvv - mv * gxv) / (gxx * gvv - gxv * gvx), 6) cx, round((mv * gxx - mx * gvx) / (gxx * gvv - gxv * gvx), 6) cv from s, k"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fit = Underdamped(even(spark, sf_dir), 1).infer_force(bases.linear(1, with_v=True).vectorize(), name)
        return spark.createDataFrame([tuple(round(float(c), 6) for c in fit.coefficients)], "cx double, cv double")

    register(f"ud_infer_force_{name.replace('-', '_')}", sql)(query)


_TRAPEZE = ("x0 * (x0 + xm) / 2", "u * (x0 + xm) / 2", "x0 * (u + m) / 2", "u * (u + m) / 2")
_RECTANGLE = ("x0 * x0", "x0 * u", "x0 * u", "u * u")
_SYMMETRIC = ("(u - m) * (xm + x0 + xp) / 3", "(u - m) * (u + m) / 2")
_preset("clean", _TRAPEZE, "u is not null and m is not null", *_SYMMETRIC, "sum(case when m is not null and p is not null then (2 * u - m - p) * (2 * u - m - p) / 2 end)")
_preset("legacy-noisy", _RECTANGLE, "u is not null", *_SYMMETRIC, "sum(case when m is not null and p is not null then (-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 11 end)")
_preset("legacy-clean", _RECTANGLE, "u is not null", "(u - m) * x0", "(u - m) * m", "sum(case when u is not null and m is not null then (u - m) * (u - m) * 0.25 end)")


@register(
    "ud_diffusion_linear",
    EVEN_SQL + """
select round(avg((-u * u + m * m + p * p - 3 * p * m + u * p + u * m) * 3 / 11), 5) d0 from l where m is not null and p is not null and xpp is not null""",
)
def ud_diffusion_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = Underdamped(even(spark, sf_dir), 1).infer_diffusion(bases.identity_matrix(1))
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 5),)], "d0 double")
