"""Queries of overdamped estimation on the events table, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import basis as bases
from driftfield.functions.numerics import norm_ppf
from driftfield.operators import estimators as est
from driftfield.operators.linear import Overdamped
from driftfield.operators.reduce import dataset_weights, exposure, integrate
from driftfield.operators.streams import at, difference, mask, with_streams
from driftfield.sources.tables import EVENTS_SQL, events

#: Streams of the events in SQL; l has them all.
STREAMS_SQL = f"""with {EVENTS_SQL},
l as (
  select *, lead(x0) over w xp, lag(x0) over w xm, lead(t) over w - t dt, t - lag(t) over w dtm,
         (lead(x0) over w) - x0 u, x0 - (lag(x0) over w) m, (lead(x0, 2) over w) - (lead(x0) over w) p,
         (lead(t, 2) over w) - (lead(t) over w) dtp
  from traj window w as (partition by dataset_id order by time_idx))"""

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_streams(events(spark, sf_dir), (-1, 1, 2), ["x0"])


def rounded(name: str, c: Column, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


@register(
    "stream_increments",
    f"""with {EVENTS_SQL},
g as (select * from traj where event_id % 11 <> 0)
select a.dataset_id, a.time_idx, round(b.x0 - a.x0, 6) dx, round(a.x0 - c.x0, 6) dx_minus, round(d.x0 - b.x0, 6) dx_plus, round(d.x0, 6) x_plusplus
from g a left join g b on b.dataset_id = a.dataset_id and b.time_idx = a.time_idx + 1
left join g c on c.dataset_id = a.dataset_id and c.time_idx = a.time_idx - 1
left join g d on d.dataset_id = a.dataset_id and d.time_idx = a.time_idx + 2""",
)
def stream_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps back, on and after next, with every eleventh event masked."""
    s = with_streams(events(spark, sf_dir).where("event_id % 11 != 0"), (-1, 1, 2), ["x0"])
    steps = {"dx": difference("x0", 0), "dx_minus": difference("x0", -1), "dx_plus": difference("x0", 1), "x_plusplus": at("x0", 2)}
    return s.select("dataset_id", "time_idx", *[rounded(k, v) for k, v in steps.items()])


@register(
    "valid_window_mask",
    f"""with {EVENTS_SQL},
g as (select * from traj where event_id % 11 <> 0)
select a.dataset_id, a.time_idx, b.t is not null ok_dx, b.t is not null and c.t is not null ok_noisy,
       b.t is not null and c.t is not null and d.t is not null ok_ud
from g a left join g b on b.dataset_id = a.dataset_id and b.time_idx = a.time_idx + 1
left join g c on c.dataset_id = a.dataset_id and c.time_idx = a.time_idx - 1
left join g d on d.dataset_id = a.dataset_id and d.time_idx = a.time_idx + 2""",
)
def valid_window_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_streams(events(spark, sf_dir).where("event_id % 11 != 0"), (-1, 1, 2), ["x0"])
    kinds = {"ok_dx": ["dX"], "ok_noisy": est.NEEDS["od_noisy"], "ok_ud": est.NEEDS["ud_noisy"]}
    return s.select("dataset_id", "time_idx", *[mask(n).alias(k) for k, n in kinds.items()])


@register(
    "teff_weights",
    STREAMS_SQL + """,
e as (select dataset_id, sum(case when dt is not null and dtm is not null then dt else 0 end) teff from l group by dataset_id)
select dataset_id, round(teff, 6) teff, round(case when teff > 0 then (select avg(teff) from e where teff > 0) / teff else 0 end, 6) weight from e""",
)
def teff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure of each user's series, and weights that make series count alike."""
    s, needs = rows(spark, sf_dir), ["dX", "dX_minus"]
    w = dataset_weights(s, "per_dataset", needs)
    return exposure(s, needs).join(w, "dataset_id").select("dataset_id", rounded("teff", F.col("teff")), rounded("weight", F.col("weight")))


KINDS = {
    "od_lambda": ("-u * m", "u is not null and m is not null"),
    "od_msd": ("u * u / dt / 2", "u is not null"),
    "od_noisy": ("(u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)", "u is not null and m is not null"),
    "od_weak": ("(u - m) * (u - m) / 4 / ((dt + dtm) / 2)", "u is not null and m is not null"),
}


def _constant(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = rows(spark, sf_dir)
        one = integrate(s, {"value": est.tensor(kind, 0, 0)}, {"value": est.NEEDS[kind]}, weight_by_dt=False, mean=True, by=["dataset_id"])
        return one.where("value is not null").select("dataset_id", rounded("value", F.col("value"), 5))

    return query


for _kind, (_term, _ok) in KINDS.items():
    register("od_d_" + _kind[3:] if _kind != "od_lambda" else _kind, STREAMS_SQL + f" select dataset_id, round(avg({_term}), 5) \"value\" from l where {_ok} group by dataset_id")(_constant(_kind))


@register(
    "od_auto_diffusion",
    STREAMS_SQL + """,
a as (select avg(-u * m) lam, avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) noisy, avg((u - m) * (u - m) / 4 / ((dt + dtm) / 2)) weak
      from l where u is not null and m is not null)
select round(lam, 5) lam, round(case when lam > 0 then noisy else weak end, 5) diffusion from a""",
)
def od_auto_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constant estimators in one pass, and the choice that the noise's sign makes."""
    model = Overdamped(events(spark, sf_dir), 1)
    model.diffusion_constants()
    return spark.createDataFrame([(round(float(model.noise[0, 0]), 5), round(float(model.diffusion[0, 0]), 5))], "lam double, diffusion double")


def affine() -> bases.Basis:
    """1 and x0 / 100."""
    return (bases.ones(1) & bases.coordinate(1, 0) * 0.01).vectorize()


def model_of(spark: SparkSession, sf_dir: str, method: str = "noisy") -> Overdamped:
    model = Overdamped(events(spark, sf_dir), 1)
    model.diffusion_constants(method)
    return model


def _gram(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The library's Gram matrix, in units of the noise, per unit of time."""
        model = model_of(spark, sf_dir)
        g = model.force_gram(affine(), mode) * 2 * model.diffusion[0, 0] / model.tau
        return spark.createDataFrame([tuple(round(float(v), 7) for v in g.ravel())], "g00 double, g01 double, g10 double, g11 double")

    return query


for _mode in ("rectangle", "shift", "trapeze"):
    _b = {"rectangle": ("x0 / 100",), "shift": ("xp / 100",), "trapeze": ("x0 / 100", "xp / 100")}[_mode]
    _cells = []
    for _i, _a in enumerate(("1.0", "x0 / 100")):
        for _j in range(2):
            _cells.append("round(sum(dt * (" + " + ".join(f"({_a}) * ({_c if _j else '1.0'})" for _c in _b) + f") / {len(_b)}) / sum(dt), 7) g{_i}{_j}")
    register(f"od_gram_{_mode}", STREAMS_SQL + " select " + ", ".join(_cells) + " from l where dt is not null")(_gram(_mode))


def _moments(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The library's moments, in units of the noise, per row."""
        model = model_of(spark, sf_dir)
        m = model.force_moments(affine(), mode) * 2 * model.diffusion[0, 0]
        n = model.rows.where(mask(["dX", "X_minus"] if mode == "ito_shift" else ["dX"])).count()
        return spark.createDataFrame([tuple(round(float(v / n), 7) for v in m)], "m0 double, m1 double")

    return query


register("od_moments_ito", STREAMS_SQL + " select round(sum(u) / count(u), 7) m0, round(sum(u * x0 / 100) / count(u), 7) m1 from l")(_moments("ito"))
register("od_moments_ito_shift", STREAMS_SQL + " select round(sum(u) / count(u), 7) m0, round(sum(u * xm / 100) / count(u), 7) m1 from l where u is not null and xm is not null")(_moments("ito_shift"))
register(
    "od_moments_strato",
    STREAMS_SQL + """ select round(sum(u) / count(u), 7) m0,
  round((sum(u * (x0 + xp) / 200) - sum(case when m is not null and u is not null then dt * (u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2) / 100 end)) / count(u), 7) m1 from l""",
)(_moments("strato"))

SUMS_SQL = STREAMS_SQL + """,
s as (
  select {key} count(u) n, sum(dt) g00, sum(dt * x0 / 100) g01, sum(dt * x0 / 100 * x0 / 100) g11, sum(u) m0, sum(u * x0 / 100) m1
  from l where u is not null {group}),
c as (select *, g00 * g11 - g01 * g01 det from s where n > 3),
f as (select *, (m0 * g11 - m1 * g01) / det c0, (m1 * g00 - m0 * g01) / det c1 from c where det > 1e-9 * g00 * g11)"""


def fitted(s: DataFrame, by: list[str]) -> DataFrame:
    """The fit of a force c0 + c1 x / 100 from one aggregation, solved in place (Ito, rectangle)."""
    x, u = F.col("x0") / 100, difference("x0", 0)
    sums = {"g00": est.step(), "g01": est.step() * x, "g11": est.step() * x * x, "m0": u, "m1": u * x, "n": F.lit(1.0)}
    out = integrate(s, sums, dict.fromkeys(sums, ["dX"]), weight_by_dt=False, by=by).where("n > 3")
    out = out.withColumn("det", F.col("g00") * F.col("g11") - F.col("g01") * F.col("g01")).where("det > 1e-9 * g00 * g11")
    c0 = (F.col("m0") * F.col("g11") - F.col("m1") * F.col("g01")) / F.col("det")
    c1 = (F.col("m1") * F.col("g00") - F.col("m0") * F.col("g01")) / F.col("det")
    return out.withColumns({"c0": c0, "c1": c1})


@register("od_linear_fit_p2", SUMS_SQL.format(key="", group="") + " select round(c0, 6) c0, round(c1, 6) c1, round(-c1 / 100, 8) rate, round(-100 * c0 / c1, 4) fixed_point from f")
def od_linear_fit_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fitted(rows(spark, sf_dir), [])
    return f.select(rounded("c0", F.col("c0")), rounded("c1", F.col("c1")), rounded("rate", -F.col("c1") / 100, 8), rounded("fixed_point", -100 * F.col("c0") / F.col("c1"), 4))


@register(
    "od_fit_per_dataset",
    SUMS_SQL.format(key="dataset_id,", group="group by dataset_id") + """,
d as (select dataset_id, avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) d from l where u is not null and m is not null group by dataset_id)
select dataset_id, n::bigint n, round(c0, 5) c0, round(c1, 5) c1, round(d, 5) diffusion from f join d using (dataset_id)""",
)
def od_fit_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and diffusion of each user's series: both aggregations share one window."""
    s = rows(spark, sf_dir)
    d = integrate(s, {"d": est.tensor("od_noisy", 0, 0)}, {"d": est.NEEDS["od_noisy"]}, weight_by_dt=False, mean=True, by=["dataset_id"])
    f = fitted(s, ["dataset_id"]).join(d.where("d is not null"), "dataset_id")
    return f.select("dataset_id", F.col("n").cast("long").alias("n"), rounded("c0", F.col("c0"), 5), rounded("c1", F.col("c1"), 5), rounded("diffusion", F.col("d"), 5))


@register(
    "od_infer_force_clean",
    STREAMS_SQL + """,
a as (select avg(-u * m) lam, avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) noisy, avg((u - m) * (u - m) / 4 / ((dt + dtm) / 2)) weak
      from l where u is not null and m is not null),
s as (select sum(dt) g00, sum(dt * x0) g01, sum(dt * xp) g10, sum(dt * x0 * (x0 + xp) / 2) g11, sum(u) m0, sum(u * x0) m1 from l where u is not null),
c as (select g00, (g01 + g10) / 2 h, g01, g11, m0, m1 from s)
select '1*e0' feature, round((m0 * g11 - m1 * h) / (g00 * g11 - h * g01), 5) coefficient from c
union all select 'x0*e0', round((m1 * g00 - m0 * g01) / (g00 * g11 - h * g01), 5) from c""",
)
def od_infer_force_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference object itself: an affine force with Ito moments and trapezes."""
    fit = Overdamped(events(spark, sf_dir), 1).infer_force(bases.monomials_up_to(1, 1, "vector"), "clean")
    return spark.createDataFrame([(n, round(float(c), 5)) for n, c in zip(fit.basis.labels, fit.coefficients, strict=True)], "feature string, coefficient double")


def _preset(name: str, sums: tuple[str, str, str, str], stratonovich: bool):
    drift = "sum(case when m is not null then dt * (u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2) end)"
    m1 = f"sum(u * (x0 + xp) / 2) - {drift}" if stratonovich else "sum(u * x0)"
    sql = STREAMS_SQL + f""",
s as (select {", ".join(f"sum(dt * {x}) g{k}" for x, k in zip(sums, ("00", "01", "10", "11"), strict=True))}, sum(u) m0, {m1} m1 from l where u is not null)
select round((m0 * g11 - m1 * g01) / (g00 * g11 - g01 * g10), 5) c0, round((m1 * g00 - m0 * g10) / (g00 * g11 - g01 * g10), 6) c1 from s"""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fit = Overdamped(events(spark, sf_dir), 1).infer_force(bases.monomials_up_to(1, 1, "vector"), name)
        return spark.createDataFrame([(round(float(fit.coefficients[0]), 5), round(float(fit.coefficients[1]), 6))], "c0 double, c1 double")

    register(f"od_infer_force_{name}", sql)(query)


_preset("robust", ("1", "xp", "x0", "x0 * xp"), True)
_preset("km", ("1", "x0", "x0", "x0 * x0"), False)
_preset("legacy", ("1", "x0", "x0", "x0 * x0"), True)


@register(
    "od_diffusion_linear_p2",
    STREAMS_SQL + """,
s as (select count(*) g00, sum(x0 / 100) g01, sum(x0 / 100 * x0 / 100) g11, sum(d) m0, sum(d * x0 / 100) m1
      from (select x0, (u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2) d from l where u is not null and m is not null))
select round((m0 * g11 - m1 * g01) / (g00 * g11 - g01 * g01), 5) d0, round((m1 * g00 - m0 * g01) / (g00 * g11 - g01 * g01) / 100, 7) d1 from s""",
)
def od_diffusion_linear_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = Overdamped(events(spark, sf_dir), 1).infer_diffusion(bases.monomials_up_to(1, 1, "symmetric"))
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 5), round(float(fit.coefficients[1]), 7))], "d0 double, d1 double")


@register(
    "force_error_p2",
    SUMS_SQL.format(key="", group="") + """,
w as (select avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) d from l where u is not null and m is not null)
select round(sqrt(2 * d * g11 / det), 6) e0, round(sqrt(2 * d * g00 / det), 6) e1, round((c0 * m0 + c1 * m1) / (4 * d), 6) information,
       round(4 * d / (c0 * m0 + c1 * m1), 6) nmse from f, w""",
)
def force_error_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors from the inverse Gram matrix, the information, and the error it predicts."""
    fit = model_of(spark, sf_dir).infer_force(affine(), "km")
    values = (*fit.stderr, fit.information, fit.meta["nmse_pred"])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in values)], "e0 double, e1 double, information double, nmse double")


@register(
    "predict_ci_p2",
    SUMS_SQL.format(key="", group="") + f""",
w as (select avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) d from l where u is not null and m is not null)
select dataset_id, time_idx, round(c0 + c1 * x0 / 100, 6) f0,
       round(c0 + c1 * x0 / 100 - {norm_ppf(0.975)} * sqrt(2 * d / det * (g11 - 2 * g01 * x0 / 100 + g00 * x0 / 100 * x0 / 100)), 6) f0_low
from traj, f, w where time_idx < 20""",
)
def predict_ci_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted force and its lower confidence bound at each series' first twenty places; predict_ci_all has all places."""
    return predict_ci_all(spark, sf_dir).where("time_idx < 20")


@register(
    "predict_ci_all",
    SUMS_SQL.format(key="", group="") + f""",
w as (select avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) d from l where u is not null and m is not null)
select dataset_id, time_idx, round(c0 + c1 * x0 / 100, 6) f0,
       round(c0 + c1 * x0 / 100 - {norm_ppf(0.975)} * sqrt(2 * d / det * (g11 - 2 * g01 * x0 / 100 + g00 * x0 / 100 * x0 / 100)), 6) f0_low
from traj, f, w""",
)
def predict_ci_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted force and its lower confidence bound at every event."""
    fit = model_of(spark, sf_dir).infer_force(affine(), "km")
    p = fit.predict_ci(events(spark, sf_dir))
    return p.select("dataset_id", "time_idx", rounded("f0", F.col("f0")), rounded("f0_low", F.col("f0_low")))


@register(
    "time_fourier_gram",
    f"""with {EVENTS_SQL},
l as (select *, (lead(t) over w) - t dt, max(t) over (partition by dataset_id) - min(t) over (partition by dataset_id) duration,
      t - min(t) over (partition by dataset_id) s from traj window w as (partition by dataset_id order by time_idx))
select dataset_id, round(sum(dt * cos(6.283185307179586 * s / duration)) / sum(dt), 6) g01, round(sum(dt * sin(6.283185307179586 * s / duration)) / sum(dt), 6) g02,
       round(sum(dt * cos(6.283185307179586 * s / duration) * sin(6.283185307179586 * s / duration)) / sum(dt), 6) g12
from l where dt is not null group by dataset_id having sum(dt) > 0""",
)
def time_fourier_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonics of each dataset's own duration."""
    from pyspark.sql import Window

    w = Window.partitionBy("dataset_id")
    s = rows(spark, sf_dir).withColumns({"duration": F.max("t").over(w) - F.min("t").over(w), "s": F.col("t") - F.min("t").over(w)})
    b = bases.time_fourier(1, 1).columns({"t": F.col("s")})
    terms = {"g01": b[0] * b[1], "g02": b[0] * b[2], "g12": b[1] * b[2]}
    return integrate(s, terms, dict.fromkeys(terms, ["X"]), mean=True, by=["dataset_id"]).where("g01 is not null").select("dataset_id", *[rounded(k, F.col(k)) for k in terms])


@register(
    "dataset_indicator_gram",
    STREAMS_SQL + " select round(sum(case when dataset_id = 0 then dt else 0 end), 6) g00, round(sum(case when dataset_id = 1 then dt else 0 end), 6) g11, round(sum(case when dataset_id = 2 then dt else 0 end), 6) g22, 0.0::double g01 from l where dt is not null",
)
def dataset_indicator_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner of datasets 0, 1 and 2; dataset_indicator_gram_all has every dataset."""
    b = bases.dataset_indicator(1, 3).columns()
    terms = {"g00": b[0] * b[0], "g11": b[1] * b[1], "g22": b[2] * b[2], "g01": b[0] * b[1]}
    return integrate(rows(spark, sf_dir), terms, dict.fromkeys(terms, ["X"])).select(*[rounded(k, F.col(k)) for k in terms])


@register("dataset_indicator_gram_all", STREAMS_SQL + " select dataset_id, round(coalesce(sum(dt), 0), 6) g from l group by dataset_id")
def dataset_indicator_gram_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonal of the one-hot basis' Gram matrix, of every dataset; no two indicators overlap, so all else is zero."""
    g = integrate(rows(spark, sf_dir), {"g": F.lit(1.0)}, {"g": ["X"]}, by=["dataset_id"])
    return g.select("dataset_id", rounded("g", F.col("g")))


@register(
    "entropy_moments_p2",
    STREAMS_SQL + """,
s as (select sum(u) m0, sum(u * (x0 + xp) / 200) m1, sum(dt) g00, sum(dt * x0 / 100) g01, sum(dt * x0 / 100 * x0 / 100) g11, count(u) n from l where u is not null),
w as (select avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) d from l where u is not null and m is not null)
select round((m0 * m0 * g11 - 2 * m0 * m1 * g01 + m1 * m1 * g00) / (g00 * g11 - g01 * g01) / d, 6) delta_s,
       round((m0 * m0 * g11 - 2 * m0 * m1 * g01 + m1 * m1 * g00) / (g00 * g11 - g01 * g01) / d - 4, 6) debiased from s, w""",
)
def entropy_moments_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy production of the current in two features, with its bias taken off."""
    e = model_of(spark, sf_dir).entropy_production(affine(), "rectangle")
    return spark.createDataFrame([(round(float(e["delta_s"]), 6), round(float(e["debiased"]), 6))], "delta_s double, debiased double")


@register(
    "observables_information_entropy",
    STREAMS_SQL + " select round(sum(u * (50 - x0) / 400) / count(u), 6) information, round(sum(u * (100 - x0 - xp) / 200) / count(u), 6) entropy, count(u)::bigint n from l where u is not null",
)
def observables_information_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information and entropy of a linear trap with unit stiffness around 50, in units of D = 100."""
    from driftfield.functions.expr import Var
    from driftfield.operators.simulate import observables

    s = events(spark, sf_dir)
    n = integrate(rows(spark, sf_dir), {"n": F.lit(1.0)}, {"n": ["dX"]}, weight_by_dt=False)
    o = observables(s, [50.0 - Var("x0")], [[100.0]]).crossJoin(F.broadcast(n))
    return o.select(rounded("information", F.col("information") / F.col("n")), rounded("entropy", F.col("entropy") / F.col("n")), F.col("n").cast("long").alias("n"))


@register(
    "nmse_compare_exact",
    SUMS_SQL.format(key="", group="") + """,
w as (select avg((u * u + 4 * u * m + m * m) / 4 / ((dt + dtm) / 2)) d from l where u is not null and m is not null)
select round(avg((c0 + c1 * x0 / 100 - (50 - x0)) * (c0 + c1 * x0 / 100 - (50 - x0)) / (2 * d)), 6) mse,
       round(avg((c0 + c1 * x0 / 100) * (c0 + c1 * x0 / 100) / (2 * d)), 6) norm from l, f, w where l.dt is not null""",
)
def nmse_compare_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of the fitted force against a given one, in units of the noise."""
    from driftfield.functions.expr import Var

    model = model_of(spark, sf_dir)
    found = model.compare_to_exact(model.infer_force(affine(), "km"), [50.0 - Var("x0")])
    return spark.createDataFrame([(round(float(found["mse"]), 6), round(float(found["norm"]), 6))], "mse double, norm double")
