"""Queries of pair interactions and grid fields, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import basis as bases
from driftfield.operators import degrade as dg
from driftfield.operators import grid as gr
from driftfield.operators import interactions as ia
from driftfield.operators.linear import Overdamped
from driftfield.plans.overdamped import rounded
from driftfield.sources.tables import GRID_SQL, SWARM_SQL, grid, swarm

QUERIES = {}
ORACLES = {}

PAIRS_SQL = f"""with {SWARM_SQL},
q as (
  select a.time_idx, a.particle_id i, b.particle_id j, a.theta ti, b.theta tj, b.x0 - a.x0 dx, b.x1 - a.x1 dy, b.v0 - a.v0 du, a.species si, b.species sj,
         sqrt((b.x0 - a.x0) * (b.x0 - a.x0) + (b.x1 - a.x1) * (b.x1 - a.x1) + 1e-12) r
  from traj a join traj b on a.time_idx = b.time_idx and a.particle_id <> b.particle_id)"""


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def pairs(spark: SparkSession, sf_dir: str, symmetric: bool = True) -> DataFrame:
    return ia.all_pairs(swarm(spark, sf_dir), symmetric)


D = lambda: ia.displacement(2)


@register("all_pairs_radial_kernels", PAIRS_SQL + """ select time_idx, i, j, round(exp(-r * r / 8) * dx / r, 6) gx, round(r * exp(-r / 1.5) * dy / r, 6) ey,
  round(case when r < 3 then (1 - r / 3) * (1 - r / 3) else 0 end, 6) c, round(1 / r / r, 4) p from q where i < j""")
def all_pairs_radial_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian, exponential, compact and power kernels of every pair."""
    p, r = pairs(spark, sf_dir, symmetric=False), ia.distance(D())
    (g, _), (e, _), (c, _), (w, _) = *ia.gaussian_kernels([2.0]), *ia.exp_poly_kernels([1], [1.5]), *ia.compact_kernels([0], 3.0), *ia.power_kernels([-2])
    return p.select(
        "time_idx", F.col("particle_id_i").alias("i"), F.col("particle_id_j").alias("j"), rounded("gx", ia.radial(g, D())[0]), rounded("ey", ia.radial(e, D())[1]),
        rounded("c", c(r)), rounded("p", w(r), 4),
    )


@register("neighbors_cutoff", PAIRS_SQL + " select time_idx, i, j, round(r, 5) r from q where sqrt(dx * dx + dy * dy) <= 1.5")
def neighbors_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ia.neighbours(swarm(spark, sf_dir), 1.5)
    return n.select("time_idx", F.col("particle_id_i").alias("i"), F.col("particle_id_j").alias("j"), rounded("r", ia.distance(D()), 5))


@register(
    "neighbors_pbc",
    PAIRS_SQL + """, b as (select time_idx, i, j, dx - round_even(dx / 7.5, 0) * 7.5 dx, dy - round_even(dy / 6.0, 0) * 6.0 dy from q)
select time_idx, i, j, round(sqrt(dx * dx + dy * dy), 5) r from b where sqrt(dx * dx + dy * dy) <= 1.5""",
)
def neighbors_pbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [7.5, 6.0]
    n = ia.neighbours(swarm(spark, sf_dir), 1.5, box=box)
    return n.select("time_idx", F.col("particle_id_i").alias("i"), F.col("particle_id_j").alias("j"), rounded("r", ia.distance(ia.displacement(2, box), 0.0), 5))


def _dispatch(owner: str, reducer: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        (g, _), *_ = ia.gaussian_kernels([2.0])
        d = ia.dispatch(pairs(spark, sf_dir), {"f": ia.radial(g, D())[0]}, owner, reducer)
        keys = ["time_idx"] if owner == "global" else ["time_idx", "particle_id"]
        return d.select(*keys, rounded("f", F.col("f")))

    return query


_K = "exp(-r * r / 8) * dx / r"
register("dispatch_focal", PAIRS_SQL + f" select time_idx, i particle_id, round(sum({_K}), 6) f from q group by time_idx, i")(_dispatch("focal", "sum"))
register("dispatch_mean_degree", PAIRS_SQL + f" select time_idx, i particle_id, round(avg({_K}), 6) f from q group by time_idx, i")(_dispatch("focal", "mean"))
register("dispatch_max", PAIRS_SQL + f" select time_idx, i particle_id, round(max({_K}), 6) f from q group by time_idx, i")(_dispatch("focal", "max"))


def _positive(owner: str):
    """A positive kernel, so that no sum is a rounding error away from 0."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        (g, _), *_ = ia.gaussian_kernels([2.0])
        d = ia.dispatch(pairs(spark, sf_dir), {"f": g(ia.distance(D()))}, owner)
        keys = ["time_idx"] if owner == "global" else ["time_idx", "particle_id"]
        return d.select(*keys, rounded("f", F.col("f")))

    return query


register("dispatch_all", PAIRS_SQL + ", o as (select time_idx, unnest([i, j]) particle_id, exp(-r * r / 8) f from q) select time_idx, particle_id, round(sum(f), 6) f from o group by all")(_positive("all"))
register("dispatch_global", PAIRS_SQL + " select time_idx, round(sum(exp(-r * r / 8)), 6) f from q group by time_idx")(_positive("global"))


@register("dyadic_pairs", PAIRS_SQL + " select time_idx, i particle_id, round(sum(exp(-r * r / 8) * dx * dx / (r * r)), 6) qxx, round(sum(exp(-r * r / 8) * dy * dy / (r * r)), 6) qyy from q group by time_idx, i")
def dyadic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (g, _), *_ = ia.gaussian_kernels([2.0])
    m = ia.dyadic(g, D())
    d = ia.dispatch(pairs(spark, sf_dir), {"qxx": m[0][0], "qyy": m[1][1]})
    return d.select("time_idx", "particle_id", rounded("qxx", F.col("qxx")), rounded("qyy", F.col("qyy")))


@register(
    "angular_pairs",
    PAIRS_SQL + """ select time_idx, i, j, round(exp(-r * r / 8) * sin((tj - ti) - round_even((tj - ti) / 6.283185307179586, 0) * 6.283185307179586), 6) torque,
  case when (cos(ti) * dx + sin(ti) * dy) / r >= 0.5 then 1.0 else 0.0 end::double seen, round(du, 6) du from q""",
)
def angular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment torques, cones of sight of 60 degrees, and velocity differences."""
    import math

    (g, _), *_ = ia.gaussian_kernels([2.0])
    return pairs(spark, sf_dir).select(
        "time_idx", F.col("particle_id_i").alias("i"), F.col("particle_id_j").alias("j"), rounded("torque", ia.angular(g, D())),
        ia.vision_gate(D(), math.acos(0.5)).alias("seen"), rounded("du", ia.velocity_difference(2)[0]),
    )


@register("edge_list_pairs", PAIRS_SQL + " select time_idx, i, j, round(r, 6) r from q where j = (i + 1) % 40")
def edge_list_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of particles as a given edge table."""
    edges = spark.range(40).select(F.lit(0).cast("long").alias("dataset_id"), F.col("id").alias("particle_id_i"), ((F.col("id") + 1) % 40).alias("particle_id_j"))
    p = ia.from_edges(swarm(spark, sf_dir), edges)
    return p.select("time_idx", F.col("particle_id_i").alias("i"), F.col("particle_id_j").alias("j"), rounded("r", ia.distance(D())))


@register(
    "hyperedges_triples",
    f"""with {SWARM_SQL}
select a.time_idx, a.particle_id edge_id, round(a.x0 - 2 * b.x0 + c.x0, 6) bend
from traj a join traj b on a.time_idx = b.time_idx and b.particle_id = a.particle_id + 1
join traj c on a.time_idx = c.time_idx and c.particle_id = a.particle_id + 2""",
)
def hyperedges_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three particles in a row as one edge."""
    e = spark.range(38).select(F.lit(0).cast("long").alias("dataset_id"), F.col("id").alias("edge_id"), F.posexplode(F.sequence(F.col("id"), F.col("id") + 2)).alias("slot", "particle_id"))
    h = ia.hyperedges(swarm(spark, sf_dir), e, ["x0"])
    return h.select("time_idx", "edge_id", rounded("bend", F.get("x0", F.lit(0)) - 2 * F.get("x0", F.lit(1)) + F.get("x0", F.lit(2))))


#: Steps of the swarm's particles in two dimensions, and A ** -1 (p, q; q, r) of their automatic diffusion.
MOVES_SQL = f"""with {SWARM_SQL},
f as (select *, sum(x0) over w - count(*) over w * x0 sx, sum(x1) over w - count(*) over w * x1 sy from traj window w as (partition by time_idx)),
l as (
  select a.*, b.x0 - a.x0 u, b.x1 - a.x1 v, a.x0 - c.x0 m, a.x1 - c.x1 n, b.x0 xp, b.x1 yp, b.sx sxp, b.sy syp
  from f a left join f b on b.particle_id = a.particle_id and b.time_idx = a.time_idx + 1 left join f c on c.particle_id = a.particle_id and c.time_idx = a.time_idx - 1),
e as (
  select avg(-u * m) + avg(-v * n) lam, avg((u * u + 4 * u * m + m * m) / 4) n00, avg((u * v + 2 * u * n + 2 * m * v + m * n) / 4) n01, avg((v * v + 4 * v * n + n * n) / 4) n11,
         avg((u - m) * (u - m) / 4) w00, avg((u - m) * (v - n) / 4) w01, avg((v - n) * (v - n) / 4) w11 from l where u is not null and m is not null),
d as (select case when lam > 0 then n00 else w00 end d00, case when lam > 0 then n01 else w01 end d01, case when lam > 0 then n11 else w11 end d11 from e),
i as (select d11 / (d00 * d11 - d01 * d01) / 2 p, -d01 / (d00 * d11 - d01 * d01) / 2 q, d00 / (d00 * d11 - d01 * d01) / 2 r from d)"""


@register(
    "od_trap_spring",
    f"""{MOVES_SQL},
s as (
  select sum(x0 * (x0 + xp) * p + (x0 * (x1 + yp) + x1 * (x0 + xp)) * q + x1 * (x1 + yp) * r) / 2 g00,
         sum(x0 * (sx + sxp) * p + (x0 * (sy + syp) + x1 * (sx + sxp)) * q + x1 * (sy + syp) * r) / 2 g01,
         sum(sx * (x0 + xp) * p + (sx * (x1 + yp) + sy * (x0 + xp)) * q + sy * (x1 + yp) * r) / 2 g10,
         sum(sx * (sx + sxp) * p + (sx * (sy + syp) + sy * (sx + sxp)) * q + sy * (sy + syp) * r) / 2 g11,
         sum(u * x0 * p + (u * x1 + v * x0) * q + v * x1 * r) m0, sum(u * sx * p + (u * sy + v * sx) * q + v * sy * r) m1 from l, i where u is not null)
select 'X' feature, round((m0 * g11 - m1 * g01) / (g00 * g11 - g01 * g10), 6) coefficient from s
union all select 'spring', round((m1 * g00 - m0 * g10) / (g00 * g11 - g01 * g10), 6) from s""",
)
def od_trap_spring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trap and springs between all particles of a frame, fitted together."""
    s = swarm(spark, sf_dir)
    rows, springs, names = ia.gathered(s, {"spring": ia.separation(2)}, ia.all_pairs(s))
    fit = Overdamped(rows, 2, names).infer_force(bases.position(2) & springs, "clean")
    return spark.createDataFrame([(n, round(float(c), 6)) for n, c in zip(fit.basis.labels, fit.coefficients, strict=True)], "feature string, coefficient double")


@register(
    "od_swarm_robust",
    f"""{MOVES_SQL},
g as (select sum(x0 * xp * p + (x0 * yp + x1 * xp) * q + x1 * yp * r) g, sum(u * (x0 + xp) * p + (u * (x1 + yp) + v * (x0 + xp)) * q + v * (x1 + yp) * r) / 2 m from l, i where u is not null),
t as (select sum((u * u + 4 * u * m + m * m) / 4 * p + (u * v + 2 * u * n + 2 * m * v + m * n) / 2 * q + (v * v + 4 * v * n + n * n) / 4 * r) drift from l, i where u is not null and m is not null)
select round((m - drift) / g, 6) coefficient from g, t""",
)
def od_swarm_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratonovich moments less their noise-induced part, contracted over two components."""
    fit = Overdamped(swarm(spark, sf_dir), 2).infer_force(bases.position(2), "robust")
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 6),)], "coefficient double")


# Grid fields: 16 x 16 sites.

SHAPE = [16, 16]


def site_sql(edge: str, offsets: Sequence[tuple[int, int]], select: str, where: str = "") -> str:
    """Neighbours by self-joins; n<k> is the site at the k-th offset, o the site itself."""
    joins, cols = [], []
    for k, (a, b) in enumerate(offsets):
        if edge == "pbc":
            on = f"n{k}.c0 = (o.c0 + {a} + 16) % 16 and n{k}.c1 = (o.c1 + {b} + 16) % 16"
        else:
            on = f"n{k}.c0 = o.c0 + {a} and n{k}.c1 = o.c1 + {b}"
        joins.append(f"{'left ' if edge == 'noflux' else ''}join grid n{k} on n{k}.time_idx = o.time_idx and {on}")
        for f in ("x0", "x1"):
            cols.append(f"coalesce(n{k}.{f}, o.{f}) {'f' if f == 'x0' else 'g'}{k}")
    return f"with {GRID_SQL}, s as (select o.*, {', '.join(cols)} from grid o {' '.join(joins)}) select time_idx, c0, c1, {select} from s {where}"


CROSS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def _grid(operators, edge: str = "pbc", digits: int = 6):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ops = operators()
        out = gr.apply(grid(spark, sf_dir), ops, SHAPE, edge)
        return out.select("time_idx", "c0", "c1", *[rounded(k, F.col(k), digits) for k in ops])

    return query


for _edge in ("pbc", "noflux", "drop"):
    register(f"laplacian_{_edge}", site_sql(_edge, CROSS, "round((f0 + f1 + f2 + f3 - 4 * x0) / 0.25, 6) lap"))(_grid(lambda: {"lap": [("x0", gr.laplacian(2, 0.5))]}, _edge))
register("gradient_grid", site_sql("pbc", CROSS, "round((f0 - f1) / 2, 6) d0_x0, round((f2 - f3) / 2, 6) d1_x0"))(_grid(lambda: gr.gradient("x0")))
register("divergence_grid", site_sql("pbc", CROSS, "round((f0 - f1) / 2 + (g2 - g3) / 2, 6) div"))(_grid(lambda: gr.divergence(["x0", "x1"])))
register("curl2d_grid", site_sql("pbc", CROSS, "round((g0 - g1) / 2 - (f2 - f3) / 2, 6) curl"))(_grid(lambda: gr.curl2d(["x0", "x1"])))
register("strain_rate_grid", site_sql("pbc", CROSS, "round((f0 - f1) / 2, 6) g00, round((g0 - g1) / 4 + (f2 - f3) / 4, 6) g01, round((f2 - f3) / 4 + (g0 - g1) / 4, 6) g10, round((g2 - g3) / 2, 6) g11"))(
    _grid(lambda: gr.velocity_gradient(["x0", "x1"]))
)
register("vorticity_grid", site_sql("pbc", CROSS, "0.0::double g00, round((g0 - g1) / 4 - (f2 - f3) / 4, 6) g01, round((f2 - f3) / 4 - (g0 - g1) / 4, 6) g10, 0.0::double g11"))(
    _grid(lambda: gr.velocity_gradient(["x0", "x1"], sign=-1))
)
register(
    "biharmonic_2d",
    f"""with {GRID_SQL},
k as (select unnest([0, 1, -1, 0, 0, 1, 1, -1, -1, 2, -2, 0, 0]) a, unnest([0, 0, 0, 1, -1, 1, -1, 1, -1, 0, 0, 2, -2]) b, unnest([20, -8, -8, -8, -8, 2, 2, 2, 2, 1, 1, 1, 1]) w)
select o.time_idx, o.c0, o.c1, round(sum(w * n.x0), 6) bih
from grid o cross join k join grid n on n.time_idx = o.time_idx and n.c0 = (o.c0 + a + 16) % 16 and n.c1 = (o.c1 + b + 16) % 16
group by o.time_idx, o.c0, o.c1 having count(*) = 13""",
)(_grid(lambda: {"bih": [("x0", gr.biharmonic(2))]}))


@register("advection_grid", site_sql("pbc", CROSS, "round(x0 * (f0 - f1) / 2 + x1 * (f2 - f3) / 2, 5) advection"))
def advection_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = gr.advection(grid(spark, sf_dir), "x0", ["x0", "x1"], SHAPE)
    return a.select("time_idx", "c0", "c1", rounded("advection", F.col("advection"), 5))


@register(
    "laplacian_of_gradient_squared",
    f"""with {GRID_SQL},
s as (select o.time_idx, o.c0, o.c1, (a.x0 - b.x0) / 2 * (a.x0 - b.x0) / 2 + (c.x0 - d.x0) / 2 * (c.x0 - d.x0) / 2 g
  from grid o join grid a on a.time_idx = o.time_idx and a.c0 = (o.c0 + 1) % 16 and a.c1 = o.c1
  join grid b on b.time_idx = o.time_idx and b.c0 = (o.c0 + 15) % 16 and b.c1 = o.c1
  join grid c on c.time_idx = o.time_idx and c.c1 = (o.c1 + 1) % 16 and c.c0 = o.c0
  join grid d on d.time_idx = o.time_idx and d.c1 = (o.c1 + 15) % 16 and d.c0 = o.c0)
select o.time_idx, o.c0, o.c1, round(a.g + b.g + c.g + d.g - 4 * o.g, 5) lap_g2
from s o join s a on a.time_idx = o.time_idx and a.c0 = (o.c0 + 1) % 16 and a.c1 = o.c1
  join s b on b.time_idx = o.time_idx and b.c0 = (o.c0 + 15) % 16 and b.c1 = o.c1
  join s c on c.time_idx = o.time_idx and c.c1 = (o.c1 + 1) % 16 and c.c0 = o.c0
  join s d on d.time_idx = o.time_idx and d.c1 = (o.c1 + 15) % 16 and d.c0 = o.c0""",
)
def laplacian_of_gradient_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = gr.laplacian_of_gradient_squared(grid(spark, sf_dir), "x0", SHAPE)
    return a.select("time_idx", "c0", "c1", rounded("lap_g2", F.col("lap_g2"), 5))


@register(
    "box_blur",
    f"""with {GRID_SQL}
select o.time_idx, o.c0, o.c1, round(avg(n.x0), 6) x0
from grid o join (select 0 a union all select 1 union all select -1) a on true join (select 0 b union all select 1 union all select -1) b on true
join grid n on n.time_idx = o.time_idx and n.c0 = least(15, greatest(0, o.c0 + a)) and n.c1 = least(15, greatest(0, o.c1 + b))
group by all having count(*) > 0""",
)
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three by three mean; edge sites repeat beyond the grid."""
    whole = grid(spark, sf_dir)
    b = gr.box_blur(whole, ["x0"], 1, SHAPE, "noflux").join(whole.select("time_idx", "c0", "c1"), ["time_idx", "c0", "c1"])
    return b.select("time_idx", "c0", "c1", rounded("x0", F.col("x0")))


@register("block_downscale", f"with {GRID_SQL} select time_idx, (c0 // 3)::bigint c0, (c1 // 3)::bigint c1, round(avg(x0), 6) x0 from grid where c0 < 15 and c1 < 15 group by all having count(*) >= 5")
def block_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = gr.block_downscale(grid(spark, sf_dir), ["x0"], 3, SHAPE, 0.5)
    return b.select("time_idx", "c0", "c1", rounded("x0", F.col("x0")))


@register(
    "layout_equations",
    site_sql("pbc", CROSS, "round((f0 - f1) / 2, 6) grad0_a, round((f2 - f3) / 2, 6) grad1_a, round(f0 + f1 + f2 + f3 - 4 * x0, 6) lap_a, round((f0 - f1) / 2 + (g2 - g3) / 2, 6) div_u"),
)
def layout_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar's gradient and Laplacian and a vector's divergence, asked for by name."""
    from driftfield.operators.layout import Layout, scalar, vector

    plan = Layout(SHAPE)
    names = plan.grad(scalar("a", "x0")) + plan.lap(scalar("a", "x0")) + plan.div(vector("u", ["x0", "x1"]))
    return plan.evaluate(grid(spark, sf_dir)).select("time_idx", "c0", "c1", *[rounded(n, F.col(n)) for n in names])


@register(
    "degrade_spatial",
    f"""with {GRID_SQL},
s as (select time_idx, a c0, b c1 from (select distinct time_idx from grid), range(16) x(a), range(16) y(b)),
m as (
  select s.time_idx, s.c0, s.c1, avg(n.x0) x0
  from s cross join (select unnest([-1, 0, 1]) a) cross join (select unnest([-1, 0, 1]) b)
  join grid n on n.time_idx = s.time_idx and n.c0 = (s.c0 + a + 16) % 16 and n.c1 = (s.c1 + b + 16) % 16 group by all),
k as (select time_idx, (c0 // 2)::bigint c0, (c1 // 2)::bigint c1, avg(x0) x0 from m group by time_idx, c0 // 2, c1 // 2 having count(*) >= 2),
l as (
  select time_idx, c0, c1, x0 + 0.1 * {dg.normal_sql("'5:0:0:' || time_idx || ':' || c0 || ':' || c1")} x0, count(*) over () n,
         row_number() over (order by md5('5:0:' || time_idx || ':' || c0 || ':' || c1)) place from k)
select time_idx, c0, c1, round(x0, 6) x0 from l where place <= round_even(n * 0.9::double, 0)""",
)
def degrade_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur, blocks, noise and an exact share of lost sites."""
    from driftfield.operators.layout import degrade_spatial as degrade

    d = degrade(grid(spark, sf_dir), ["x0"], SHAPE, blur=1, factor=2, noise=0.1, loss=0.1, seed=5)
    return d.select("time_idx", "c0", "c1", rounded("x0", F.col("x0")))
