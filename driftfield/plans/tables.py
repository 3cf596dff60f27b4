"""Queries of collections, degradation and extras, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftfield.functions import basis as bases
from driftfield.operators import degrade as dg
from driftfield.operators.reduce import concat, split_time, subsample
from driftfield.operators.streams import fd_velocity, sliding, with_halo, window
from driftfield.plans.overdamped import rounded
from driftfield.sources.tables import EVENTS_SQL, LINES_SQL, compress_particles, events, extras_by_prefix, from_dataframe, lines, relabel

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


@register(
    "degrade_downsample_blur",
    f"""with {EVENTS_SQL},
w as (select *, max(time_idx) over (partition by dataset_id) + 1 frames, avg(x0) over b x, avg(t) over b tt, count(*) over b n
      from traj window b as (partition by dataset_id order by time_idx rows between current row and 1 following))
select dataset_id, (time_idx // 3)::bigint time_idx, round(x, 6) x0, round(tt, 6) t from w where n = 2 and time_idx % 3 = 0 and time_idx < frames - 1""",
)
def degrade_downsample_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dg.downsample(events(spark, sf_dir), every=3, blur=1)
    return d.select("dataset_id", "time_idx", rounded("x0", F.col("x0")), rounded("t", F.col("t")))


@register("degrade_roi", f"with {EVENTS_SQL} select dataset_id, count(*)::bigint n, round(sum(x0) / count(*), 6) mean from traj where abs(x0) <= 60 and x0 >= 10 group by dataset_id")
def degrade_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dg.roi(events(spark, sf_dir), radius=60.0, predicate=F.col("x0") >= 10)
    return d.groupBy("dataset_id").agg(F.count("*").alias("n"), rounded("mean", F.sum("x0") / F.count("*")))


@register(
    "degrade_loss",
    f"""with {EVENTS_SQL},
l as (select *, row_number() over (partition by dataset_id order by md5('1:' || dataset_id || ':0:' || time_idx)) place, count(*) over (partition by dataset_id) n from traj)
select dataset_id, count(*)::bigint n, round(sum(x0) / count(*), 6) mean from l where place <= round_even(n * 0.75::double, 0) group by dataset_id""",
)
def degrade_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a quarter is lost: an exact share of each dataset."""
    return dg.data_loss(events(spark, sf_dir), 0.25, seed=1).groupBy("dataset_id").agg(F.count("*").alias("n"), rounded("mean", F.sum("x0") / F.count("*")))


@register("degrade_noise", f"with {EVENTS_SQL} select dataset_id, time_idx, round(x0 + 2 * {dg.normal_sql("'3:0:' || dataset_id || ':0:' || time_idx")}, 6) x0 from traj")
def degrade_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.add_noise(events(spark, sf_dir), 2.0, seed=3).select("dataset_id", "time_idx", rounded("x0", F.col("x0")))


@register(
    "degrade_all",
    f"""with {EVENTS_SQL},
w as (select *, max(time_idx) over (partition by dataset_id) + 1 frames, avg(x0) over b x, avg(t) over b tt, count(*) over b n
      from traj window b as (partition by dataset_id order by time_idx rows between current row and 1 following)),
d as (select dataset_id, (time_idx // 2)::bigint time_idx, x, tt t from w where n = 2 and time_idx % 2 = 0 and time_idx < frames - 1),
e as (select dataset_id, time_idx, x + 3 * {dg.normal_sql("'7:0:' || dataset_id || ':0:' || time_idx")} x0, t from d),
r as (select * from e where sqrt(x0 * x0) <= 80),
l as (select *, row_number() over (partition by dataset_id order by md5('7:' || dataset_id || ':0:' || time_idx)) place, count(*) over (partition by dataset_id) n from r)
select dataset_id, time_idx, round(x0, 6) x0, round(t, 6) t from l where place <= round_even(n * 0.9::double, 0)""",
)
def degrade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five degradations in their order."""
    d = dg.degrade(events(spark, sf_dir), every=2, blur=1, noise=3.0, radius=80.0, loss=0.1, seed=7)
    return d.select("dataset_id", "time_idx", rounded("x0", F.col("x0")), rounded("t", F.col("t")))


@register(
    "split_time",
    f"""with {EVENTS_SQL},
f as (select *, greatest(2, least(round_even((max(time_idx) over (partition by dataset_id) + 1) * 0.7::double, 0), max(time_idx) over (partition by dataset_id) + 1 - 1 - 2)) k from traj)
select dataset_id, case when time_idx < k then 'fit' else 'test' end part, count(*)::bigint n, round(sum(x0) / count(*), 6) mean
from f where time_idx < k or time_idx >= k + 1 group by all""",
)
def split_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tenths of each series to fit, the rest but one frame to test."""
    a, b = split_time(events(spark, sf_dir), 0.7, gap=1)
    both = a.withColumn("part", F.lit("fit")).unionByName(b.withColumn("part", F.lit("test")))
    return both.groupBy("dataset_id", "part").agg(F.count("*").alias("n"), rounded("mean", F.sum("x0") / F.count("*")))


@register(
    "concat_collections",
    f"""with {EVENTS_SQL},
c as (select dataset_id, x0 from traj union all select dataset_id + (select max(dataset_id) + 1 from traj), x0 from traj where time_idx % 2 = 0)
select dataset_id, count(*)::bigint n, round(sum(x0) / count(*), 6) mean from c group by dataset_id""",
)
def concat_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, and every other of them, as one collection."""
    e = events(spark, sf_dir)
    return concat(e, subsample(e, 2)).groupBy("dataset_id").agg(F.count("*").alias("n"), rounded("mean", F.sum("x0") / F.count("*")))


@register(
    "relabel_ids",
    """select o_custkey % 5 dataset_id, o_custkey original_particle_id, (dense_rank() over (partition by o_custkey % 5 order by o_custkey) - 1)::bigint particle_id,
       ((o_orderkey // 4) - min(o_orderkey // 4) over (partition by o_custkey % 5))::bigint time_idx from orders""",
)
def relabel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = o.select((F.col("o_custkey") % 5).alias("dataset_id"), F.col("o_custkey").alias("particle_id"), F.floor(F.col("o_orderkey") / 4).alias("time_idx"))
    return relabel(df).select("dataset_id", "original_particle_id", "particle_id", "time_idx")


@register("compress_particles")
def compress_particles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' orders as short tracks, packed into columns."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = o.select((F.col("o_custkey") % 5).alias("dataset_id"), F.col("o_custkey").alias("particle_id"), F.floor(F.col("o_orderkey") / 4).alias("time_idx"))
    packed = compress_particles(df.withColumn("dataset_id", F.col("dataset_id").cast("int")))
    return packed.groupBy("dataset_id", "particle_id").agg(F.countDistinct("original_particle_id").alias("tracks"), F.count("*").alias("n"))


@register("from_dataframe_roles", "select c_nationkey::bigint particle_id, (dense_rank() over (order by c_acctbal) - 1)::bigint time_idx, c_acctbal * 2 x0 from customer")
def from_dataframe_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by name, and a fractional time column ranked to frames."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("Track_ID"), F.col("c_acctbal").alias("time"), (F.col("c_acctbal") * 2).alias("y"))
    return from_dataframe(c).select("particle_id", "time_idx", "x0")


VELOCITY = {
    "central": "coalesce((xp - xm) / (tp - tm), (xp - x0) / (tp - t), (x0 - xm) / (t - tm))",
    "forward": "(xp - x0) / (tp - t)",
    "backward": "(x0 - xm) / (t - tm)",
}


def _velocity(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = fd_velocity(lines(spark, sf_dir), mode)
        return v.select("dataset_id", "time_idx", rounded("v0", F.col("v0")), rounded("v1", F.col("v1")))

    return query


for _mode, _v in VELOCITY.items():
    register(
        f"fd_velocity_{_mode}",
        f"""with {LINES_SQL},
l as (select a.*, b.t tp, c.t tm, b.x0 xp, c.x0 xm, b.x1 yp, c.x1 ym
      from traj a left join traj b on b.dataset_id = a.dataset_id and b.time_idx = a.time_idx + 1
      left join traj c on c.dataset_id = a.dataset_id and c.time_idx = a.time_idx - 1)
select dataset_id, time_idx, round({_v}, 6) v0, round({_v.replace("xp", "yp").replace("xm", "ym").replace("x0", "x1")}, 6) v1 from l""",
    )(_velocity(_mode))


@register(
    "extras_by_prefix",
    f"""with {EVENTS_SQL},
g as (select dataset_id % 10 dataset_id, dataset_id particle_id, time_idx, x0 / 7.3 x0 from traj)
select dataset_id, particle_id, time_idx, round(avg(x0) over (partition by dataset_id), 6) "G_a", round(avg(x0) over (partition by dataset_id, time_idx), 6) "TG_b",
       round(avg(x0) over (partition by dataset_id, particle_id), 6) "P_c", round(x0, 6) "TP_d" from g""",
)
def extras_by_prefix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select((F.col("dataset_id") % 10).alias("dataset_id"), F.col("dataset_id").alias("particle_id"), "time_idx", *[(F.col("x0") / 7.3).alias(n) for n in ("G_a", "TG_b", "P_c", "TP_d")])
    return extras_by_prefix(e).select("dataset_id", "particle_id", "time_idx", *[rounded(n, F.col(n)) for n in ("G_a", "TG_b", "P_c", "TP_d")])


@register(
    "monomials_2d_features",
    f"""with {LINES_SQL} select dataset_id, time_idx, 1.0::double f0, round(x0, 6) f1, round(x1, 6) f2, round(x0 * x0, 6) f3, round(x0 * x1 / 1.7, 6) f4, round(x1 * x1 / 1.7, 6) f5 from traj""",
)
def monomials_2d_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bases.monomials_up_to(2, 2).columns()
    b[4:] = b[4:] / F.lit(1.7)  # off the boundaries of rounding
    return lines(spark, sf_dir).select("dataset_id", "time_idx", *[rounded(f"f{i}", c) for i, c in enumerate(b)])


@register(
    "gradient_features",
    f"""with {LINES_SQL} select dataset_id, time_idx, round(cos(x0 * x1) * x1, 6) d0, round(cos(x0 * x1) * x0, 6) d1, round(exp(-x0) * (1 - x0), 6) e0 from traj""",
)
def gradient_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives by rule, as columns."""
    from driftfield.functions.expr import Var, exp, sin

    x, y = Var("x0"), Var("x1")
    b = bases.Basis([sin(x * y), x * exp(-x)], 2).d_x().columns()
    return lines(spark, sf_dir).select("dataset_id", "time_idx", rounded("d0", b[0, 0]), rounded("d1", b[0, 1]), rounded("e0", b[1, 0]))


@register(
    "sliding_window_streams",
    f"""with {EVENTS_SQL},
w as (select *, count(*) over b n, avg(x0) over b a, max(x0) over b top from traj window b as (partition by dataset_id order by time_idx rows between 2 preceding and 2 following))
select dataset_id, time_idx, round(a, 6) mean, round(top, 6) top from w where n = 5""",
)
def sliding_window_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sliding(events(spark, sf_dir), 5).where("window is not null")
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 5
    return s.select("dataset_id", "time_idx", rounded("mean", mean), rounded("top", F.array_max("window")))


@register("halo_blocks", f"with {EVENTS_SQL}, l as (select *, (lead(x0) over w) - x0 u, x0 - (lag(x0) over w) m from traj window w as (partition by dataset_id order by time_idx)) select count(*)::bigint n, round(avg(u * m), 5) c1 from l where u is not null and m is not null")
def halo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag-one covariance by windows over blocks of ten frames with halos."""
    b = with_halo(events(spark, sf_dir), 10, reach=1)
    w = window(("dataset_id", "particle_id", "block"))
    s = b.withColumns({"u": F.lead("x0").over(w) - F.col("x0"), "m": F.col("x0") - F.lag("x0").over(w)}).where("not halo and u is not null and m is not null")
    return s.agg(F.count("*").alias("n"), rounded("c1", F.avg(F.col("u") * F.col("m")), 5))
