"""Trajectory tables: column roles, readers and writers, and views of event-like tables as trajectories.

The canonical table is long: one row per observed (dataset_id, particle_id,
time_idx), with t, x0.. and any extras. A frame that is masked or missing has no row.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("dataset_id", "particle_id")
#: The names by which roles are found, in order.
PARTICLE_NAMES = ("particle_id", "particle", "track_id", "track", "traj_id")
TIME_NAMES = ("time_step", "frame", "time", "t")
#: Extras by prefix: per dataset, per time, per particle, per both.
PREFIXES = {"TG_": ["dataset_id", "time_idx"], "TP_": ["dataset_id", "particle_id", "time_idx"], "P_": ["dataset_id", "particle_id"], "G_": ["dataset_id"]}


def detect(columns: Sequence[str], candidates: Sequence[str], role: str) -> str:
    """The one column that has the role by its name, in any case."""
    found = [c for c in columns if c.lower() in candidates]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} {role} column among {list(columns)}: {found}")
    return found[0]


def state_columns(df: DataFrame) -> list[str]:
    found = [c for c in df.columns if re.fullmatch(r"x\d+", c)]
    return sorted(found, key=lambda c: int(c[1:]))


def from_dataframe(
    df: DataFrame, particle: str | None = None, time: str | None = None, state: Sequence[str] | None = None, dataset: Column | int = 0
) -> DataFrame:
    """The canonical table of a tidy one. Roles are found by name; a fractional time column becomes frame numbers.

    Rows with a null or NaN state are dropped, as masked frames. Frame numbers
    come from the distinct times, so only those are ranked in one place.
    """
    particle = particle or detect(df.columns, PARTICLE_NAMES, "particle")
    time = time or detect(df.columns, TIME_NAMES, "time")
    extras = [c for c in df.columns if c.startswith(tuple(PREFIXES))]
    state = list(state) if state else [c for c in df.columns if c not in (particle, time, *extras)]
    out = df.select(
        (F.lit(dataset) if isinstance(dataset, int) else dataset).cast("int").alias("dataset_id"), F.col(particle).cast("long").alias("particle_id"),
        F.col(time).alias("t"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(state)], *extras,
    )
    if dict(df.dtypes)[time] in ("double", "float") or dict(df.dtypes)[time].startswith("decimal"):
        times = df.select(F.col(time).alias("t")).distinct().select("t", (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("time_idx"))
        out = out.join(times, "t").withColumn("t", F.col("t").cast("double"))
    else:
        out = out.withColumn("time_idx", F.col("t").cast("long")).withColumn("t", F.col("t").cast("double"))
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in state_columns(out)]
    for condition in ok:
        out = out.where(condition)
    return out


def from_arrays(spark: SparkSession, x, t=None, dt: float = 1.0, mask=None, dataset: int = 0) -> DataFrame:
    """The canonical table of a dense array (frame, particle, axis) or (frame, axis), with times, or a step, and a mask of what is there.

    Rows that the mask leaves out, or that have a NaN, do not exist.
    """
    x = np.asarray(x, float)
    x = x[:, None, :] if x.ndim == 2 else x
    frames, particles, dim = x.shape
    t = np.arange(frames) * dt if t is None else np.asarray(t, float)
    there = ~np.isnan(x).any(axis=2) & (True if mask is None else np.asarray(mask, bool).reshape(frames, particles))
    frame, particle = np.nonzero(there)
    table = {"dataset_id": pa.array(np.full(len(frame), dataset, np.int32)), "particle_id": pa.array(particle), "time_idx": pa.array(frame), "t": pa.array(t[frame])}
    return spark.createDataFrame(pa.table(table | {f"x{i}": pa.array(x[frame, particle, i]) for i in range(dim)}))


def to_arrays(df: DataFrame, dataset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, t, mask) of one dataset, dense over its frames and particles; what is not there is NaN. For what fits the driver."""
    names = state_columns(df)
    found = df.where(F.col("dataset_id") == dataset).select("time_idx", "particle_id", "t", *names).toPandas()
    particles, at = np.unique(found["particle_id"], return_inverse=True)
    frames = int(found["time_idx"].max()) + 1 if len(found) else 0
    x, t = np.full((frames, len(particles), len(names)), np.nan), np.full(frames, np.nan)
    k = found["time_idx"].to_numpy(int)
    x[k, at], t[k] = found[names].to_numpy(), found["t"]
    return x, t, ~np.isnan(x).any(axis=2)


def extras_by_prefix(df: DataFrame) -> DataFrame:
    """Average prefixed extras over what their prefix says: G_ a dataset, TG_ a time, P_ a particle, TP_ both. NaN and null don't count."""
    for prefix, keys in PREFIXES.items():
        names = [c for c in df.columns if c.startswith(prefix)]
        if names:
            w = Window.partitionBy(*keys)
            df = df.withColumns({c: F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).over(w) for c in names})
    return df


def relabel(df: DataFrame) -> DataFrame:
    """Particles numbered from 0 in order of their ids, time from 0, per dataset; the id stays as original_particle_id."""
    ids = df.select("dataset_id", "particle_id").distinct()
    ids = ids.withColumn("new_id", (F.row_number().over(Window.partitionBy("dataset_id").orderBy("particle_id")) - 1).cast("long"))
    first = df.groupBy("dataset_id").agg(F.min("time_idx").alias("first_idx"))
    out = df.join(ids, ["dataset_id", "particle_id"]).join(first, "dataset_id")
    out = out.withColumn("original_particle_id", F.col("particle_id")).withColumn("particle_id", F.col("new_id"))
    return out.withColumn("time_idx", F.col("time_idx") - F.col("first_idx")).drop("new_id", "first_idx")


def compress_particles(df: DataFrame) -> DataFrame:
    """Pack short tracks into few columns: in order of their first frame, each takes the first column free for at least one frame.

    Only spans (one row per track) are gathered, per dataset.
    """
    spans = df.groupBy("dataset_id", "particle_id").agg(F.min("time_idx").alias("first"), F.max("time_idx").alias("last"))

    def pack(pdf):
        pdf = pdf.sort_values(["first", "particle_id"]).reset_index(drop=True)
        busy: list[tuple[int, int]] = []  # heaps of (last frame, column) and of free columns: n log n for n tracks
        free: list[int] = []
        slots = []
        for first, last in zip(pdf["first"], pdf["last"], strict=True):
            while busy and busy[0][0] <= first - 2:
                heapq.heappush(free, heapq.heappop(busy)[1])
            slot = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (last, slot))
            slots.append(slot)
        pdf["slot"] = slots
        return pdf[["dataset_id", "particle_id", "slot"]]

    packed = spans.groupBy("dataset_id").applyInPandas(pack, "dataset_id int, particle_id long, slot long")
    out = df.join(packed, ["dataset_id", "particle_id"]).withColumn("original_particle_id", F.col("particle_id"))
    return out.withColumn("particle_id", F.col("slot")).drop("slot")


def save(df: DataFrame, path: str, fmt: str = "parquet", meta: dict | None = None) -> None:
    """Write a canonical table, a folder per dataset, with its metadata in a one-row JSON table beside it."""
    df.write.partitionBy("dataset_id").format(fmt).option("header", True).option("compression", "snappy" if fmt == "parquet" else "none").save(path + "/data")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}, sort_keys=True), fmt)], "meta string, format string").coalesce(1).write.json(path + "/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    head = spark.read.schema("meta string, format string").json(path + "/meta").first()
    reader = spark.read.option("header", True).option("comment", "#").option("inferSchema", head["format"] == "csv")
    return reader.format(head["format"]).load(path + "/data"), json.loads(head["meta"])


def load_csv(spark: SparkSession, path: str, particle: int | str = 0, time: int | str = 1, state: Sequence[str] | None = None) -> DataFrame:
    """A CSV file or folder with ``#`` comment lines ahead of its header; roles by position unless named."""
    df = spark.read.option("header", True).option("comment", "#").option("inferSchema", True).csv(path)
    name = lambda c: df.columns[c] if isinstance(c, int) else c
    return from_dataframe(df, name(particle), name(time), state)


def load_hdf5(*_: object) -> DataFrame:
    raise NotImplementedError("HDF5 needs h5py, which is not installed; convert to Parquet first")


def collection(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files of single experiments as one table; dataset_id is the place in ``paths``."""
    parts = [from_dataframe(spark.read.parquet(p), dataset=i) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a one-particle dataset: t in hours, x0 the value, the event's type as an extra."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("long").alias("dataset_id"), F.col("event_id").alias("event_id"), "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("t"), F.col("value").alias("x0"),
    )
    order = Window.partitionBy("dataset_id").orderBy("t", "event_id")
    return e.withColumn("time_idx", (F.row_number().over(order) - 1).cast("long")).withColumn("particle_id", F.lit(0).cast("long"))


#: The same in DuckDB SQL.
EVENTS_SQL = """traj as (
  select user_id::bigint dataset_id, event_id, event_type, 0::bigint particle_id, epoch_us(ts) / 3.6e9 t, value x0,
         row_number() over (partition by user_id order by epoch_us(ts) / 3.6e9, event_id) - 1 time_idx
  from events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a two-dimensional trajectory with unit time step: quantity / 10, and price per item / 97.

    Numbers that an order lacks are masked frames; of lines that share one, the largest values count.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return one.select(
        F.col("l_orderkey").alias("dataset_id"), F.lit(0).cast("long").alias("particle_id"), (F.col("l_linenumber") - 1).cast("long").alias("time_idx"),
        (F.col("l_linenumber") - 1).cast("double").alias("t"), (F.col("q") / 10).alias("x0"), (F.col("p") / 97).alias("x1"),
    )


LINES_SQL = """traj as (
  select l_orderkey dataset_id, 0::bigint particle_id, (l_linenumber - 1)::bigint time_idx, (l_linenumber - 1)::double t,
         max(l_quantity) / 10 x0, max(l_extendedprice / l_quantity) / 97 x1
  from lineitem group by l_orderkey, l_linenumber)"""


def swarm(spark: SparkSession, sf_dir: str, per_frame: int = 40) -> DataFrame:
    """Embedding vectors as particles: ``per_frame`` of them in a frame, positions and velocities from their first components, label as species."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 10, 6)
    return e.select(
        F.lit(0).cast("long").alias("dataset_id"), F.floor(F.col("vec_id") / per_frame).cast("long").alias("time_idx"),
        (F.col("vec_id") % per_frame).cast("long").alias("particle_id"), F.floor(F.col("vec_id") / per_frame).cast("double").alias("t"),
        at(1).alias("x0"), at(2).alias("x1"), at(3).alias("v0"), at(4).alias("v1"), at(5).alias("theta"), F.col("label").alias("species"),
    )


SWARM_SQL = """traj as (
  select 0::bigint dataset_id, (vec_id // 40)::bigint time_idx, (vec_id % 40)::bigint particle_id, (vec_id // 40)::double t,
         round(embedding[1]::double * 10, 6) x0, round(embedding[2]::double * 10, 6) x1, round(embedding[3]::double * 10, 6) v0,
         round(embedding[4]::double * 10, 6) v1, round(embedding[5]::double * 10, 6) theta, label species
  from embeddings)"""


def grid(spark: SparkSession, sf_dir: str, side: int = 16) -> DataFrame:
    """A field on a square grid: customers dealt to the sites (c0, c1) of frames by key, two fields from their balances.

    Customer k stands at site k mod side**2 of frame k // side**2; only whole frames are kept.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"))
    sites = side * side
    rows = c.select(
        F.floor(F.col("k") / sites).cast("long").alias("time_idx"), F.floor((F.col("k") % sites) / side).cast("long").alias("c0"),
        (F.col("k") % side).cast("long").alias("c1"), (F.col("b") / 1000).alias("x0"), (F.col("b") / 1000 * F.col("b") / 1000).alias("x1"),
    )
    return rows.withColumn("dataset_id", F.lit(0).cast("long"))


GRID_SQL = """grid as (
  select 0::bigint dataset_id, (c_custkey // 256)::bigint time_idx, ((c_custkey % 256) // 16)::bigint c0, (c_custkey % 16)::bigint c1,
         c_acctbal / 1000 x0, c_acctbal / 1000 * c_acctbal / 1000 x1
  from customer)"""
