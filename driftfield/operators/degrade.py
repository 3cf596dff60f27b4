"""Degradation of trajectories: downsampling with motion blur, noise, regions, losses."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.operators.streams import window
from driftfield.sources.tables import state_columns


def downsample(df: DataFrame, every: int, blur: int = 0, extras: Sequence[str] = ()) -> DataFrame:
    """Keep each ``every``-th frame; position and time become means over it and the ``blur`` next, all of which must be there.

    Frames are renumbered. Windows that would pass the dataset's last frame are left out.
    """
    if not 0 <= blur < every:
        raise ValueError("0 <= blur < every")
    names = [*state_columns(df), "t", *extras]
    w = window().rowsBetween(0, blur)
    full = (F.count("*").over(w) == blur + 1) & (F.max("time_idx").over(w) == F.col("time_idx") + blur)
    frames = F.max("time_idx").over(Window.partitionBy("dataset_id")) + 1
    rows = df.withColumns({"full_": full, "frames_": frames} | {f"{c}_": F.avg(c).over(w) for c in names})
    rows = rows.where(F.col("full_") & (F.col("time_idx") % every == 0) & (F.col("time_idx") < F.col("frames_") - blur))
    rows = rows.withColumns({c: F.col(f"{c}_") for c in names}).withColumn("time_idx", (F.col("time_idx") / every).cast("long"))
    return rows.select(*df.columns)


def standard_normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number for each key, by Box and Muller from a digest: reruns and partitions don't change it."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    u = [(F.conv(F.substring(h, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48) for at in (1, 13)]
    return F.sqrt(-2.0 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


#: The same in DuckDB SQL, of the text that the digest is taken of.
def normal_sql(text: str) -> str:
    u = [f"(('0x' || substr(md5({text}), {at}, 12))::bigint + 0.5::double) / 281474976710656.0::double" for at in (1, 13)]
    return f"(sqrt(-2.0::double * ln({u[0]})) * cos(6.283185307179586::double * {u[1]}))"


def add_noise(df: DataFrame, noise: float | Sequence[float] | np.ndarray, seed: int = 0) -> DataFrame:
    """Gaussian localisation noise: one sigma, one per axis, or a matrix that multiplies standard normals from the right.

    The numbers follow from seed, axis and the row's keys, so reruns agree.
    """
    cols = state_columns(df)
    m = np.asarray(noise, float)
    m = np.eye(len(cols)) * m if m.ndim < 2 else m
    eps = df.withColumns({f"e{i}_": standard_normal(seed, F.lit(str(i)), "dataset_id", "particle_id", "time_idx") for i in range(len(cols))})
    moved = {c: F.col(c) + sum((F.col(f"e{j}_") * float(m[j, i]) for j in range(len(cols)) if m[j, i]), F.lit(0.0)) for i, c in enumerate(cols)}
    return eps.withColumns(moved).select(*df.columns)


def roi(df: DataFrame, radius: float | None = None, box: Sequence[Sequence[float]] | None = None, predicate: Column | None = None) -> DataFrame:
    """Keep frames inside a ball around 0, a box (low, high), or where a predicate holds."""
    cols = state_columns(df)
    if radius is not None:
        df = df.where(F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))) <= radius)
    if box is not None:
        for i, c in enumerate(cols):
            df = df.where((F.col(c) >= box[0][i]) & (F.col(c) <= box[1][i]))
    return df if predicate is None else df.where(predicate)


def data_loss(df: DataFrame, fraction: float, seed: int = 0, keys: Sequence[str] = ("particle_id", "time_idx")) -> DataFrame:
    """Lose exactly n - round(n * (1 - fraction)) of each dataset's rows, chosen by a digest of seed and row, so reruns agree.

    The cut digest is found by counts in 4096 buckets, so a large dataset is not sorted in one task.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "dataset_id", *keys))
    rows = df.withColumn("h_", h).withColumn("b_", F.substring("h_", 1, 3))
    counts = rows.groupBy("dataset_id", "b_").agg(F.count("*").alias("k_"))
    ahead = Window.partitionBy("dataset_id").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("dataset_id")
    counts = counts.select("dataset_id", "b_", F.coalesce(F.sum("k_").over(ahead), F.lit(0)).alias("ahead_"), F.rint(F.sum("k_").over(everything) * (1 - fraction)).alias("keep_"))
    place = F.col("ahead_") + F.row_number().over(Window.partitionBy("dataset_id", "b_").orderBy("h_", *keys))
    return rows.join(counts, ["dataset_id", "b_"]).withColumn("place_", place).where("place_ <= keep_").select(*df.columns)


def degrade(df: DataFrame, every: int = 1, blur: int = 0, noise=None, radius: float | None = None, box=None, loss: float = 0.0, seed: int = 0) -> DataFrame:
    """Downsampling with blur, noise, region, loss: in that order."""
    if every > 1 or blur:
        df = downsample(df, every, blur)
    if noise is not None:
        df = add_noise(df, noise, seed)
    df = roi(df, radius, box)
    return data_loss(df, loss, seed) if loss else df
