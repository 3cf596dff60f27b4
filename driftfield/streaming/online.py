"""Streaming: increments and diffusion of event streams, with a watermark for late rows. An addition to the batch engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "dataset_id long, t double, x0 double, dx double, dx_minus double, dt double, dt_minus double"
STATE = "t1 double, x1 double, t2 double, x2 double, n int"


def windowed_diffusion(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, means and mean squares of (dataset_id, ts, x0) over tumbling windows of event time; rows later than the watermark are dropped."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "dataset_id")
    return rows.agg(F.count("*").alias("n"), F.avg("x0").alias("mean"), F.avg(F.col("x0") * F.col("x0")).alias("mean_square"))


def increments(stream: DataFrame) -> DataFrame:
    """Per dataset, each new position with the two steps that lead to it; keeps the last two positions as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0.0, 0.0, 0.0, 0.0, 0]
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, x in zip(rows["t"], rows["x0"], strict=True):
            t2, x2, t1, x1, n = held
            if n and t <= t1:
                continue  # out of order beyond the batch: a masked frame
            if n >= 2:
                out.append((key[0], t1, x1, x - x1, x1 - x2, t - t1, t1 - t2))
            held = [t1, x1, float(t), float(x), min(2, n + 1)]
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return stream.groupBy("dataset_id").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def running_estimates(rows: DataFrame) -> DataFrame:
    """Sums for the localisation noise and the noise-robust diffusion, from increments."""
    u, m = F.col("dx"), F.col("dx_minus")
    return rows.groupBy("dataset_id").agg(
        F.count("*").alias("n"), F.avg(-u * m).alias("noise"), F.avg((u * u + 4 * u * m + m * m) / 4 / ((F.col("dt") + F.col("dt_minus")) / 2)).alias("diffusion")
    )
