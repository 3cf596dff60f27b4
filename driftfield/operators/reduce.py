"""Integrals over (dataset, time, particle): many sums of row-wise terms in one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.operators.estimators import step
from driftfield.operators.streams import mask

#: Up to this many sums are left to Catalyst; more are reduced as matrices of Arrow batches.
SUM_COLUMNS = 120


def integrate(
    df: DataFrame, terms: Mapping[str, Column], needs: Mapping[str, Sequence[str]], weight_by_dt: bool = True, mean: bool = False,
    subsampling: int = 1, weight: Column | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Sum (or average) row-wise terms, each over the rows that its own streams allow, in one pass.

    ``terms`` are Columns over streams, ``needs`` the streams of each. Means divide
    by the exposure of the same rows: their time, or their number. ``weight``
    multiplies both. With ``by``, one row per group.
    """
    out = []
    for name, term in terms.items():
        ok = mask(needs[name])
        if subsampling > 1:
            ok = ok & (F.col("time_idx") % subsampling == 0)
        w = step() if weight_by_dt else F.lit(1.0)
        w = w * weight if weight is not None else w
        total = F.sum(F.when(ok, term * w))
        out.append((total / F.sum(F.when(ok, w)) if mean else F.coalesce(total, F.lit(0.0))).alias(name))
    return (df.groupBy(*by) if by else df.groupBy()).agg(*out)


@dataclass(frozen=True)
class Product:
    """Sums over rows of left[i, k] * right[j, k] * weight, added up over k: a matrix (i, j).

    ``left`` and ``right`` are object arrays of Columns with one inner axis; None
    stands for a structural zero.
    """

    left: np.ndarray
    right: np.ndarray
    weight: Column

    def cells(self) -> dict[tuple[int, int], list[int]]:
        """The inner indices that count for each (i, j); those without any are zero."""
        inner = range(self.left.shape[1])
        each = {(i, j): [k for k in inner if self.left[i, k] is not None and self.right[j, k] is not None] for i in range(len(self.left)) for j in range(len(self.right))}
        return {at: ks for at, ks in each.items() if ks}


def products(df: DataFrame, wanted: Mapping[str, Product]) -> dict[str, np.ndarray]:
    """Several matrices of sums in one pass over ``df``.

    A few sums stay in generated code. Many would pass the size that a method may
    have, so wide dictionaries become matrix products of Arrow batches; each task
    returns one array and the driver gets their sum. Either way a row counts for
    (i, j) unless one of the columns is null there; NaN and infinity go through.
    """
    out = {name: np.zeros((len(p.left), len(p.right))) for name, p in wanted.items()}
    cells = {name: p.cells() for name, p in wanted.items()}
    if sum(map(len, cells.values())) <= SUM_COLUMNS:
        sums = []
        for name, p in wanted.items():
            for i, j in cells[name]:
                term = reduce(add, (p.left[i, k] * p.right[j, k] for k in cells[name][i, j]))
                sums.append(F.sum(term * p.weight).alias(f"{name}_{i}_{j}"))
        row = df.agg(*sums).first() if sums else {}
        for name in wanted:
            for i, j in cells[name]:
                v = row[f"{name}_{i}_{j}"]
                out[name][i, j] = 0.0 if v is None else v
        return out
    columns: list[Column] = []

    def placed(array: np.ndarray) -> np.ndarray:
        at = np.full(array.shape, -1)
        for k in np.ndindex(array.shape):
            if array[k] is not None:
                at[k] = len(columns)
                columns.append(array[k])
        return at

    plan = []
    for p in wanted.values():
        columns.append(p.weight)
        plan.append((len(columns) - 1, placed(p.left), placed(p.right)))
    flat = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    sizes = [m.size for m in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(a), len(b))) for _, a, b in plan]
        for batch in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns] + [np.ones(batch.num_rows, bool)], axis=1)
            values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns] + [np.zeros(batch.num_rows)], axis=1)
            for total, (w, a, b) in zip(totals, plan, strict=True):
                rows = there[:, w]
                whole = rows & there[:, a.ravel()].all(axis=1) & there[:, b.ravel()].all(axis=1)
                left, right = values[whole][:, a] * values[whole, w][:, None, None], values[whole][:, b]
                total += np.tensordot(left, right, ([0, 2], [0, 2]))
                for r in np.flatnonzero(rows & ~whole):  # nulls leave out their own sums only
                    ok = there[r][a].all(axis=1)[:, None] & there[r][b].all(axis=1)[None, :]
                    total[ok] += (values[r][a] * values[r, w] @ values[r][b].T)[ok]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([t.ravel() for t in totals]).tolist()], pa.list_(pa.float64()))], ["g"])

    parts = flat.mapInArrow(run, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g")).orderBy("k").collect()  # a row per sum
    flat_sums = np.split(np.array([r["g"] for r in sums]), np.cumsum(sizes)[:-1])
    return {name: v.reshape(out[name].shape) for name, v in zip(out, flat_sums, strict=True)}


def gram(df: DataFrame, left: Sequence[Column], right: Sequence[Column], weight: Column) -> np.ndarray:
    """The matrix of sums of left[i] * right[j] * weight."""
    side = lambda columns: np.array([[c] for c in columns] + [[None]], object)[:-1]
    return products(df, {"g": Product(side(left), side(right), weight)})["g"]


def exposure(df: DataFrame, needs: Sequence[str], by_dt: bool = True) -> DataFrame:
    """Teff of each dataset: the time (or number) of rows that the streams allow, without the step that integrals add."""
    ok = mask(needs, integral=False)
    return df.groupBy("dataset_id").agg(F.coalesce(F.sum(F.when(ok, step() if by_dt else F.lit(1.0))), F.lit(0.0)).alias("teff"))


def dataset_weights(df: DataFrame, mode: str = "pool", needs: Sequence[str] = ("dt",), explicit: Mapping[int, float] | None = None) -> DataFrame:
    """(dataset_id, weight): all 1, or the mean positive Teff over each one's own (0 where that is 0), or as given. Not normalised."""
    teff = exposure(df, needs)
    if mode == "pool":
        return teff.select("dataset_id", F.lit(1.0).alias("weight"))
    if mode == "per_dataset":
        mean = teff.where("teff > 0").agg(F.avg("teff").alias("mean"))
        return teff.crossJoin(F.broadcast(mean)).select("dataset_id", F.when(F.col("teff") > 0, F.col("mean") / F.col("teff")).otherwise(0.0).alias("weight"))
    if mode == "explicit":
        pairs = F.create_map(*[F.lit(x) for kv in explicit.items() for x in kv])
        return teff.select("dataset_id", F.coalesce(pairs[F.col("dataset_id")], F.lit(0.0)).alias("weight"))
    raise ValueError(f"weights are pool, per_dataset or explicit, not {mode}")


def split_time(df: DataFrame, fraction: float, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Each dataset's frames before round(fraction * T), half to even, and those from ``gap`` frames after it."""
    frames = df.groupBy("dataset_id").agg((F.max("time_idx") + 1).alias("frames"))
    cut = F.rint(F.col("frames") * fraction)
    cut = F.greatest(F.lit(2), F.least(cut, F.col("frames") - gap - 2))
    rows = df.join(frames, "dataset_id")
    return rows.where(F.col("time_idx") < cut).select(*df.columns), rows.where(F.col("time_idx") >= cut + gap).select(*df.columns)


def concat(*tables: DataFrame) -> DataFrame:
    """Append collections; the datasets of each later one are numbered on."""
    out = tables[0]
    for t in tables[1:]:
        top = out.agg(F.coalesce(F.max("dataset_id") + 1, F.lit(0)).alias("top"))
        out = out.unionByName(t.crossJoin(F.broadcast(top)).withColumn("dataset_id", (F.col("dataset_id") + F.col("top"))).drop("top"), allowMissingColumns=True)
    return out


def subsample(df: DataFrame, every: int) -> DataFrame:
    return df.where(F.col("time_idx") % every == 0)


def dataset_index(df: DataFrame, key: str) -> DataFrame:
    """Datasets numbered in the order of their first appearance (by dataset_id) of ``key``."""
    first = df.groupBy(key).agg(F.min("dataset_id").alias("first"))
    from pyspark.sql import Window

    return first.select(key, (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("dataset_index"))
