"""Interactions: pairs of particles in a frame, neighbours within a cutoff, and sums dispatched to their owners."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.functions.basis import Basis
from driftfield.functions.expr import Const, Expr, Var, is_zero, sqrt

FRAME = ("dataset_id", "time_idx")


def sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*FRAME, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in FRAME])


def all_pairs(df: DataFrame, symmetric: bool = True) -> DataFrame:
    """Pairs (i, j) of different particles of a frame, by an equi-join on the frame; ``symmetric`` gives both orders.

    A frame's pairs are what is asked for here; for large frames take :func:`neighbours`.
    """
    i, j = sided(df, "i"), sided(df, "j")
    rule = F.col("particle_id_i") != F.col("particle_id_j") if symmetric else F.col("particle_id_i") < F.col("particle_id_j")
    return i.join(j, list(FRAME)).where(rule)


def displacement(dim: int, box: Sequence[float] | None = None) -> list[Column]:
    """From i to j; across the nearest faces of a periodic box (half to even)."""
    out = []
    for k in range(dim):
        d = F.col(f"x{k}_j") - F.col(f"x{k}_i")
        out.append(d - F.rint(d / box[k]) * box[k] if box else d)
    return out


def distance(parts: Sequence[Column], soft: float = 1e-12) -> Column:
    return F.sqrt(sum((d * d for d in parts), F.lit(soft)))


def neighbours(df: DataFrame, cutoff: float, dim: int = 2, box: Sequence[float] | None = None, symmetric: bool = True) -> DataFrame:
    """Pairs of a frame within ``cutoff``, by a join on a grid of cells.

    Cells are at least a cutoff wide. One side is copied to the 3 ** dim cells
    around its own, so a pair meets in one cell; then its distance is tested. In
    a periodic box, positions and cells wrap, and an axis of fewer than three
    cells lists each cell once.
    """
    cells = [max(1, math.floor(box[k] / cutoff)) if box else None for k in range(dim)]
    wrapped = lambda c, k: F.pmod(c, F.lit(cells[k])) if box else c

    def cell(k: int) -> Column:
        width = box[k] / cells[k] if box else cutoff
        x = F.col(f"x{k}") - F.floor(F.col(f"x{k}") / box[k]) * box[k] if box else F.col(f"x{k}")
        return wrapped(F.floor(x / width), k)

    own = df.withColumns({f"cell{k}": cell(k) for k in range(dim)})
    around = [F.struct(*[wrapped(F.col(f"cell{k}") + o, k).alias(f"cell{k}") for k, o in enumerate(offsets)]) for offsets in product((-1, 0, 1), repeat=dim)]
    names = [f"cell{k}" for k in range(dim)]
    i = own.withColumn("near", F.explode(F.array_distinct(F.array(*around)))).drop(*names).select("*", "near.*").drop("near")
    keep = [*FRAME, *names]
    i = i.select(*keep, *[F.col(c).alias(f"{c}_i") for c in df.columns if c not in FRAME])
    j = own.select(*keep, *[F.col(c).alias(f"{c}_j") for c in df.columns if c not in FRAME])
    rule = F.col("particle_id_i") != F.col("particle_id_j") if symmetric else F.col("particle_id_i") < F.col("particle_id_j")
    pairs = i.join(j, keep).where(rule).drop(*names)
    return pairs.where(distance(displacement(dim, box), 0.0) <= cutoff)


def from_edges(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of a given edge table (dataset_id, [time_idx,] particle_id_i, particle_id_j); without time, in every frame."""
    i, j = sided(df, "i"), sided(df, "j")
    keys = [c for c in FRAME if c in edges.columns]
    return edges.join(i, [*keys, "particle_id_i"]).join(j, [*FRAME, "particle_id_j"])


def wrap_angle(a: Column) -> Column:
    return a - F.rint(a / (2 * math.pi)) * (2 * math.pi)


# Radial kernels: lists of (function of the distance, label).


def exp_poly_kernels(orders: Sequence[int], lengths: Sequence[float]) -> list[tuple[Callable[[Column], Column], str]]:
    return [(lambda r, k=k, a=a: _power(r, k) * F.exp(-r / a), f"r^{k} exp(-r/{a:g})") for k in orders for a in lengths]


def gaussian_kernels(widths: Sequence[float]) -> list[tuple[Callable[[Column], Column], str]]:
    return [(lambda r, s=s: F.exp(-(r * r) / (2 * s * s)), f"exp(-r^2/2 {s:g}^2)") for s in widths]


def power_kernels(powers: Sequence[int]) -> list[tuple[Callable[[Column], Column], str]]:
    return [(lambda r, k=k: _power(r, k), f"r^{k}") for k in powers]


def compact_kernels(orders: Sequence[int], cutoff: float) -> list[tuple[Callable[[Column], Column], str]]:
    """Powers times (1 - r / cutoff) squared, 0 from the cutoff on."""
    return [(lambda r, k=k: F.when(r < cutoff, _power(r, k) * (1 - r / cutoff) * (1 - r / cutoff)).otherwise(0.0), f"r^{k}(1-r/{cutoff:g})^2") for k in orders]


def _power(r: Column, k: int) -> Column:
    out = F.lit(1.0)
    for _ in range(abs(k)):
        out = out * r
    return out if k >= 0 else 1 / out


def radial(kernel: Callable[[Column], Column], parts: Sequence[Column]) -> list[Column]:
    """A kernel along the unit vector from i to j."""
    r = distance(parts)
    return [kernel(r) * d / r for d in parts]


def dyadic(kernel: Callable[[Column], Column], parts: Sequence[Column]) -> list[list[Column]]:
    r = distance(parts)
    return [[kernel(r) * a * b / (r * r) for b in parts] for a in parts]


def angular(kernel: Callable[[Column], Column], parts: Sequence[Column], coupling: Callable[[Column], Column] = F.sin, angle: str = "theta") -> Column:
    """A kernel times a function of the difference of two headings."""
    return kernel(distance(parts)) * coupling(wrap_angle(F.col(f"{angle}_j") - F.col(f"{angle}_i")))


def heading(angle: str = "theta_i") -> list[Column]:
    return [F.cos(angle), F.sin(angle)]


def vision_gate(parts: Sequence[Column], half_angle: float, angle: str = "theta_i") -> Column:
    """1 if j stands within the cone of sight of i, else 0."""
    r = distance(parts)
    ahead = sum((h * d for h, d in zip(heading(angle), parts, strict=True)), F.lit(0.0)) / r
    return F.when(ahead >= math.cos(half_angle), 1.0).otherwise(0.0)


def velocity_difference(dim: int) -> list[Column]:
    return [F.col(f"v{k}_j") - F.col(f"v{k}_i") for k in range(dim)]


def dispatch(pairs: DataFrame, values: Mapping[str, Column], owner: str = "focal", reducer: str = "sum") -> DataFrame:
    """Reduce pair values to their owners: the ``focal`` particle, ``all`` of the pair (each gets it), or the whole frame (``global``).

    ``reducer`` is sum, mean (by degree) or max.
    """
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[reducer]
    rows = pairs.select(*FRAME, F.col("particle_id_i"), F.col("particle_id_j"), *[v.alias(k) for k, v in values.items()])
    if owner == "global":
        return rows.groupBy(*FRAME).agg(*[how(k).alias(k) for k in values])
    if owner == "all":
        rows = rows.withColumn("particle_id", F.explode(F.array("particle_id_i", "particle_id_j")))
    else:
        rows = rows.withColumn("particle_id", F.col("particle_id_i"))
    return rows.groupBy(*FRAME, "particle_id").agg(*[how(k).alias(k) for k in values], F.count("*").alias("degree"))


def hyperedges(df: DataFrame, members: DataFrame, values: Sequence[str]) -> DataFrame:
    """Gather the particles of hyperedges (dataset_id, edge_id, slot, particle_id): one row per frame and edge, values as arrays by slot.

    An edge of which a member is missing in a frame is left out there.
    """
    size = members.groupBy("dataset_id", "edge_id").agg(F.count("*").alias("size"))
    rows = df.join(members, ["dataset_id", "particle_id"])
    rows = rows.groupBy(*FRAME, "edge_id").agg(F.array_sort(F.collect_list(F.struct("slot", *values))).alias("slots"))
    rows = rows.join(size, ["dataset_id", "edge_id"]).where(F.size("slots") == F.col("size"))
    return rows.select(*FRAME, "edge_id", *[F.col(f"slots.{v}").alias(v) for v in values])


# Pair features that enter a fit.


def separation(dim: int) -> list[Var]:
    """From the focal particle to the other, as variables of pair expressions."""
    return [Var(f"d{k}") for k in range(dim)]


def central(dim: int, kernel: Callable[[Expr], Expr], soft: float = 1e-12) -> list[Expr]:
    """A kernel of the distance along the unit vector to the other particle."""
    d = separation(dim)
    r = sqrt(sum((x * x for x in d), Const(soft)))
    return [kernel(r) * x / r for x in d]


@dataclass(frozen=True)
class Gathered(Var):
    """A column summed over pairs, with the columns of its derivatives in the focal particle's own place."""

    slopes: tuple[tuple[str, str], ...] = ()

    def diff(self, name):
        found = dict(self.slopes)
        return Var(found[name]) if name in found else super().diff(name)


def gathered(df: DataFrame, kernels: Mapping[str, Sequence[Expr]], pairs: DataFrame, box: Sequence[float] | None = None) -> tuple[DataFrame, Basis, list[str]]:
    """Vector features of pairs, summed over each particle's partners: (table with their columns, the features, the columns' names).

    A kernel has an expression per axis of the displacement d0.. to the other
    particle, and of any columns of both sides (``theta_i``, ``theta_j``).
    Derivatives in the focal particle's place follow from the expressions' own
    (its displacement changes with the opposite sign), so fits that need the
    Jacobian have it. A particle without partners has zeros.
    """
    dim = len(next(iter(kernels.values())))
    env = {f"d{k}": c for k, c in enumerate(displacement(dim, box))}
    columns: dict[str, Column] = {}
    features = []
    for a, kernel in enumerate(kernels.values()):
        parts = []
        for i, e in enumerate(kernel):
            name = f"pair{a}_{i}"
            columns[name] = e.column(env)
            slopes = []
            for n in range(dim):
                slope = -e.diff(f"d{n}")
                if not is_zero(slope):
                    slopes.append((f"x{n}", f"{name}_d{n}"))
                    columns[f"{name}_d{n}"] = slope.column(env)
            parts.append(Gathered(name, tuple(slopes)))
        features.append(parts)
    sums = dispatch(pairs, columns).drop("degree")
    out = df.join(sums, [*FRAME, "particle_id"], "left").fillna(0.0, list(columns))
    return out, Basis(features, dim, list(kernels)), list(columns)
