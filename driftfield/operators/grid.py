"""Fields on grids: finite-difference operators as joins with shifted neighbours, fused over compositions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ("dataset_id", "time_idx")
Offset = tuple[int, ...]
#: An operator on one field: weights of the values at offsets.
Stencil = Mapping[Offset, float]


def unit(dim: int, axis: int, k: int = 1) -> Offset:
    return tuple(k if i == axis else 0 for i in range(dim))


def combine(*weighted: tuple[float, Stencil]) -> dict[Offset, float]:
    out: dict[Offset, float] = {}
    for w, s in weighted:
        for o, v in s.items():
            out[o] = out.get(o, 0.0) + w * v
    return {o: v for o, v in out.items() if v}


def compose(a: Stencil, b: Stencil) -> dict[Offset, float]:
    """One operator after the other, as one stencil over the sums of their offsets."""
    out: dict[Offset, float] = {}
    for (p, v), (q, w) in product(a.items(), b.items()):
        o = tuple(x + y for x, y in zip(p, q, strict=True))
        out[o] = out.get(o, 0.0) + v * w
    return {o: v for o, v in out.items() if v}


def central(dim: int, axis: int, dx: float = 1.0) -> dict[Offset, float]:
    return {unit(dim, axis): 1 / (2 * dx), unit(dim, axis, -1): -1 / (2 * dx)}


def second(dim: int, axis: int, dx: float = 1.0) -> dict[Offset, float]:
    return {unit(dim, axis): 1 / dx**2, unit(dim, axis, -1): 1 / dx**2, unit(dim, 0, 0): -2 / dx**2}


def laplacian(dim: int, dx: float = 1.0) -> dict[Offset, float]:
    return combine(*[(1.0, second(dim, a, dx)) for a in range(dim)])


def biharmonic(dim: int, dx: float = 1.0) -> dict[Offset, float]:
    """Fourth differences along each axis (1 -4 6 -4 1) and twice the mixed ones: 13 points in two dimensions."""
    return compose(laplacian(dim, dx), laplacian(dim, dx))


def shape_of(df: DataFrame, dim: int) -> list[int]:
    row = df.agg(*[F.max(f"c{a}").alias(f"c{a}") for a in range(dim)]).first()
    return [int(row[a]) + 1 for a in range(dim)]


def neighbourhood(df: DataFrame, offsets: Sequence[Offset], fields: Sequence[str], shape: Sequence[int], edge: str = "pbc") -> DataFrame:
    """Each site with its fields at ``offsets``, as a map per field from the offset's text.

    Every site is sent to the sites that see it and collected there: one
    shuffle for any number of offsets. ``edge`` says what lies beyond the grid:
    pbc wraps; noflux repeats the site itself; drop leaves such sites out, with
    all whose neighbour is missing.
    """
    dim = len(shape)
    sends = []
    for o in offsets:
        at = [F.col(f"c{a}") - o[a] for a in range(dim)]  # the site that sees this one at o
        if edge == "pbc":
            at = [F.pmod(c, F.lit(n)) for c, n in zip(at, shape, strict=True)]
        sends.append(F.struct(*[c.alias(f"c{a}") for a, c in enumerate(at)], F.lit(str(o)).alias("o")))
    rows = df.select(*FRAME, *fields, F.explode(F.array(*sends)).alias("s")).select(*FRAME, *fields, "s.*")
    for a, n in enumerate(shape):
        rows = rows.where((F.col(f"c{a}") >= 0) & (F.col(f"c{a}") < n))
    sites = [*FRAME, *[f"c{a}" for a in range(dim)]]
    seen = rows.groupBy(*sites).agg(*[F.max(F.when(F.col("o") == str(o), F.col(f))).alias(f"{f}@{i}") for f in fields for i, o in enumerate(offsets)])
    zero = offsets.index((0,) * dim)
    seen = seen.where(F.col(f"{fields[0]}@{zero}").isNotNull())
    for f in fields:
        for i in range(len(offsets)):
            if edge == "noflux":
                seen = seen.withColumn(f"{f}@{i}", F.coalesce(F.col(f"`{f}@{i}`"), F.col(f"`{f}@{zero}`")))
            elif i != zero:
                seen = seen.where(F.col(f"`{f}@{i}`").isNotNull())
    return seen


def apply(df: DataFrame, operators: Mapping[str, Sequence[tuple[str, Stencil]]], shape: Sequence[int], edge: str = "pbc") -> DataFrame:
    """Evaluate linear operators, each a sum of (field, stencil), over one neighbourhood that covers them all."""
    dim = len(shape)
    offsets = sorted({o for parts in operators.values() for _, s in parts for o in s} | {(0,) * dim})
    fields = sorted({f for parts in operators.values() for f, _ in parts})
    seen = neighbourhood(df, offsets, fields, shape, edge)
    out = []
    for name, parts in operators.items():
        total = F.lit(0.0)
        for f, s in parts:
            for o in sorted(s):
                total = total + F.lit(float(s[o])) * F.col(f"`{f}@{offsets.index(o)}`")
        out.append(total.alias(name))
    return seen.select(*FRAME, *[f"c{a}" for a in range(dim)], *out)


def gradient(field: str, dim: int = 2, dx: float = 1.0) -> dict[str, list]:
    return {f"d{a}_{field}": [(field, central(dim, a, dx))] for a in range(dim)}


def divergence(fields: Sequence[str], dx: float = 1.0) -> dict[str, list]:
    return {"div": [(f, central(len(fields), a, dx)) for a, f in enumerate(fields)]}


def curl2d(fields: Sequence[str], dx: float = 1.0) -> dict[str, list]:
    return {"curl": [(fields[1], central(2, 0, dx)), (fields[0], combine((-1.0, central(2, 1, dx))))]}


def curl3d(fields: Sequence[str], dx: float = 1.0) -> dict[str, list]:
    return {
        f"curl{a}": [(fields[(a + 2) % 3], central(3, (a + 1) % 3, dx)), (fields[(a + 1) % 3], combine((-1.0, central(3, (a + 2) % 3, dx))))]
        for a in range(3)
    }


def velocity_gradient(fields: Sequence[str], dx: float = 1.0, sign: int = 1) -> dict[str, list]:
    """The symmetric (sign 1: strain rate) or antisymmetric (sign -1: vorticity) part of a vector field's gradient."""
    dim, out = len(fields), {}
    for a in range(dim):
        for b in range(dim):
            parts = [(fields[b], combine((0.5, central(dim, a, dx)))), (fields[a], combine((0.5 * sign, central(dim, b, dx))))]
            out[f"g{a}{b}"] = [(f, s) for f, s in parts if s]
    return out


def advection(df: DataFrame, field: str, by: Sequence[str], shape: Sequence[int], dx: float = 1.0, edge: str = "pbc") -> DataFrame:
    """(v . grad) f with v at the site."""
    dim = len(shape)
    grads = apply(df, gradient(field, dim, dx) | {f"at_{v}": [(v, {(0,) * dim: 1.0})] for v in by}, shape, edge)
    total = sum((F.col(f"at_{v}") * F.col(f"d{a}_{field}") for a, v in enumerate(by)), F.lit(0.0))
    return grads.select(*FRAME, *[f"c{a}" for a in range(dim)], total.alias("advection"))


def laplacian_of_gradient_squared(df: DataFrame, field: str, shape: Sequence[int], dx: float = 1.0, edge: str = "pbc") -> DataFrame:
    """The Laplacian of the squared gradient: its squares are local, so the field is gathered once more for the outer stencil."""
    dim = len(shape)
    grads = apply(df, gradient(field, dim, dx), shape, edge)
    square = sum((F.col(f"d{a}_{field}") * F.col(f"d{a}_{field}") for a in range(dim)), F.lit(0.0))
    return apply(grads.withColumn("g2", square), {"lap_g2": [("g2", laplacian(dim, dx))]}, shape, edge)


def box_blur(df: DataFrame, fields: Sequence[str], radius: int, shape: Sequence[int], edge: str = "pbc") -> DataFrame:
    """The mean over a box of 2 * radius + 1 sites per axis, of the sites that are there; axis by axis, as sums of values and counts.

    pbc wraps, noflux repeats the edge's sites, drop takes what is inside.
    """
    dim = len(shape)
    rows = df.select(*FRAME, *[f"c{a}" for a in range(dim)], *fields, F.lit(1.0).alias("n"))
    for a, size in enumerate(shape):
        to = F.explode(F.sequence(F.col(f"c{a}") - radius, F.col(f"c{a}") + radius))
        spread = rows.withColumn("to", to).withColumn("w", F.lit(1.0))
        if edge == "pbc":
            spread = spread.withColumn("to", F.pmod("to", F.lit(size)))
        else:
            if edge == "noflux":  # an edge site stands for those beyond it
                beyond = lambda d: F.greatest(F.lit(0), d).cast("double")
                first = F.when(F.col(f"c{a}") == 0, beyond(radius - F.col("to"))).otherwise(0.0)
                last = F.when(F.col(f"c{a}") == size - 1, beyond(radius - (size - 1 - F.col("to")))).otherwise(0.0)
                spread = spread.withColumn("w", 1.0 + first + last)
            spread = spread.where((F.col("to") >= 0) & (F.col("to") < size))
        keys = [*FRAME, *[f"c{b}" for b in range(dim) if b != a], F.col("to").alias(f"c{a}")]
        rows = spread.groupBy(*keys).agg(*[F.sum(F.col(f) * F.col("w")).alias(f) for f in fields], F.sum(F.col("n") * F.col("w")).alias("n"))
    return rows.select(*FRAME, *[f"c{a}" for a in range(dim)], *[(F.col(f) / F.col("n")).alias(f) for f in fields])


def block_downscale(df: DataFrame, fields: Sequence[str], factor: int, shape: Sequence[int], threshold: float = 0.5) -> DataFrame:
    """Means over blocks of factor ** dim sites; a block counts if at least a share ``threshold`` of it is there (one site at least). The high end is cropped."""
    dim = len(shape)
    need = max(1, -int(-(threshold * factor**dim) // 1))
    rows = df
    for a, size in enumerate(shape):
        rows = rows.where(F.col(f"c{a}") < size // factor * factor)
    keys = [*FRAME, *[F.floor(F.col(f"c{a}") / factor).alias(f"c{a}") for a in range(dim)]]
    out = rows.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in fields], F.count("*").alias("n"))
    return out.where(F.col("n") >= need).drop("n")
