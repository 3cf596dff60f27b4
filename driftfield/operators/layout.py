"""Declarative fields on a grid: named sectors over columns, and equations of them compiled to one neighbourhood."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.operators import grid as gr
from driftfield.operators.degrade import data_loss, standard_normal


@dataclass(frozen=True)
class Sector:
    """A named field: the columns of its components. ``rank`` 0 is a scalar, 1 a vector, 2 a symmetric tensor in Voigt order."""

    name: str
    columns: tuple[str, ...]
    rank: int = 0

    def component(self, *index: int) -> str:
        if len(index) != self.rank:
            raise ValueError(f"{self.name} has {self.rank} indices")
        if self.rank < 2:
            return self.columns[index[0] if index else 0]
        return self.columns[voigt(*index, dim=2 if len(self.columns) == 3 else 3)]


def voigt(i: int, j: int, dim: int) -> int:
    """The place of a symmetric pair: the diagonal first, then the pairs off it from the last axis down."""
    if i == j:
        return i
    pairs = [(a, b) for a in range(dim - 1, -1, -1) for b in range(dim - 1, a, -1)]
    return dim + pairs.index((min(i, j), max(i, j)))


def scalar(name: str, column: str) -> Sector:
    return Sector(name, (column,))


def vector(name: str, columns: Sequence[str]) -> Sector:
    return Sector(name, tuple(columns), 1)


def sym_tensor(name: str, columns: Sequence[str]) -> Sector:
    return Sector(name, tuple(columns), 2)


@dataclass
class Layout:
    """A grid of ``shape`` with spacing ``dx``. Operators are asked for by name and evaluated together."""

    shape: Sequence[int]
    dx: float = 1.0
    edge: str = "pbc"
    asked: dict[str, list[tuple[str, gr.Stencil]]] = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return len(self.shape)

    def _ask(self, name: str, parts: Sequence[tuple[str, gr.Stencil]]) -> str:
        if name in self.asked:
            raise ValueError(f"{name} is asked for already")
        self.asked[name] = list(parts)
        return name

    def value(self, s: Sector) -> list[str]:
        return [self._ask(f"{s.name}_{i}" if s.rank else s.name, [(c, {(0,) * self.dim: 1.0})]) for i, c in enumerate(s.columns)]

    def grad(self, s: Sector) -> list[str]:
        return [self._ask(f"grad{a}_{s.name}", [(s.component(), gr.central(self.dim, a, self.dx))]) for a in range(self.dim)]

    def lap(self, s: Sector) -> list[str]:
        return [self._ask(f"lap_{s.name}{i if s.rank else ''}", [(c, gr.laplacian(self.dim, self.dx))]) for i, c in enumerate(s.columns)]

    def biharmonic(self, s: Sector) -> list[str]:
        return [self._ask(f"bih_{s.name}{i if s.rank else ''}", [(c, gr.biharmonic(self.dim, self.dx))]) for i, c in enumerate(s.columns)]

    def div(self, s: Sector) -> list[str]:
        """The divergence of a vector (a scalar), or of a symmetric tensor (a vector)."""
        if s.rank == 1:
            return [self._ask(f"div_{s.name}", [(s.component(a), gr.central(self.dim, a, self.dx)) for a in range(self.dim)])]
        return [self._ask(f"div{i}_{s.name}", [(s.component(i, a), gr.central(self.dim, a, self.dx)) for a in range(self.dim)]) for i in range(self.dim)]

    def _gradient_part(self, s: Sector, sign: int, prefix: str) -> list[str]:
        found = gr.velocity_gradient(s.columns, self.dx, sign)
        return [self._ask(f"{prefix}{name[1:]}_{s.name}", parts) for name, parts in found.items()]

    def strain_rate(self, s: Sector) -> list[str]:
        return self._gradient_part(s, 1, "strain")

    def vorticity(self, s: Sector) -> list[str]:
        return self._gradient_part(s, -1, "vort")

    def evaluate(self, df: DataFrame) -> DataFrame:
        """All that was asked for, over one neighbourhood."""
        return gr.apply(df, self.asked, self.shape, self.edge)

    def advection_by(self, df: DataFrame, s: Sector, by: Sector) -> DataFrame:
        return gr.advection(df, s.component(), by.columns, self.shape, self.dx, self.edge)

    def lap_of_grad_sq(self, df: DataFrame, s: Sector) -> DataFrame:
        return gr.laplacian_of_gradient_squared(df, s.component(), self.shape, self.dx, self.edge)


def degrade_spatial(
    df: DataFrame, fields: Sequence[str], shape: Sequence[int], blur: int = 0, factor: int = 1, noise: float = 0.0, loss: float = 0.0, seed: int = 0, edge: str = "pbc"
) -> DataFrame:
    """A field as a poorer camera sees it: box blur, then blocks, then noise, then an exact share of lost sites; reruns agree."""
    if blur:
        df = gr.box_blur(df, fields, blur, shape, edge)
    if factor > 1:
        df = gr.block_downscale(df, fields, factor, shape)
    site = ["time_idx", *[f"c{a}" for a in range(len(shape))]]
    if noise:
        df = df.withColumns({f: F.col(f) + standard_normal(seed, F.lit(str(i)), "dataset_id", *site) * noise for i, f in enumerate(fields)})
    return data_loss(df, loss, seed, site) if loss else df
