"""Dictionaries of features: algebra over tensors of expressions, and the standard families."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column

from driftfield.functions.expr import Const, Expr, Number, Var, Where, as_expr, call, cos, sin, sqrt


def states(dim: int) -> list[Var]:
    return [Var(f"x{i}") for i in range(dim)]


def velocities(dim: int) -> list[Var]:
    return [Var(f"v{i}") for i in range(dim)]


class Basis:
    """Features of one rank over a space of ``dim`` dimensions.

    ``values`` is an object array of expressions of shape (feature, dim, ...): one
    axis of length dim per rank. Products of two dictionaries pair every feature
    of the left with every one of the right, the left leading.
    """

    def __init__(self, values: Sequence | np.ndarray, dim: int, labels: Sequence[str] | None = None):
        self.values = np.array(values, object)
        self.dim = dim
        if any(n != dim for n in self.values.shape[1:]):
            raise ValueError(f"each spatial axis must have length {dim}, not {self.values.shape[1:]}")
        self.labels = list(labels) if labels else [f"f{i}" for i in range(len(self.values))]

    @property
    def rank(self) -> int:
        return self.values.ndim - 1

    @property
    def n_features(self) -> int:
        return len(self.values)

    def _like(self, values, labels=None) -> Basis:
        return Basis(values, self.dim, labels)

    def _other(self, other: Basis | Expr | Number) -> Basis:
        if isinstance(other, Basis):
            return other
        return Basis([as_expr(other)], self.dim, ["c"])

    def __and__(self, other: Basis) -> Basis:
        if self.rank != other.rank:
            raise ValueError("features of one dictionary have one rank")
        return self._like(np.concatenate([self.values, other.values]), self.labels + other.labels)

    def __add__(self, other: Basis | Number) -> Basis:
        if not isinstance(other, Basis):
            return self._like(self.values + as_expr(other), self.labels)
        if self.values.shape != other.values.shape:
            raise ValueError("sums need equal ranks and numbers of features")
        return self._like(self.values + other.values, self.labels)

    def __sub__(self, other: Basis | Number) -> Basis:
        return self + (-other)

    def __neg__(self) -> Basis:
        return self._like(-1.0 * self.values, self.labels)

    def __mul__(self, other: Basis | Expr | Number) -> Basis:
        if isinstance(other, (int, float)):
            return self._like(self.values * other, self.labels)
        other = self._other(other)
        if self.rank and other.rank and self.rank != other.rank:
            raise ValueError("a product needs a scalar side or equal ranks")
        rank = max(self.rank, other.rank)
        a = self.values.reshape(self.values.shape + (1,) * (rank - self.rank))
        b = other.values.reshape(other.values.shape + (1,) * (rank - other.rank))
        return self._like([p * q for p in a for q in b], [f"{p}*{q}" for p in self.labels for q in other.labels])

    __rmul__ = __mul__

    def __truediv__(self, other: Basis | Expr | Number) -> Basis:
        if isinstance(other, (int, float)):
            return self * (1 / other)
        return self * self._other(other) ** -1

    def __pow__(self, n: int) -> Basis:
        return self._like(np.vectorize(lambda e: as_expr(e) ** n, otypes=[object])(self.values), self.labels)

    def __getitem__(self, index) -> Basis:
        index = [index] if isinstance(index, int) else index
        return self._like(self.values[index], list(np.array(self.labels, object)[index]))

    def einsum(self, spec: str, other: Basis) -> Basis:
        """Contract spatial axes, as ``numpy.einsum`` does; features multiply out."""
        left, right, out = spec.replace("->", ",").split(",")
        pairs = [np.einsum(f"{left},{right}->{out}", p, q) for p in self.values for q in other.values]
        return self._like(pairs, [f"{p}.{q}" for p in self.labels for q in other.labels])

    def dot(self, other: Basis) -> Basis:
        a = "abcd"[: self.rank]
        b = a[-1] + "efgh"[: other.rank - 1]
        return self.einsum(f"{a},{b}->{a[:-1]}{b[1:]}", other)

    __matmul__ = dot

    def d_x(self) -> Basis:
        """The Jacobian; the derivative's axis comes before the others."""
        return self._gradient("x")

    def d_v(self) -> Basis:
        return self._gradient("v")

    def _gradient(self, letter: str) -> Basis:
        each = np.vectorize(lambda e, n: as_expr(e).diff(n), otypes=[object])
        return self._like(np.stack([each(self.values, f"{letter}{i}") for i in range(self.dim)], axis=1), self.labels)

    def vectorize(self) -> Basis:
        """Each scalar feature along each axis."""
        return unit_vectors(self.dim)._swap(self)

    def tensorize(self, symmetric: bool = True) -> Basis:
        """Each scalar feature times each basis matrix (symmetric ones, or the identity)."""
        return (symmetric_matrices(self.dim) if symmetric else identity_matrix(self.dim))._swap(self)

    def _swap(self, scalar: Basis) -> Basis:
        if scalar.rank:
            raise ValueError("only scalar features are lifted")
        return scalar * self

    def rank_to_features(self) -> Basis:
        """Every component as a scalar feature."""
        flat = self.values.reshape(-1)
        each = int(np.prod(self.values.shape[1:], dtype=int))
        return self._like(flat, [f"{name}[{i}]" for name in self.labels for i in range(each)])

    def features_to_rank(self, rank: int = 1) -> Basis:
        """Scalar features, dim ** rank at a time, as components."""
        if self.rank or self.n_features % self.dim**rank:
            raise ValueError("needs scalar features in a multiple of dim ** rank")
        return self._like(self.values.reshape(-1, *[self.dim] * rank))

    def map(self, name: str) -> Basis:
        """A named function of every component."""
        return self._like(np.vectorize(lambda e: call(name, e), otypes=[object])(self.values), [f"{name}({x})" for x in self.labels])

    def dense(self, weights: np.ndarray, bias: np.ndarray | None = None) -> Basis:
        """An affine map of the features: weights of shape (out, feature)."""
        out = []
        for i, row in enumerate(np.asarray(weights, float)):
            total = sum((float(w) * f for w, f in zip(row, self.values, strict=True)), start=np.full(self.values.shape[1:], Const(0.0), object))
            out.append(total + float(bias[i]) if bias is not None else total)
        return self._like(np.array(out, object))

    def bind(self, **values: Expr | Number) -> Basis:
        return self._like(np.vectorize(lambda e: as_expr(e).bind(values), otypes=[object])(self.values), self.labels)

    def specialize(self, dataset: int) -> Basis:
        """The features in one dataset: its number is put in, and choices by it are settled."""
        return self.bind(dataset_id=float(dataset))

    def combine(self, coefficients: Sequence[float]) -> np.ndarray:
        """The field of the coefficients: one expression per component."""
        return self.dense(np.asarray([coefficients])).values[0]

    def sqrtm(self) -> Basis:
        """Square roots of symmetric 1 x 1 or 2 x 2 features, in closed form."""
        if self.rank != 2 or self.dim > 2:
            raise ValueError("closed form for rank 2 in one or two dimensions only")
        if self.dim == 1:
            return self.map("sqrt")
        out = []
        for m in self.values:
            root = sqrt(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0])
            scale = sqrt(m[0, 0] + m[1, 1] + 2.0 * root) ** -1
            out.append([[(m[0, 0] + root) * scale, m[0, 1] * scale], [m[1, 0] * scale, (m[1, 1] + root) * scale]])
        return self._like(out, self.labels)

    def columns(self, names: dict[str, Column] | None = None) -> np.ndarray:
        return np.vectorize(lambda e: as_expr(e).column(names), otypes=[object])(self.values)

    def numpy(self, env: dict[str, np.ndarray]) -> np.ndarray:
        """Values of shape (row, feature, ...)."""
        rows = len(next(iter(env.values())))
        flat = [np.broadcast_to(np.asarray(as_expr(e).numpy(env), float), rows) for e in self.values.reshape(-1)]
        return np.stack(flat, axis=1).reshape(rows, *self.values.shape)


def _names(variables: Sequence[Var], powers: Sequence[int]) -> str:
    found = [v.name if n == 1 else f"{v.name}^{n}" for v, n in zip(variables, powers, strict=True) if n]
    return "*".join(found) or "1"


def monomials(dim: int, degrees: Sequence[int], use_x: bool = True, use_v: bool = False) -> Basis:
    variables = states(dim) * use_x + velocities(dim) * use_v
    values, labels = [], []
    for degree in degrees:
        for chosen in combinations_with_replacement(range(len(variables)), degree):
            powers = [chosen.count(i) for i in range(len(variables))]
            values.append(math.prod((v**n for v, n in zip(variables, powers, strict=True) if n), start=Const(1.0)))
            labels.append(_names(variables, powers))
    return Basis(values, dim, labels)


def monomials_degree(dim: int, order: int, rank: str = "scalar", **use: bool) -> Basis:
    return lifted(monomials(dim, [order], **use), rank)


def monomials_up_to(dim: int, order: int, rank: str = "scalar", **use: bool) -> Basis:
    return lifted(monomials(dim, range(order + 1), **use), rank)


def lifted(basis: Basis, rank: str) -> Basis:
    if rank == "scalar":
        return basis
    if rank == "vector":
        return basis.vectorize()
    if rank in ("symmetric", "identity"):
        return basis.tensorize(rank == "symmetric")
    raise ValueError(f"rank is scalar, vector, symmetric or identity, not {rank}")


def ones(dim: int) -> Basis:
    return Basis([Const(1.0)], dim, ["1"])


def constant_array(values: np.ndarray, dim: int) -> Basis:
    return Basis(np.vectorize(lambda v: Const(float(v)), otypes=[object])(np.asarray(values)), dim)


def unit_vectors(dim: int, axes: Sequence[int] | None = None) -> Basis:
    axes = range(dim) if axes is None else axes
    return Basis([[Const(float(i == a)) for i in range(dim)] for a in axes], dim, [f"e{a}" for a in axes])


def identity_matrix(dim: int) -> Basis:
    return constant_array(np.eye(dim)[None], dim)


def symmetric_matrices(dim: int) -> Basis:
    out, labels = [], []
    for i in range(dim):
        for j in range(i, dim):
            m = np.zeros((dim, dim))
            m[i, j] = m[j, i] = 1
            out.append(m)
            labels.append(f"S{i}{j}")
    basis = constant_array(np.array(out), dim)
    basis.labels = labels
    return basis


def linear(dim: int, with_v: bool = False) -> Basis:
    """Coordinates as scalar features."""
    names = states(dim) + velocities(dim) * with_v
    return Basis(names, dim, [v.name for v in names])


def position(dim: int) -> Basis:
    """The position as one vector feature."""
    return Basis([states(dim)], dim, ["X"])


def velocity(dim: int) -> Basis:
    return Basis([velocities(dim)], dim, ["V"])


def coordinate(dim: int, axis: int, of: str = "x") -> Basis:
    return Basis([Var(f"{of}{axis}")], dim, [f"{of}{axis}"])


def frame(dim: int, with_v: bool = False) -> Basis:
    """Position (and velocity) as vector features."""
    return position(dim) & velocity(dim) if with_v else position(dim)


def extra_scalar(dim: int, name: str) -> Basis:
    """The value of an extra column."""
    return Basis([Var(name)], dim, [name])


def named_scalars(dim: int, names: Sequence[str]) -> Basis:
    """Parameters by name, to be bound later."""
    return Basis([Var(n) for n in names], dim, names)


def time_fourier(dim: int, n: int, period: float | None = None) -> Basis:
    """1, cos and sin of the first ``n`` harmonics of time; without a period, of the dataset's ``duration``."""
    period_expr = Var("duration") if period is None else Const(float(period))
    phase = [2 * math.pi * k * Var("t") / period_expr for k in range(1, n + 1)]
    values = [Const(1.0), *[f(p) for p in phase for f in (cos, sin)]]
    return Basis(values, dim, ["1", *[f"{f}{k}" for k in range(1, n + 1) for f in ("cos", "sin")]])


def in_dataset(k: int) -> Expr:
    return Where(0.25 - (Var("dataset_id") - float(k)) ** 2, Const(1.0), Const(0.0))


def dataset_indicator(dim: int, n: int) -> Basis:
    """One feature per dataset: 1 in it, else 0."""
    return Basis([in_dataset(k) for k in range(n)], dim, [f"ds{k}" for k in range(n)])


def per_dataset_scalar(dim: int, name: str, n: int) -> Basis:
    """One feature that is a parameter of each dataset: ``name``0, ``name``1 and so on, to be bound or fitted."""
    return Basis([sum((in_dataset(k) * Var(f"{name}{k}") for k in range(n)), Const(0.0))], dim, [name])


def d_theta(field: Sequence[Expr], names: Sequence[str]) -> Basis:
    """Derivatives of a vector field in its parameters, a vector feature each."""
    return Basis([[as_expr(e).diff(n) for e in field] for n in names], len(field), [f"d_{n}" for n in names])


def from_function(dim: int, function: Callable[..., Sequence], with_v: bool = False, labels: Sequence[str] | None = None) -> Basis:
    """A user's function of symbolic coordinates, returning expressions of the features."""
    found = function(states(dim), velocities(dim)) if with_v else function(states(dim))
    return Basis(np.array(found, object), dim, labels)
