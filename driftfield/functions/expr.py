"""Scalar expressions over state columns: built once, compiled to Columns or NumPy, differentiated by rule."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Union

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Union[int, float]
#: Derivative of each named function, given its argument.
RULES = {
    "sin": lambda a: call("cos", a),
    "cos": lambda a: -call("sin", a),
    "exp": lambda a: call("exp", a),
    "log": lambda a: a**-1,
    "tanh": lambda a: 1 - call("tanh", a) ** 2,
    "sqrt": lambda a: 0.5 * call("sqrt", a) ** -1,
    "abs": lambda a: call("signum", a),
    "signum": lambda a: Const(0.0),
    "rint": lambda a: Const(0.0),
}
NUMPY = {"signum": np.sign}


class Expr:
    """A scalar expression. Arithmetic folds constants, so zero terms vanish from derivatives."""

    def __add__(self, other: Expr | Number) -> Expr:
        return add(self, as_expr(other))

    __radd__ = __add__

    def __neg__(self) -> Expr:
        return mul(Const(-1.0), self)

    def __sub__(self, other: Expr | Number) -> Expr:
        return add(self, -as_expr(other))

    def __rsub__(self, other: Expr | Number) -> Expr:
        return add(as_expr(other), -self)

    def __mul__(self, other: Expr | Number) -> Expr:
        return mul(self, as_expr(other))

    __rmul__ = __mul__

    def __truediv__(self, other: Expr | Number) -> Expr:
        return mul(self, as_expr(other) ** -1)

    def __rtruediv__(self, other: Expr | Number) -> Expr:
        return mul(as_expr(other), self**-1)

    def __pow__(self, power: int) -> Expr:
        return power_of(self, power)

    def column(self, names: Mapping[str, Column] | None = None) -> Column:
        raise NotImplementedError

    def numpy(self, env: Mapping[str, np.ndarray]):
        raise NotImplementedError

    def diff(self, name: str) -> Expr:
        raise NotImplementedError

    def variables(self) -> set[str]:
        return set()

    def bind(self, values: Mapping[str, Expr | Number]) -> Expr:
        """Put expressions or numbers in the place of variables."""
        return self


@dataclass(frozen=True)
class Const(Expr):
    value: float

    def column(self, names=None):
        return F.lit(float(self.value))

    def numpy(self, env):
        return self.value

    def diff(self, name):
        return Const(0.0)

    def __str__(self):
        return f"{self.value:g}"


@dataclass(frozen=True)
class Var(Expr):
    name: str

    def column(self, names=None):
        return (names or {}).get(self.name, F.col(self.name))

    def numpy(self, env):
        return env[self.name]

    def diff(self, name):
        return Const(float(name == self.name))

    def variables(self):
        return {self.name}

    def bind(self, values):
        return as_expr(values.get(self.name, self))

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Sum(Expr):
    a: Expr
    b: Expr

    def column(self, names=None):
        return self.a.column(names) + self.b.column(names)

    def numpy(self, env):
        return self.a.numpy(env) + self.b.numpy(env)

    def diff(self, name):
        return self.a.diff(name) + self.b.diff(name)

    def variables(self):
        return self.a.variables() | self.b.variables()

    def bind(self, values):
        return self.a.bind(values) + self.b.bind(values)

    def __str__(self):
        return f"({self.a} + {self.b})"


@dataclass(frozen=True)
class Product(Expr):
    a: Expr
    b: Expr

    def column(self, names=None):
        return self.a.column(names) * self.b.column(names)

    def numpy(self, env):
        return self.a.numpy(env) * self.b.numpy(env)

    def diff(self, name):
        return self.a.diff(name) * self.b + self.a * self.b.diff(name)

    def variables(self):
        return self.a.variables() | self.b.variables()

    def bind(self, values):
        return self.a.bind(values) * self.b.bind(values)

    def __str__(self):
        return f"{self.a} {self.b}"


@dataclass(frozen=True)
class Power(Expr):
    """An integer power, as repeated products: exact for negative bases, and 0 ** 0 never arises in a derivative."""

    a: Expr
    n: int

    def column(self, names=None):
        base = self.a.column(names)
        out = base
        for _ in range(abs(self.n) - 1):
            out = out * base
        return out if self.n > 0 else F.when(out != 0, F.lit(1.0) / out)

    def numpy(self, env):
        return np.float64(1.0) * self.a.numpy(env) ** float(self.n) if self.n < 0 else self.a.numpy(env) ** self.n

    def diff(self, name):
        return self.n * power_of(self.a, self.n - 1) * self.a.diff(name)

    def variables(self):
        return self.a.variables()

    def bind(self, values):
        return self.a.bind(values) ** self.n

    def __str__(self):
        return f"{self.a}^{self.n}"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    a: Expr

    def column(self, names=None):
        return getattr(F, self.name)(self.a.column(names))

    def numpy(self, env):
        return NUMPY.get(self.name, getattr(np, self.name, None))(self.a.numpy(env))

    def diff(self, name):
        return RULES[self.name](self.a) * self.a.diff(name)

    def variables(self):
        return self.a.variables()

    def bind(self, values):
        return call(self.name, self.a.bind(values))

    def __str__(self):
        return f"{self.name}({self.a})"


@dataclass(frozen=True)
class Where(Expr):
    """``a`` where ``test`` is above 0, else ``b``. Not differentiated through the test."""

    test: Expr
    a: Expr
    b: Expr

    def column(self, names=None):
        return F.when(self.test.column(names) > 0, self.a.column(names)).otherwise(self.b.column(names))

    def numpy(self, env):
        return np.where(self.test.numpy(env) > 0, self.a.numpy(env), self.b.numpy(env))

    def diff(self, name):
        return Where(self.test, self.a.diff(name), self.b.diff(name))

    def variables(self):
        return self.test.variables() | self.a.variables() | self.b.variables()

    def bind(self, values):
        test, a, b = (x.bind(values) for x in (self.test, self.a, self.b))
        if isinstance(test, Const):
            return a if test.value > 0 else b
        return Where(test, a, b)

    def __str__(self):
        return f"where({self.test} > 0, {self.a}, {self.b})"


def as_expr(x: Expr | Number) -> Expr:
    return x if isinstance(x, Expr) else Const(float(x))


def is_zero(x: Expr | Number) -> bool:
    """Whether an expression is the constant 0."""
    x = as_expr(x)
    return isinstance(x, Const) and x.value == 0


def add(a: Expr, b: Expr) -> Expr:
    if isinstance(a, Const) and isinstance(b, Const):
        return Const(a.value + b.value)
    if isinstance(a, Const) and a.value == 0:
        return b
    if isinstance(b, Const) and b.value == 0:
        return a
    return Sum(a, b)


def mul(a: Expr, b: Expr) -> Expr:
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Const):
            if isinstance(y, Const):
                return Const(x.value * y.value)
            if x.value == 0:
                return Const(0.0)
            if x.value == 1:
                return y
    return Product(b, a) if isinstance(b, Const) else Product(a, b)


def power_of(a: Expr, n: int) -> Expr:
    if n != int(n):
        raise TypeError("powers are integers; use sqrt, or exp of log")
    if n == 0:
        return Const(1.0)
    if n == 1:
        return a
    return Const(a.value ** int(n)) if isinstance(a, Const) else Power(a, int(n))


def call(name: str, a: Expr | Number) -> Expr:
    if name not in RULES:
        raise ValueError(f"{name} is not one of {', '.join(RULES)}")
    a = as_expr(a)
    return Const(float(NUMPY.get(name, getattr(np, name, None))(a.value))) if isinstance(a, Const) else Call(name, a)


def sin(a):
    return call("sin", a)


def cos(a):
    return call("cos", a)


def exp(a):
    return call("exp", a)


def log(a):
    return call("log", a)


def tanh(a):
    return call("tanh", a)


def sqrt(a):
    return call("sqrt", a)


def rint(a):
    return call("rint", a)
