"""Row-wise estimators of diffusion, localisation noise and kinematics, as Columns over streams."""

from __future__ import annotations

from pyspark.sql import Column

from driftfield.operators.streams import at, difference

#: The streams each estimator needs: they set which rows count.
NEEDS = {
    "od_msd": ["dX"], "od_noisy": ["dX", "dX_minus"], "od_weak": ["dX", "dX_minus"], "od_lambda": ["dX", "dX_minus"],
    "ud_msd": ["dX", "dX_minus"], "ud_weak": ["dX", "dX_minus", "dX_plus"], "ud_noisy": ["dX", "dX_minus", "dX_plus"],
    "ud_lambda": ["dX", "dX_minus", "dX_plus"], "lag0": ["dX"], "lag1": ["dX", "dX_minus"], "lag2": ["dX_minus", "dX_plus"],
}


def _steps(i: int):
    return difference(f"x{i}", 0), difference(f"x{i}", -1), difference(f"x{i}", 1)


def step(k: int = 0) -> Column:
    return difference("t", k)


def tensor(name: str, i: int, j: int) -> Column:
    """Component (i, j) of an estimator."""
    u, m, p = _steps(i)
    U, M, P = _steps(j)
    sym = lambda a, B, A, b: (a * B + A * b) / 2  # noqa: E731  of a x b: a_i b_j and a_j b_i
    if name == "od_msd":
        return u * U / step() / 2
    if name == "od_noisy":
        return (u * U + 2 * u * M + 2 * m * U + m * M) / 4 / ((step() + step(-1)) / 2)
    if name == "od_weak":
        return (u - m) * (U - M) / 4 / ((step() + step(-1)) / 2)
    if name == "od_lambda":
        return -(u * M + m * U) / 2
    if name == "ud_msd":
        return (u - m) * (U - M) * 3 / 4 / (step() * step() * step())
    if name == "ud_weak":
        return (2 * u - m - p) * (2 * U - M - P) / 2 / (step() * step() * step())
    if name == "ud_noisy":
        d, dv, dw = step(), step(-1) - step(), step(1) - step()
        q = dv * dv + dw * dw - 3 * dv * dw
        mean = d + (dv + dw) / 3
        total = -(u * U) + m * M + p * P - 3 * sym(p, M, P, m) + sym(u, P, U, p) + sym(u, M, U, m)
        return (total - q * sym(p, M, P, m) / (step(-1) * step(1))) * 3 / 11 / (mean * mean * mean)
    if name == "ud_lambda":
        return (10 * u * U + m * M + p * P + 8 * sym(p, M, P, m) - 10 * sym(u, P, U, p) - 10 * sym(u, M, U, m)) / 44
    if name == "lag0":
        return u * U
    if name == "lag1":
        return sym(u, M, U, m)
    if name == "lag2":
        return sym(m, P, M, p)
    raise ValueError(f"no estimator {name}")


def ud_position(mode: str, i: int) -> Column:
    x = lambda k: at(f"x{i}", k)
    return {
        "symmetric": (x(-1) + x(0) + x(1)) / 3, "early": x(0), "anticipated": (x(0) + x(1) + x(2)) / 3,
        "noisy": (x(0) + x(-1) + x(1) + x(2)) / 4, "weak": (x(0) + x(1)) / 2,
    }[mode]


def ud_velocity(mode: str, i: int) -> Column:
    u, m, p = _steps(i)
    return {
        "symmetric": (u + m) / (2 * step()), "early": m / step(), "anticipated": m / step(), "noisy": (4 * u + p + m) / (6 * step()), "weak": u / step(),
    }[mode]


def ud_acceleration(mode: str, i: int) -> Column:
    u, m, p = _steps(i)
    return (p - u if mode == "anticipated" else u - m) / (step() * step())
