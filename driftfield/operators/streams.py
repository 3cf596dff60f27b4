"""Time-local streams: gap-aware shifts of state along each particle's frames, and the masks that go with them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.sources.tables import KEYS, state_columns

#: Streams by name, as the frames (relative to the row's) that each reads.
OFFSETS = {
    "X": (0, 0), "X_minus": (-1, -1), "X_plus": (1, 1), "X_minusminus": (-2, -2), "X_plusplus": (2, 2),
    "dX": (0, 1), "dX_minus": (-1, 0), "dX_plus": (1, 2), "dt": (0, 1), "dt_minus": (-1, 0), "dt_plus": (1, 2),
}
#: What an integral always needs: the row's own time step.
STEP = (0, 1)


def window(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("time_idx")


def shifted(name: str, k: int, keys: Sequence[str] = KEYS) -> Column:
    """The value ``k`` frames on (or back). Null where that frame has no row.

    Rows of missing frames don't exist, so the frame wanted is one of the next k rows.
    """
    if not k:
        return F.col(name)
    move, sign, w = (F.lead, 1, window(keys)) if k > 0 else (F.lag, -1, window(keys))
    return F.coalesce(*[F.when(move("time_idx", j).over(w) == F.col("time_idx") + k, move(name, j).over(w)) for j in range(abs(k), 0, -1)])


def with_streams(df: DataFrame, reach: Iterable[int] = (-1, 1), names: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the state and time at the frames of ``reach``: x0_m1, x0_p1, t_p1 and so on, all from one window."""
    names = list(names or state_columns(df)) + ["t"]
    cols = {f"{c}_{'p' if k > 0 else 'm'}{abs(k)}": shifted(c, k, keys) for k in reach if k for c in names}
    return df.withColumns(cols)


def at(name: str, k: int) -> Column:
    return F.col(name if not k else f"{name}_{'p' if k > 0 else 'm'}{abs(k)}")


def difference(name: str, k: int) -> Column:
    """From frame k to k + 1."""
    return at(name, k + 1) - at(name, k)


def mask(needs: Iterable[str], integral: bool = True) -> Column:
    """Whether a row has what the streams need. Of each stream only the ends count; an integral also needs the row's step."""
    ends = {k for n in needs for k in OFFSETS[n] if k} | ({STEP[1]} if integral else set())
    ok = F.lit(True)
    for k in sorted(ends):
        ok = ok & at("t", k).isNotNull()
    return ok


def fd_velocity(df: DataFrame, mode: str = "central") -> DataFrame:
    """Velocities v0.. by finite differences: central (one-sided at ends), forward or backward."""
    out = with_streams(df, (-1, 1))
    for c in state_columns(df):
        forward = difference(c, 0) / difference("t", 0)
        backward = difference(c, -1) / difference("t", -1)
        central = (at(c, 1) - at(c, -1)) / (at("t", 1) - at("t", -1))
        chosen = {"central": F.coalesce(central, forward, backward), "forward": forward, "backward": backward}[mode]
        out = out.withColumn("v" + c[1:], chosen)
    return out.select(*df.columns, *["v" + c[1:] for c in state_columns(df)])


def sliding(df: DataFrame, width: int, name: str = "x0") -> DataFrame:
    """X_window: the values of the ``width`` frames around each row, where every one of them is there."""
    back, on = (width - 1) // 2, width // 2
    w = window().rowsBetween(-back, on)
    full = (F.count("*").over(w) == width) & (F.max("time_idx").over(w) - F.min("time_idx").over(w) == width - 1)
    return df.withColumn("window", F.when(full, F.collect_list(name).over(w)))


def timeop(*needs: str) -> Callable:
    """Mark a function of no arguments that returns a Column of streams, with the streams it needs."""

    def wrap(function: Callable[[], Column]) -> Callable[[], Column]:
        function.needs = needs
        return function

    return wrap


def with_halo(df: DataFrame, block: int, reach: int = 2) -> DataFrame:
    """Cut long tracks to blocks of ``block`` frames for parallel windows.

    The ``reach`` frames on both sides of a block are given to it as well, with
    halo = true; windows keyed by (dataset_id, particle_id, block) are right for
    the rows that are not halo.
    """
    own = F.floor(F.col("time_idx") / block)
    near = F.array_distinct(F.array(own, F.floor((F.col("time_idx") - reach) / block), F.floor((F.col("time_idx") + reach) / block)))
    return df.withColumn("block", F.explode(F.filter(near, lambda b: b >= 0))).withColumn("halo", F.col("block") != own)
