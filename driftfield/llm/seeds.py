"""Seeds of repeated runs: winnowed anchors over a sequence of units (words or bytes).

A run of ``length`` units holds length - gram + 1 grams of ``gram`` units; the
smallest of their hashes is the run's anchor. Equal runs have equal anchors, so a
run can repeat only if its anchor does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
#: Fixed odd multipliers: of the two polynomial hashes, and of the mixing function.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ x >> U64(30)) * MIX[0]
    x = (x ^ x >> U64(27)) * MIX[1]
    return x ^ x >> U64(31)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    if base not in _tables or len(_tables[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, U64)
            p[0] = 1
            out.append(np.cumprod(p))
        _tables[base] = (out[0], out[1])
    p, q = _tables[base]
    return p[:n], q[:n]


class Rolling:
    """Hashes of any ranges of a sequence, from running sums."""

    def __init__(self, values: np.ndarray, base: int):
        powers, self.back = _powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


#: Stands for a byte in hashes.
BYTES = mix(np.arange(1, 257, dtype=U64) * U64(BASES[0]))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes: runs of anything but 32 and 9 to 13."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_values(raw: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A hash for each word of a text, read in pieces that end at white space where there is some."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        data = np.frombuffer(raw, np.uint8, end - at, at)
        starts, ends = word_spans(data)
        out.append(Rolling(BYTES[data], BASES[1])(starts, ends) + (ends - starts).astype(U64))
        at = end
    return mix(np.concatenate(out)) if out else np.zeros(0, U64)


def byte_values(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


@dataclass(frozen=True)
class Shape:
    """What is looked for: runs of ``length`` units, anchored by grams of ``gram``; ``words`` or else bytes."""

    length: int
    gram: int
    words: bool

    @property
    def reach(self) -> int:
        """Grams in a run."""
        return self.length - self.gram + 1

    def values(self, raw: bytes) -> np.ndarray:
        return word_values(raw) if self.words else byte_values(raw)

    def units(self, values: np.ndarray) -> np.ndarray:
        return values if self.words else BYTES[values]


@dataclass
class Part:
    """Some documents side by side, or a piece of one: units (hashed, and as they are), and for each the bounds of its document.

    ``doc`` counts documents of the batch, ``shift`` is added to a unit's place
    to get the place in its document, ``core`` bounds the places this part answers for.
    """

    units: np.ndarray
    values: np.ndarray
    doc: np.ndarray
    shift: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: tuple[int, int]


def parts(shape: Shape, texts: Sequence[bytes | None], size: int = 1 << 16) -> Iterator[Part]:
    """Cut a batch of texts to parts of about ``size`` units. A long text comes in pieces that overlap by a run on both sides."""
    group: list[tuple[int, np.ndarray]] = []
    held = 0

    def side_by_side() -> Part:
        lengths = np.array([len(v) for _, v in group])
        ends = np.cumsum(lengths)
        low, high = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
        doc = np.repeat(np.array([i for i, _ in group], np.int64), lengths)
        values = np.concatenate([v for _, v in group])
        return Part(shape.units(values), values, doc, -low, low, high, (0, int(ends[-1])))

    for i, raw in enumerate(texts):
        values = shape.values(raw) if raw else ()
        if len(values) < shape.length:
            continue
        if len(values) > size:
            for at in range(0, len(values), size):
                a, b = max(0, at - shape.length), min(len(values), at + size + shape.length)
                n = b - a
                every = lambda x, n=n: np.full(n, x, np.int64)
                yield Part(shape.units(values[a:b]), values[a:b], every(i), every(a), every(0), every(n), (at - a, min(b, at + size) - a))
            continue
        group.append((i, values))
        held += len(values)
        if held >= size:
            yield side_by_side()
            group, held = [], 0
    if group:
        yield side_by_side()


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each run of ``width`` values, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = best(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return best(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """The anchors of a part: ``at`` (place in the part), ``h`` (hash of the gram there)."""

    def __init__(self, shape: Shape, part: Part):
        self.shape, self.part = shape, part
        n, t = len(part.units), shape.reach
        self.rolling = Rolling(part.units, BASES[0])
        places = np.arange(n - shape.gram + 1)
        grams = self.rolling(places, places + shape.gram) | U64(1)  # never 0
        least = _sliding(grams, t, np.minimum)  # one for each run; those that cross documents count for nothing
        self.inside = places[: len(least)] + shape.length <= part.high[: len(least)]
        kept = np.where(self.inside, least, U64(0))
        most = _sliding(np.concatenate([np.zeros(t - 1, U64), kept, np.zeros(t - 1, U64)]), t, np.maximum)
        self.least = least
        self.at = np.flatnonzero(most == grams)
        self.at = self.at[(self.at >= part.core[0]) & (self.at < part.core[1])]
        self.grams, self.h = grams, grams[self.at]

    def context(self) -> np.ndarray:
        """A hash of all that the runs through each anchor see, with where the document cuts it off."""
        low = np.maximum(self.part.low[self.at], self.at - self.shape.reach + 1)
        high = np.minimum(self.part.high[self.at], self.at + self.shape.length)
        other = Rolling(self.part.units, BASES[1])
        cut = (self.at - low).astype(U64) * U64(1 << 20) + (high - self.at).astype(U64)
        return mix(other(low, high) ^ mix(cut))

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs whose anchor is one of ``chosen`` (indices into ``at``): (index, start, two hashes)."""
        t = self.shape.reach
        at = self.at[chosen]
        starts = at[:, None] + np.arange(1 - t, 1)[None, :]
        ok = (starts >= 0) & (starts < len(self.least))
        safe = np.where(ok, starts, 0)
        ok &= self.inside[safe] & (self.part.doc[safe] == self.part.doc[at][:, None]) & (self.least[safe] == self.h[chosen][:, None])
        index = np.broadcast_to(chosen[:, None], ok.shape)[ok]
        starts = starts[ok]
        ends = starts + self.shape.length
        return index, starts, self.rolling(starts, ends), Rolling(self.part.units, BASES[1])(starts, ends)
