"""Repeated runs of whole texts, found from winnowed seeds without moving texts.

Shared by the substring operators. The texts are scanned three times and never
shuffled on the way; what is shuffled are anchors that occur at least twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm.common import column, digest, drop, sliced, table
from driftfield.llm.seeds import U64, Anchors, Shape, mix, parts

#: Bits of a screen, as a power of 2: at least, and at most (128 MB).
SCREEN_BITS = (20, 30)
#: Up to this many hashes go out as a screen of at most a sixteenth of its bits; more are joined by shuffle instead.
SCREENED = 1 << 25


class Screen:
    """A bitmap of hashes, two bits each. What it holds always passes; of other hashes one in some hundreds does.

    Bits come from the hash's low end and its middle: anchors are minima, so their
    high bits are mostly 0.
    """

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        passed = np.ones(len(hashes), bool)
        for shift in (1, 25):
            bit = (hashes >> U64(shift)) & U64((1 << self.bits) - 1)
            passed &= self.data[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1 == 1
        return passed


class Listed:
    """The hashes themselves, in place of a screen."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes, self.hashes)


def screen(hashes: DataFrame, count: int) -> Screen:
    """The bitmap of the column ``h`` of a written table of ``count`` rows. The driver gets its bytes, bounded by ``SCREEN_BITS``, not the hashes."""
    least, most = SCREEN_BITS
    bits = min(most, max(least, (32 * count).bit_length()))
    taken = [F.shiftright("h", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (1, 25)]
    rows = hashes.select(F.explode(F.array(*taken)).alias("bit"))
    segments = rows.groupBy(F.shiftright("bit", 15).alias("segment")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))).alias("map"))
    data = bytearray(1 << (bits - 3))
    for r in segments.toLocalIterator():
        data[r["segment"] << 12 : (r["segment"] + 1) << 12] = r["map"]
    return Screen(bits, bytes(data))


def by_text(docs: DataFrame) -> DataFrame:
    """(d1, d2, raw): texts as UTF-8 with their digest; null text is null."""
    d1, d2 = digest("text")
    return docs.select(F.col("text").cast("string").alias("text")).select(d1.alias("d1"), d2.alias("d2"), F.encode("text", "UTF-8").alias("raw"))


def by_order(docs: DataFrame) -> DataFrame:
    """(no_id, doc_id, d1, raw): the order of documents, and texts. Null ids come last (no_id 1); a digest orders documents that share an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    no_id = F.col("doc_id").isNull().cast("long").alias("no_id")
    return rows.select(no_id, F.coalesce("doc_id", F.lit(0)).alias("doc_id"), digest("text")[0].alias("d1"), F.encode("text", "UTF-8").alias("raw"))


def keys_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("raw", "wanted")]


def scan(rows: DataFrame, shape: Shape, found: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Run ``found`` over the anchors of whole texts; it gets each document's keys by column, and what the column ``wanted`` lists, if there is one."""
    keys = keys_of(rows)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            own = {k: np.asarray(column(batch, k).to_numpy(zero_copy_only=False)) for k in keys}
            wanted = Listed(column(batch, "wanted").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) if "wanted" in batch.schema.names else None
            texts = [x.as_py() for x in column(batch, "raw")]
            for part in parts(shape, texts):
                out = found(Anchors(shape, part), own, wanted)
                if len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[c].view(np.int64) if out[c].dtype == U64 else out[c]) for c in names], names)

    return rows.mapInArrow(run, schema)


def places(a: Anchors, own: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """The keys of documents and the places in them, for places of a part."""
    doc = a.part.doc[at]
    return {k: own[k][doc] for k in own} | {"at": at + a.part.shift[at]}


def placed(rows: DataFrame) -> str:
    return "".join(f", {k} long" for k in [*keys_of(rows), "at"])


def place_hash(p: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """One hash for an anchor at a place."""
    x = h.view(U64)
    for k in sorted(p):
        x = mix(x ^ mix(p[k].astype(np.int64).view(U64)))
    return x


def count_anchors(rows: DataFrame, shape: Shape) -> DataFrame:
    """(h) of the anchors that occur at least twice, counted over all documents."""

    def found(a: Anchors, own: dict[str, np.ndarray], _: Listed | None) -> dict[str, np.ndarray]:
        h, n = np.unique(a.h, return_counts=True)
        return {"h": h, "n": n.astype(np.int64)}

    return scan(rows, shape, found, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def occurrences(rows: DataFrame, shape: Shape) -> DataFrame:
    """(h, x, place) of the anchors that occur at least twice; x is a hash of what surrounds one."""
    twice = table(count_anchors(rows, shape), "anchors-twice")
    count = twice.count()
    sieve = rows.sparkSession.sparkContext.broadcast(screen(twice, count)) if count <= SCREENED else None

    def found(a: Anchors, own: dict[str, np.ndarray], _: Listed | None) -> dict[str, np.ndarray]:
        if sieve is not None:
            passed = sieve.value(a.h)
            a.at, a.h = a.at[passed], a.h[passed]
        return {"h": a.h, "x": a.context()} | places(a, own, a.at)

    all_found = scan(rows, shape, found, f"h long, x long{placed(rows)}")
    out = table(all_found if sieve is not None else all_found.join(twice, "h", "left_semi"), "anchor-places")
    drop(twice)
    return out


def contexts(found: DataFrame) -> DataFrame:
    """(h, x, n, first): each anchor in each surrounding, how often and where first."""
    place = [c for c in found.columns if c not in ("h", "x")]
    return table(found.groupBy("h", "x").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")), "contexts")


def kinds(each: DataFrame) -> DataFrame:
    """(h, first, kinds) of the anchors that stand in several surroundings, and in how many."""
    several = each.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return table(each.select("h", "first").join(several, "h"), "several")


def choose(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Callable[[Listed | None], Callable[[np.ndarray], np.ndarray]]]:
    """``rows`` to scan again, and how ``found`` gets what tells the places of ``chosen`` (h, first) by their hashes.

    Up to ``SCREENED`` places go out as a screen; what slips through it are true
    runs at true places. More are listed beside the texts that they stand in.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: np.asarray(column(batch, k).to_numpy()) for k in batch.schema.names}
            h = cols.pop("h")
            out = [column(batch, k) for k in keys]
            yield pa.RecordBatch.from_arrays([*out, pa.array(place_hash(cols, h).view(np.int64))], [*keys, "h"])

    keys = keys_of(rows)
    hashed = table(chosen.select("h", "first.*").mapInArrow(hashes, "".join(f"{k} long, " for k in keys) + "h long"), "chosen-places")
    count = hashed.count()
    if count > SCREENED:
        listed = hashed.groupBy(*keys).agg(F.collect_list("h").alias("wanted"))  # no more than a text has anchors
        return rows.join(listed, keys), lambda wanted: wanted
    sieve = rows.sparkSession.sparkContext.broadcast(screen(hashed, count))
    drop(hashed)
    return rows, lambda _: sieve.value


def ambiguous(rows: DataFrame, shape: Shape, chosen: DataFrame) -> DataFrame:
    """(w1, w2, place): the runs anchored at the places of ``chosen`` (h, first), by two hashes. ``at`` is the run's start.

    One place stands for each surrounding; those places are picked in another scan.
    """
    rows, sieve = choose(rows, chosen)

    def found(a: Anchors, own: dict[str, np.ndarray], listed: Listed | None) -> dict[str, np.ndarray]:
        wanted = np.flatnonzero(sieve(listed)(place_hash(places(a, own, a.at), a.h)))
        _, starts, w1, w2 = a.runs(wanted)
        return {"w1": w1, "w2": w2} | places(a, own, starts)

    return scan(rows, shape, found, f"w1 long, w2 long{placed(rows)}")


def surroundings(rows: DataFrame, shape: Shape, chosen: DataFrame) -> DataFrame:
    """(h, place, anchor, around): the bytes that runs through the anchors at the places of ``chosen`` see.

    ``at`` is where they start, ``anchor`` the anchor's place in them.
    """
    rows, sieve = choose(rows, chosen)

    def found(a: Anchors, own: dict[str, np.ndarray], listed: Listed | None) -> dict[str, np.ndarray]:
        wanted = sieve(listed)(place_hash(places(a, own, a.at), a.h))
        at = a.at[wanted]
        low = np.maximum(a.part.low[at], at - shape.reach + 1)
        high = np.minimum(a.part.high[at], at + shape.length)
        around = np.empty(len(at), object)
        around[:] = [a.part.values[i:j].tobytes() for i, j in zip(low, high, strict=True)]
        return {"h": a.h[wanted]} | places(a, own, at) | {"at": low + a.part.shift[at], "anchor": at - low, "around": around}

    return scan(rows, shape, found, f"h long{placed(rows)}, anchor long, around binary")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, starts, ends): overlapping or touching spans (s, e) of a document merged, so that no more than those are gathered."""
    order = Window.partitionBy(*keys).orderBy("s")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, "s", "e", F.when(before.isNull() | (F.col("s") > before), F.lit(1)).otherwise(F.lit(0)).alias("new"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy(*keys).agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
