"""Suffix-array dedup: byte runs that start earlier in the corpus, by prefix-free parsing of what can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import column, drop, sliced, table
from driftfield.llm.prefix_free import earlier_runs
from driftfield.llm.repeats import by_order, contexts, islands, kinds, occurrences, screen, surroundings
from driftfield.llm.seeds import Shape
from driftfield.llm.substring_dedup import merged

#: Surroundings of one anchor that are parsed in one task. An anchor with more is split by longer cores until its parts are no larger.
GROUP = 4000
#: Bytes of surroundings parsed at once, whole anchors at a time.
PARSED = 1 << 19
DOC = ["no_id", "doc_id", "d1"]
PLACE = [*DOC, "at"]
SPAN = "no_id long, doc_id long, d1 long, s long, e long"


def numbered(rows: pa.Table) -> np.ndarray:
    """A number for each row's place such that places of one document differ as they stand, and documents by order.

    Documents are numbered in order, and their numbers are spread by more than
    the longest text seen here.
    """
    keys = [np.asarray(rows[k].to_numpy()) for k in DOC]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    doc = np.empty(len(order), np.int64)
    doc[order] = np.cumsum(new)
    at = np.asarray(rows["at"].to_numpy())
    span = int(at.max(initial=0)) + (1 << 20)
    return doc * span + at


def parsed(around: DataFrame, length: int) -> DataFrame:
    """Spans of runs that start earlier, from surroundings (h, place, around), those of an anchor together.

    Rows are dealt by anchor and sorted, so a task parses a megabyte at a time.
    """

    def solve(rows: pa.Table) -> pa.RecordBatch:
        texts = rows["around"].to_pylist()
        text, start = earlier_runs(texts, numbered(rows), length)
        at = np.asarray(rows["at"].to_numpy())[text] + start
        s, e = merged(text * (1 << 20) + start, text * (1 << 20) + start + length)
        which = s >> 20
        base = np.asarray(rows["at"].to_numpy())[which] if len(which) else at
        keys = [rows[k].combine_chunks().take(pa.array(which)) for k in DOC]
        return pa.RecordBatch.from_arrays([*keys, pa.array(base + (s - (which << 20))), pa.array(base + (e - (which << 20)))], [*DOC, "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.nbytes >= PARSED:
                h = np.asarray(held["h"].to_numpy())
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                if cut:
                    yield solve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return around.select("h", *PLACE, "around").repartition("h").sortWithinPartitions("h").mapInArrow(run, SPAN)


def divided(around: DataFrame, sieve) -> DataFrame:
    """``around`` with whether the anchor's hash is one that ``sieve`` (a broadcast screen) lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = sieve.value(np.asarray(column(batch, "h").to_numpy()).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed)], [*batch.schema.names, "crowded"])

    return around.mapInArrow(run, around.schema.simpleString()[7:-1] + ",crowded:boolean")


NODE = "k1 long, k2 long, x long, no_id long, doc_id long, d1 long, at long, low long, high long, anchor long, around binary"


#: Parts that a crowded node is split in.
PARTS = 4


def quarters(nodes: DataFrame, length: int) -> DataFrame:
    """Each node (k1, k2, place, low, high, anchor, around) split in ``PARTS``.

    A node stands for the runs that start ``low`` to ``high`` from an anchor. What
    all of them cover is its core, what any covers its surrounding. A part of the
    starts shares a longer core, which is the key (k1, k2) of the part; x tells
    surroundings. A part of which no run fits the document is left out.
    """
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            out: list[tuple] = []
            for r in batch.to_pylist():
                around, anchor, starts = r["around"], r["anchor"], r["high"] - r["low"] + 1
                cuts = [r["low"] + starts * i // PARTS for i in range(PARTS + 1)]
                for low, high in zip(cuts, (c - 1 for c in cuts[1:]), strict=False):
                    core = (anchor + high, anchor + low + length)
                    if low > high or core[0] < 0 or core[1] > len(around):
                        continue
                    begin, end = max(0, anchor + low), min(len(around), anchor + high + length)
                    key = xxhash.xxh3_128_intdigest(b"%d,%d,%d;" % (r["k1"], r["k2"], low) + around[core[0] : core[1]])
                    part = around[begin:end]
                    x = xxhash.xxh3_64_intdigest(part, (anchor - begin) & 0xFFFF)
                    signed = [v - (1 << 64) if v >> 63 else v for v in (key >> 64, key & (1 << 64) - 1, x)]
                    out.append((*signed, r["no_id"], r["doc_id"], r["d1"], r["at"] + begin, low, high, anchor - begin, part))
            if out:
                kinds_ = [pa.int64()] * (len(names) - 1) + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds_, strict=True)], names)

    return nodes.mapInArrow(run, NODE)


def crowded(around: DataFrame, length: int) -> list[DataFrame]:
    """Spans of runs that start earlier, from surroundings of anchors with very many.

    A crowded anchor is split by the core that a quarter of its runs have in
    common, and again, until at most ``GROUP`` different surroundings share a
    core; those are parsed. Of equal surroundings of a core all but the first
    repeat as a whole and go no further. Each step quarters the starts, so it ends
    after a few steps at cores as long as a run, which have one surrounding.
    """
    spans, place = [], F.struct(*PLACE)
    nodes = around.select(F.col("h").alias("k1"), F.lit(0).cast("long").alias("k2"), *PLACE, "low", "high", "anchor", "around")
    while True:
        split = table(quarters(nodes, length), "quarters")
        rest = F.struct("low", "high", "anchor", "around")
        each = table(split.groupBy("k1", "k2", "x").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min_by(rest, place).alias("rest")), "quarters-each")
        late = split.select("k1", "k2", "x", *PLACE, F.octet_length("around").alias("size")).join(each.where("n > 1").select("k1", "k2", "x", "first"), ["k1", "k2", "x"])
        spans.append(table(late.where(place != F.col("first")).select(*DOC, F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e")), "spans-late"))
        drop(split)
        count = table(each.groupBy("k1", "k2").agg(F.count("*").alias("kinds")).where("kinds > 1"), "quarters-kinds")
        open_ = each.select("k1", "k2", "first.*", "rest.*").join(count, ["k1", "k2"])
        few = open_.where(F.col("kinds") <= GROUP).select(F.xxhash64("k1", "k2").alias("h"), *PLACE, "around")
        spans.append(table(parsed(few, length), "spans-parsed"))
        many = count.where(F.col("kinds") > GROUP)
        if not many.head(1):
            drop(each)
            return spans
        nodes = open_.where(F.col("kinds") > GROUP).drop("kinds")


def repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(no_id, doc_id, d1, starts, ends): for each document the byte spans of runs that start earlier.

    A run of ``length`` bytes repeats only if its anchor (the least hash of its
    grams) does. Where an anchor's whole surrounding stood before, each run
    through it did. First places of surroundings whose anchor stands in no other
    hold no repeat. What remains is highly repetitive: the surroundings of an
    anchor that stands in several, which are parsed by prefix-free parsing. The
    suffix arrays of its dictionary and its parse give the order of all suffixes,
    where equal runs are neighbours, and the earliest of each is kept. An anchor
    with over ``GROUP`` surroundings is split first.
    """
    shape = Shape(length, gram, words=False)
    rows = by_order(docs)
    found = occurrences(rows, shape)
    each = contexts(found)
    place = F.struct(*PLACE)
    again = found.join(each.where("n > 1").select("h", "x", "first"), ["h", "x"]).where(place != F.col("first"))
    again = again.select(*DOC, F.greatest(F.lit(0), F.col("at") - (shape.reach - 1)).alias("s"), (F.col("at") + length).alias("e"))
    spans = [table(again, "spans-again")]
    drop(found)
    several = kinds(each)
    drop(each)
    many = table(several.where(F.col("kinds") > GROUP).select("h").distinct(), "anchors-crowded")
    around = table(surroundings(rows, shape, several.select("h", "first")), "surroundings")
    drop(several)
    crowd = many.count()
    if crowd:
        # A screen may let small anchors through as well, wholly; splitting them is as right.
        sieve = docs.sparkSession.sparkContext.broadcast(screen(many, crowd))
        around = table(divided(around, sieve), "surroundings-divided")
        spans += crowded(around.where("crowded").withColumns({"low": F.lit(1 - shape.reach).cast("long"), "high": F.lit(0).cast("long")}), length)
        around = around.where("not crowded")
    spans.append(table(parsed(around, length), "spans-parsed"))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return islands(every, DOC)


def dedup(docs: DataFrame, length: int = 100, gram: int = 48) -> DataFrame:
    """Remove each byte of a run of ``length`` bytes that also starts earlier, by doc_id, then place.

    Whole texts as UTF-8; runs never cross documents and are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal runs removed), kept (what
    is left, as bytes). A row per input row. Null text is empty; a null doc_id
    comes after all others; documents that share a doc_id are ordered by digest of their text, and rows that repeat both are one document, so neither is earlier. An
    empty table gives no rows. Other columns are not read.
    """
    joined = by_order(docs).join(repeated(docs, length, gram), DOC, "left")
    joined = joined.select(F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"), "raw", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for raw, starts, ends in zip(*(column(batch, c) for c in ("raw", "starts", "ends")), strict=True):
                data, at, rest, count = raw.as_py() or b"", 0, [], 0
                if starts.is_valid:
                    for a, b in zip(*(x.tolist() for x in merged(starts.values.to_numpy(), np.minimum(ends.values.to_numpy(), len(data)))), strict=True):
                        rest.append(data[at:a])
                        at, count = b, count + 1
                rest.append(data[at:])
                kept.append(b"".join(rest))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                n_spans.append(count)
            out = [column(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
