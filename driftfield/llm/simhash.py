"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm.common import column, digest, drop, kept, sliced, table
from driftfield.llm.components import components

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once (64 bytes each).
BLOCK = 1 << 14


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes: a bit is set if it is in over half of them; none: 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text: a bit is set if it is in over half of the shingles' hashes; no words: 0."""
    words = (text or b"").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at + shingle - 1 : min(n, at + BLOCK) + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, d1, d2, fp) per row: digest of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(x.as_py(), shingle) for x in column(batch, "raw")], np.uint64)
            keys = [column(batch, k) for k in ("doc_id", "d1", "d2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found.view(np.int64), pa.int64())], ["doc_id", "d1", "d2", "fp"])

    d1, d2 = digest("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", d1.alias("d1"), d2.alias("d2"), F.encode("text", "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, d1 long, d2 long, fp long")


def signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks such that any ``radius`` bit places are all left out by some mask.

    Each place has a non-zero vector of radius + 1 bits. A mask, one for each
    non-zero vector v, holds the places whose vector has odd overlap with v. To
    any ``radius`` vectors some v is orthogonal, so two words that differ there
    at most agree under that mask.
    """
    size = (1 << (radius + 1)) - 1
    return [signed(sum(1 << i for i in range(bits) if ((i % size + 1) & v).bit_count() % 2)) for v in range(1, size + 1)]


def flips(mask: int, radius: int, bits: int = BITS) -> list[int]:
    """0 and all words of up to half of ``radius`` (rounded up) bits outside ``mask``."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [signed(sum(1 << i for i in chosen)) for k in range((radius + 1) // 2 + 1) for chosen in combinations(free, k)]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between fingerprints that connect all pairs within ``radius`` (1 to 4) bits.

    Fingerprints meet in the tables of the covering masks: one for each mask,
    keyed by the bits that it holds. Those within the radius share a bucket of
    some table, where they differ in the bits outside its mask only. In place of
    a bucket's pairs, each member emits the words of its bucket that differ from
    it in up to half of the radius. Two members are within the radius if and only
    if some word is as near to both, and half a bit nearer to one if the radius is
    odd. So all that emitted a word are linked to the smallest of the near ones:
    no pair is lost, and what a member emits does not depend on how many share
    its bucket.
    """
    if radius not in (1, 2, 3, 4):
        raise ValueError("radius is 1 to 4")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    hashed = distinct.select("fp", F.inline(tables))
    shared = hashed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("t", "key")
    # A row per fingerprint with its shared buckets, so that a crowded bucket's members are dealt by fingerprint.
    members = hashed.join(shared, ["t", "key"], "left_semi").groupBy("fp").agg(F.collect_list("t").alias("ts"))

    def words(k: int, mask: int) -> Column:
        near = F.lit(flips(mask, radius)).cast("array<bigint>")
        all_ = F.transform(near, lambda x: F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseXOR(x).alias("word")))
        return F.when(F.array_contains("ts", k), all_).otherwise(F.array().cast("array<struct<t:int,word:bigint>>"))

    emitted = [words(k, m) for k, m in enumerate(masks)]
    met = members.select("fp", F.inline(F.flatten(F.array(*emitted))))
    near = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("word"))) <= radius // 2, F.col("fp"))
    met = met.withColumn("lo", F.min(near).over(Window.partitionBy("t", "word")))
    return met.where("lo is not null and fp != lo").select(F.col("fp").alias("u"), F.col("lo").alias("v")).distinct()


def _grouped(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """doc_id, d1, d2, fp, root (a fingerprint of the component) and component_id per row."""
    rows = table(fingerprints(docs, shingle), "fingerprints")
    distinct = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints-distinct")
    found = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    member = distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = table(member.select("fp", "root").join(heads, "root"), "fingerprints-heads")
    drop(distinct)
    return rows.join(member, "fp")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint whole texts and find the components of those within ``radius`` bits.

    Copies meet in one fingerprint before any linking. Returns doc_id, fp,
    component_id (the smallest doc_id reachable): a row per input row. Null and
    empty texts have fingerprint 0 and link like any other; a long text is read
    whole; null ids are never the smallest (a component of null ids only has a
    null component_id); repeated rows are copies. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    return _grouped(docs, shingle, radius).select("doc_id", "fp", "component_id")


def clean(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component; all columns stay, whatever their names.

    That is the one of the smallest id, null last, then the smallest digest of
    its text. Rows that repeat both are one document and stay together. Empty and
    null texts are one component. An empty table gives no rows.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2")
    heads = _grouped(docs, shingle, radius).groupBy("root").agg(F.min(order).alias("head")).select("head.doc_id", "head.d1", "head.d2")
    return kept(docs, table(heads, "component-heads"))


def query(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
