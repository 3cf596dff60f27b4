"""Quality classifier: hashed subword embeddings averaged per document, softmax, numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import column, digest, sliced

#: Code points handled at once; longer texts are cut at white space where there is some.
BLOCK = 1 << 18
GRAMS = (3, 4)
#: Fixed odd multipliers of the feature hashes (golden ratio and digits of pi), and white space.
PHI, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x243F6A8885A308D3)
#: The bucket of every text's end, and that of a word said twice.
END, REPEAT = 0, 1
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    if key not in _powers or len(_powers[key]) < n:
        out = np.full(max(n, 1 << 14), base, np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out)
    return _powers[key][:n]


INVERSE = pow(int(BASE), -1, 1 << 64)


def _features(points: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of one block's words, of pairs of a word with itself (one bucket for all), and of 3- and 4-character runs.

    No run spans white space; one may begin or end there.
    """
    space = np.isin(points, SPACES)
    clean = np.where(space, np.uint32(32), points)
    shift = np.uint64(64 - bits)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    mixed = (clean.astype(np.uint64) + np.uint64(1)) * PHI
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * _power(int(BASE), len(mixed)), dtype=np.uint64)])
    words = (sums[ends] - sums[starts]) * _power(INVERSE, len(mixed) + 1)[starts]
    again = np.full(int((words[1:] == words[:-1]).sum()), REPEAT, np.uint64)
    found = [(words ^ words >> np.uint64(29)) * PHI >> shift, again]
    for n in GRAMS:
        count = len(points) - n + 1
        if count < 1:
            continue
        value = np.full(count, n, np.uint64)
        inner = np.zeros(count, bool)
        for k in range(n):
            value = value * BASE + mixed[k : k + count]
            if 0 < k < n - 1:
                inner |= space[k : k + count]
        value = value[~inner]
        found.append((value ^ value >> np.uint64(29)) * PHI >> shift)
    return np.concatenate(found).astype(np.int64)


def blocks(text: str | None) -> Iterator[np.ndarray]:
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    at = 0
    while at < len(points):
        end = min(len(points), at + BLOCK)
        if end < len(points):
            cut = np.flatnonzero(np.isin(points[at:end], SPACES))
            end = at + int(cut[-1]) + 1 if len(cut) else end
        yield points[at:end]
        at = end


def bag(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights that add up to 1) of a text; every text's end counts once, so none is empty."""
    counts = np.zeros(1 << bits, np.int64)
    counts[END] = 1
    for points in blocks(text):
        counts += np.bincount(_features(points, bits), minlength=1 << bits)
    used = np.flatnonzero(counts)
    return used.astype(np.uint32), (counts[used] / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """What scoring needs of a trained model: for each bucket the difference of the two classes' logits."""

    bits: int
    slope: np.ndarray

    def score(self, text: str | None) -> float:
        total, n = float(self.slope[END]), 1
        for points in blocks(text):
            found = _features(points, self.bits)
            total, n = total + float(self.slope[found].sum(dtype=np.float64)), n + len(found)
        return float(1 / (1 + np.exp(-np.clip(total / n, -500, 500))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent over (label, buckets, weights).

    A document's vector is the weighted mean of its features' vectors; softmax
    over two classes. Since scoring is linear up to the softmax, a feature's
    vector times the difference of the class vectors is all that is kept.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    classes = np.zeros((2, dim), np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, used, weights = rows[i]
            now = rate * (1 - done / steps)
            mean = weights @ vectors[used]
            logits = classes @ mean
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ classes
            classes -= np.float32(now) * np.outer(error, mean).astype(np.float32)
            # A mean spreads the gradient over all features; without a factor, long texts would hardly move theirs.
            vectors[used] -= np.float32(now * len(used) ** 0.5) * np.outer(weights, back).astype(np.float32)
            done += 1
    return Model(bits, (vectors @ (classes[1] - classes[0])).astype(np.float32))


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text is divisible by 5. A null id is not held out."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, bits: int = 17, **training) -> Model:
    """Train on at most ``most`` labelled documents that are not held out, chosen by a hash of their id.

    That bound is the only sample in this operator. What reaches the driver are
    those documents' feature weights, 8 bytes for each bucket that they use (at
    most 1 MB each). A document whose labels disagree takes the smaller one; of
    rows that share an id, that of the smallest digest of its text is learnt from.
    Labels other than 0 and 1, null ids and ids without a document are left out.
    Without any label, every score is 0.5. Other columns are not read.
    """
    chosen = (
        labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality")
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bags = [bag(x.as_py(), bits) for x in column(batch, "text")]
            used, weights = (pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality"), used, weights], ["doc_id", "quality", "used", "weights"])

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("text", F.struct(*digest("text"))).alias("text"))
    found = texts.mapInArrow(run, "doc_id long, quality int, used binary, weights binary").collect()  # at most ``most`` rows
    found.sort(key=lambda r: (r["doc_id"], bytes(r["used"]), bytes(r["weights"])))
    rows = [(r["quality"], np.frombuffer(r["used"], np.uint32), np.frombuffer(r["weights"], np.float32)) for r in found]
    return train(rows, bits, **training)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Score whole texts.

    One pass over the rows without a shuffle; the model (4 bytes a bucket) is
    broadcast. Returns all of ``docs``' doc_id with score (0 to 1, higher: label 1
    likelier) and predicted (1 from ``threshold`` on). Null and empty texts get
    the score of no features. A row per input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.slope))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in sliced(batches):
            scores = np.array([own.score(x.as_py()) for x in column(batch, "text")], np.float64)
            predicted = pa.array((scores >= threshold).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores, pa.float64()), predicted], ["doc_id", "score", "predicted"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns stay, whatever their names.

    A row is judged by its text: null and empty texts by the score of no
    features, long ones as a whole, copies alike whatever their ids. A score at
    the threshold stays. Without labels all score 0.5. An empty table gives no rows.
    """
    model = fit(docs, labels, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.slope))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([own.score(x.as_py()) >= threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A null doc_id is scored like any other; repeated rows get equal rows; empty tables give no rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
