"""Substring dedup by seed and extend: winnowed anchors, extended both ways to runs that repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import column, digest, drop, sliced, table
from driftfield.llm.repeats import ambiguous, by_text, contexts, islands, kinds, occurrences
from driftfield.llm.seeds import Shape


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal disjoint spans in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(d1, d2, starts, ends): for each text the word spans of runs of ``length`` words that stand anywhere else.

    Seeds: each run's anchor is the least hash of its grams. Anchors that occur
    twice are extended both ways as far as a run through them can reach: if that
    whole surrounding occurs twice, so does every run in it. Only an anchor that
    stands in several surroundings needs its runs compared one by one, for one
    place of each surrounding. Groups are counted with partial sums and flags are
    joined back, so no group is gathered or paired. Merged, the spans of repeated
    runs are the maximal repeats of at least ``length`` words.
    """
    shape = Shape(length, gram, words=True)
    rows = by_text(docs)
    found = occurrences(rows, shape)
    each = contexts(found)
    often = each.where("n > 1").select("h", "x")
    whole = found.join(often, ["h", "x"], "left_semi").select(
        "d1", "d2", F.greatest(F.lit(0), F.col("at") - (shape.reach - 1)).alias("s"), (F.col("at") + length).alias("e")
    )
    whole = table(whole.distinct(), "spans-whole")
    drop(found)
    several = kinds(each)
    drop(each)
    runs = table(ambiguous(rows, shape, several.select("h", "first")), "runs")
    drop(several)
    place = F.struct("d1", "d2", "at")
    # Written, so that the join below deals both sides anew and Spark can split a hot run.
    twice = table(runs.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("w1", "w2"), "runs-twice")
    some = runs.join(twice, ["w1", "w2"], "left_semi").select("d1", "d2", F.col("at").alias("s"), (F.col("at") + length).alias("e"))
    some = table(some.distinct(), "spans-runs")
    drop(runs)
    drop(twice)
    return islands(whole.unionByName(some), ["d1", "d2"])


def dedup(docs: DataFrame, length: int = 35, gram: int = 8) -> DataFrame:
    """Remove the words of every run of ``length`` words that also starts elsewhere, in another or the same document.

    Words are runs of anything but ASCII white space, unchanged; runs are judged
    on the input. Copies of a text share its answer, so spans are kept by digest
    of the text.

    Returns doc_id, n_words, n_removed, kept (what is left, joined by single
    spaces). A row per input row. Null text has no words and keeps nothing; a
    null doc_id is an id like any other; repeated rows are documents that repeat
    each other. An empty table gives no rows. Other columns are not read.
    """
    spans = repeated(docs, length, gram).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "starts", "ends")
    d1, d2 = digest("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", d1.alias("d1"), d2.alias("d2"), F.encode("text", "UTF-8").alias("raw"))
    joined = rows.join(spans, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left").select("doc_id", "raw", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, kept = [], [], []
            for raw, starts, ends in zip(*(column(batch, c) for c in ("raw", "starts", "ends")), strict=True):
                words = (raw.as_py() or b"").split()
                n_words.append(len(words))
                at, rest = 0, []
                if starts.is_valid:
                    for a, b in zip(*(x.tolist() for x in merged(starts.values.to_numpy(), ends.values.to_numpy())), strict=True):
                        rest += words[at:a]
                        at = b
                rest += words[at:]
                n_removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
            out = [column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept"])

    cleaned = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return cleaned.withColumn("kept", F.decode("kept", "UTF-8"))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
p as (
  select r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) g
  from (select r, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
m as (select g from p group by g having count(*) > 1),
c as (select r, list(distinct k) gone from (select r, unnest(range(i, i + 35)) k from p join m using (g)) group by r)
select doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
       sha256(coalesce(case when gone is null then array_to_string(w, ' ')
         else (select string_agg(w[k], ' ' order by k) from (select unnest(range(1, len(w) + 1)) k) where not list_contains(gone, k)) end, '')) kept_sha256
from d left join c using (r)
"""
