"""Mixing sources to target weights by weighted fair queueing (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm.common import WORD, drop, table

#: Below this many sources the plan of the sources is broadcast.
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, weights: Sequence[int], passes: int) -> DataFrame:
    """(skey, source_size, target) of each source, by water-filling.

    Sources in code point order, null last, take ``weights`` in turn. Target =
    min(passes * size, level * weight) where the level makes the targets add up
    to all sizes. Sorted by cap / weight, the capped sources are a prefix, so
    the level is found with running sums over one row per source.
    """
    totals = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    plan = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = plan.select(
        "skey", "source_size", "w", "cap",
        F.row_number().over(order).alias("at"),
        F.sum("source_size").over(everything).cast("double").alias("budget"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    plan = plan.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), F.struct("at", level.alias("level"))))
    found = F.min("level").over(everything)["level"]
    return plan.select("skey", "source_size", F.least("cap", F.coalesce(found * F.col("w"), F.col("cap"))).alias("target"))


def sized_rows(docs: DataFrame, seed: str) -> DataFrame:
    """A row per document: row (a number of its own), doc_id, source, skey, size, h (its place in the shuffle), bucket."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("skey"), h.alias("h"))
    return rows.withColumns({"bucket": F.substring("h", 1, 3), "row": F.monotonically_increasing_id()})


def queue(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), passes: int = 3, seed: str = "mix") -> DataFrame:
    """The weighted fair queue of all sources, in global order, cut at the budget (all words).

    Each source is shuffled by a digest of the document id and repeated
    ``passes`` times. The virtual finish time of a copy is the running count of
    its source's words divided by the source's target; a copy in service when
    its source has had its target is cut there, so it finishes at 1. Copies are
    range-sorted by finish time, then source. Running totals over that order, as
    sums per range, offsets, and sums inside ranges, cut the queue where the
    budget is spent. What a source has beyond its target would come after that
    point, so it is not generated.

    Running counts of a source are built in two steps as well: 4096 buckets of the
    shuffle key are summed and offset, then rows are summed inside their bucket,
    so a hot source is spread over 4096 groups; rows without a doc_id share a
    bucket of their source.

    Returns row, doc_id, source, size, source_size, target, copy (from 0), words
    (what the copy has before the cut), finish, taken (what the cut leaves of it).
    A document that no copy of is reached has one row with words 0.
    """
    sized = table(sized_rows(docs, seed), "mix-sized")
    plan = table(source_targets(sized, weights, passes), "mix-sources")
    small = plan.count() <= BROADCAST_SOURCES
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    offsets = offsets.select("skey", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        sized.join(offsets, ["skey", "bucket"])
        .withColumn("before", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
        .join(F.broadcast(plan) if small else plan, "skey")
    )
    room = F.ceil("target").cast("long") - F.col("before")
    copies = [
        F.struct(F.lit(c).alias("copy"), F.greatest(F.lit(0), F.least("size", room - F.lit(c) * F.col("source_size"))).cast("long").alias("words"))
        for c in range(passes)
    ]
    reached = F.filter(F.array(*copies), lambda x: (x["words"] > 0) | (x["copy"] == 0))
    rows = queued.select("row", "doc_id", "source", "skey", "size", "source_size", "target", "before", F.inline(reached))
    done = F.col("before") + F.col("copy") * F.col("source_size") + F.col("words")
    rows = rows.withColumn("finish", F.when(F.col("words") > 0, F.least(F.lit(1.0), done / F.col("target"))))
    rows = rows.repartitionByRange(F.col("finish").asc_nulls_last(), "skey", "copy", "before", "row").withColumn("range", F.spark_partition_id())
    rows = table(rows, "mix-queue")
    drop(sized)
    sums = rows.groupBy("range").agg(F.sum("words").alias("n"))  # a row per range
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("spent"))
    order = Window.partitionBy("range").orderBy(F.col("finish").asc_nulls_last(), "skey", "copy", "before", "row")
    total = F.col("spent") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    budget = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))  # one row
    rows = rows.join(F.broadcast(sums), "range").withColumn("total", total).crossJoin(F.broadcast(budget))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("total") + F.col("words")))
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", "copy", "words", "finish", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), passes: int = 3, seed: str = "mix") -> DataFrame:
    """How much of each document the queue takes: doc_id, source, size, source_size, target, taken (repeats counted), finish (of its first copy).

    A row per input row. Null text has size 0; a null source is a source; a null
    doc_id is shuffled as the empty string. Repeated rows are documents of their
    own; equal ones are interchangeable. Copies that finish at once stand by
    source. A long text is one document of its size. An empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    each = queue(docs, weights, passes, seed)
    keys = ["row", "doc_id", "source", "size", "source_size", "target"]
    return each.groupBy(*keys).agg(F.sum("taken").alias("taken"), F.min("finish").alias("finish")).drop("row")


def schedule(queued: DataFrame) -> DataFrame:
    """The mix as a sequence, from :func:`queue`: a row per copy taken, sorted by virtual finish time.

    Returns doc_id, source, copy, words (those taken of it), finish. Documents of
    which nothing is taken have no row; an empty queue gives none.
    """
    rows = queued.where(F.col("taken") > 0).select("doc_id", "source", "copy", F.col("taken").alias("words"), "finish", "row")
    return rows.orderBy("finish", F.col("source").asc_nulls_last(), "copy", "row").drop("row")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select row_number() over () r, doc_id, source, coalesce('=' || source, 'null') skey, md5('mix:' || coalesce(doc_id::varchar, '')) h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size
  from documents),
t as (
  select source, sum(size)::bigint source_size,
         (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double w
  from d group by source),
o as (
  select *, source_size * 3.0::double cap, row_number() over (order by (source_size * 3.0::double) / w, source nulls last) k,
         (sum(source_size) over ())::double budget, sum(w) over () all_w from t),
v as (
  select *, coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0) cb,
         coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) wb from o),
l as (select (budget - cb) / (all_w - wb) lv from v where (budget - cb) / (all_w - wb) <= cap / w order by k limit 1),
p as (select source, source_size, least(cap, coalesce((select lv from l) * w, cap)) target from v),
q as (
  select d.*, source_size, target,
         (sum(size) over (partition by skey order by h nulls first, doc_id nulls first, size, r rows between unbounded preceding and current row) - size)::bigint before
  from d join p on d.source is not distinct from p.source),
c as (select *, unnest([0, 1, 2]) k from q),
s as (select *, before + k * source_size + size finishes, greatest(0, least(size, ceil(target)::bigint - before - k * source_size)) words from c),
f as (select *, least(1.0::double, finishes / target) finish from s where words > 0),
a as (select *, sum(words) over (order by finish, skey, k, before rows between unbounded preceding and current row) total from f),
g as (select r, sum(greatest(0, least(words, (select sum(size) from d) - total + words)))::bigint taken from a group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken from q left join g using (r)
"""
