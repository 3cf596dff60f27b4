"""Benchmark decontamination by a broadcast set of test n-grams (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import digest, lower_ascii, table

#: A word once A-Z is lower-cased, and the same before that.
LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Test n-grams are broadcast up to so many, and so many bytes of their words; more are joined by shuffle.
BROADCAST_GRAMS, BROADCAST_BYTES = 200_000, 32 << 20
#: Slots of the table of beginnings (a byte each, sent with the tasks): at least, for each test window, and at most. A fuller table lets more through to the join.
SLOTS = (1 << 12, 64, 1 << 23)


def words_of(text: str) -> Column:
    """Words as they stand in the text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def lowered(words: Column) -> Column:
    return F.transform(words, lower_ascii)


def test_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """(h, m, gram, item_id): the windows of each item; one of fewer words than ``n`` is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), lowered(words_of("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    grams = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram")).distinct()
    return grams.select(F.xxhash64("gram").alias("h"), F.size("gram").alias("m"), "gram", "item_id")


def taken(slots: int, *words: Column) -> list[Column]:
    """The two slots of a beginning."""
    return [F.pmod(F.xxhash64(F.lit(k), *words), F.lit(slots)).cast("int") for k in (1, 2)]


#: Words of a window's beginning.
BEGIN = 4


def beginning(q: int, word: Callable[[int], Column]) -> Column:
    """One hash of the first ``q`` words, from the hashes of words; of four, of two pairs, so that pairs are hashed once."""
    pair = lambda k: F.xxhash64(word(k), word(k + 1))
    return {1: lambda: word(0), 2: lambda: pair(0), 3: lambda: F.xxhash64(pair(0), word(2)), 4: lambda: F.xxhash64(pair(0), pair(2))}[q]()


def beginnings(grams: DataFrame, lengths: list[int]) -> tuple[int, bytes]:
    """A table of the first words of all test windows (``BEGIN``, or all of a shorter one): "1" in the slots of their hashes.

    Words are hashed in plain lower case, which agrees wherever the contract's
    does. The driver gets slot numbers, at most as many as there are slots.
    """
    least, each, most = SLOTS
    slots = min(most, max(least, 1 << (each * grams.count()).bit_length()))
    word = lambda k: F.xxhash64(F.lower(F.get("gram", F.lit(k))))
    both = F.array(F.lit(0))
    for q in sorted({min(m, BEGIN) for m in lengths}):
        both = F.when(F.least("m", F.lit(BEGIN)) == q, F.array(*taken(slots, beginning(q, word)))).otherwise(both)
    found = grams.select(F.explode(both).alias("s"))
    parts = found.groupBy(F.shiftright("s", 12)).agg(F.collect_set("s").alias("s"))  # at most 4096 in each
    data = bytearray(b"0" * slots)
    for r in parts.toLocalIterator():
        for s in r["s"]:
            data[s] = 49
    return slots, bytes(data)


def behind(x: str, k: int) -> Column:
    """An array from its k-th element on."""
    return F.slice(x, F.lit(k + 1), F.greatest(F.lit(1), F.size(x)))


def together(x: str, y: Column) -> Column:
    """Hashes of an element of ``x`` and that of ``y``; null where the text ends."""
    return F.zip_with(x, y, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hashes of the words ``w`` and of pairs of them, each once."""
    rows = rows.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(F.lower(x))))
    return rows.withColumn("pairs", together("hashes", behind("hashes", 1)))


def candidates(lengths: list[int], begin: tuple[int, bytes]) -> Column:
    """(i, m, words): the windows of the words ``w`` that begin like a test window; i counts from 0. ``hashes`` and ``pairs`` stand beside ``w``.

    All of it is one array expression: a word is hashed once, a place costs a
    look or two into the table, and only places that pass get their windows'
    words, so a text takes memory in proportion to its length.
    """
    slots, data = begin

    def known(*words: Column) -> Column:
        first, second = (F.substring(F.lit(data), s + 1, F.lit(1)) == F.lit(b"1") for s in taken(slots, *words))
        return first & second

    by = {1: F.col("hashes"), 2: F.col("pairs"), 3: together("pairs", behind("hashes", 2)), 4: together("pairs", behind("pairs", 2))}
    flag = lambda x: F.transform(x, lambda a: F.when(a.isNotNull() & known(a), F.lit(1)).otherwise(F.lit(0)))
    passed = None
    for q in sorted({min(m, BEGIN) for m in lengths}):
        passed = flag(by[q]) if passed is None else F.zip_with(passed, flag(by[q]), lambda a, b: a + b)
    places = F.filter(F.transform(passed, lambda a, k: F.when(a > 0, k).otherwise(F.lit(-1))), lambda k: k >= 0)
    sizes = F.array(*[F.lit(m) for m in lengths]).cast("array<int>")
    window = lambda i, m: F.struct(i.alias("i"), m.alias("m"), lowered(F.slice("w", i + 1, m)).alias("words"))
    return F.flatten(F.transform(places, lambda i: F.transform(F.filter(sizes, lambda m: i + m <= F.size("w")), lambda m: window(i, m))))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Find the test items' windows in whole documents.

    One pass over the texts yields the windows that begin like a test window.
    They meet the items' windows by hash (broadcast while few) and count after
    their words are compared. Hits are gathered per text, so copies share them,
    and their union is counted with a running end.

    Returns doc_id, d1, d2 (digest of the text), n_words, n_hit (words inside a
    window's occurrence), n_items, items (ids as strings, in string order),
    contaminated; a row per input row. Null text has no words; an item without
    words has no window; a null item_id still hits but is no item; null and
    repeated doc_ids are judged by their own texts. Rows that repeat doc_id and
    text get equal rows. Empty tables give no rows, or no hits. Other columns are
    not read, whatever their names.
    """
    grams = table(test_grams(benchmark, n), "test-grams")
    lengths = sorted(r["m"] for r in grams.select("m").distinct().collect())  # at most n values
    count, size = grams.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("gram", " "))), F.lit(0))).first()
    few = count <= BROADCAST_GRAMS and size <= BROADCAST_BYTES
    d1, d2 = digest("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", d1.alias("d1"), d2.alias("d2"), words_of("text").alias("w"))
    found = candidates(lengths, beginnings(grams, lengths)) if lengths else F.array().cast("array<struct<i:int,m:int,words:array<string>>>")
    base = table(hashed(base).select("doc_id", "d1", "d2", F.size("w").cast("long").alias("n_words"), found.alias("windows")), "leak-windows")
    hits = base.select("d1", "d2", F.inline("windows")).withColumn("h", F.xxhash64("words"))
    hits = hits.join(F.broadcast(grams) if few else grams, ["h", "m"]).where(F.col("words") == F.col("gram"))
    found = hits.groupBy("d1", "d2").agg(F.array_sort(F.collect_set(F.struct("i", "m"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["i"] + s["m"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["i"] + s["m"] - F.greatest(a["end"], s["i"]))).alias("n"),
        ),
    )["n"]
    rows = base.select("doc_id", "d1", "d2", "n_words").join(found.select("d1", "d2", covered.alias("hit"), "items"), ["d1", "d2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "d1", "d2", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; all columns stay, whatever their names.

    A row is judged by its own text, so null and repeated ids change nothing, and
    copies go together. Null and empty texts stay. Empty tables give no rows, or
    leave all.
    """
    bad = find(docs, benchmark, n).where("contaminated").select("d1", "d2").distinct()
    d1, d2 = digest(docs["text"].cast("string"))
    return docs.join(bad, (d1 == bad["d1"]) & (d2 == bad["d2"]), "left_anti")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with b as (
  select item_id::varchar item_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) w from benchmark),
g as (
  select distinct item_id, array_to_string(list_slice(w, i, i + 9), ' ') gram, least(10, len(w)) m
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from b where len(w) > 0)),
d as (
  select row_number() over () r, doc_id, coalesce(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), []) w from documents),
p as (
  select r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') gram
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) i from d, (select distinct m from g) where len(w) >= m)),
h as (select r, i, m, item_id from p join g using (gram, m)),
c as (select r, count(distinct k) n_hit from (select r, unnest(range(i, i + m)) k from h) group by r),
s as (select r, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) sha from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       coalesce(sha, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (r) left join s using (r)
"""
