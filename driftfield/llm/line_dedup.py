"""Line dedup by a deletion-neighbourhood join (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftfield.llm.common import digest, drop, table

#: Up to this many candidate lines (16 bytes of digest each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_LINES = 500_000

#: Where a line stands: ids in order, null last; documents that share an id by digest; then the line's number.
PLACE = ("no_id", "doc_id", "d1", "d2", "line_no")


def _documents(docs: DataFrame) -> DataFrame:
    d1, d2 = digest("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), d1.alias("d1"), d2.alias("d2"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: place, line, its digest, and its length."""
    rows = docs.select("no_id", "doc_id", "d1", "d2", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    h1, h2 = digest("line")
    return rows.where(F.length(F.trim("line")) > 0).select(*PLACE, "line", h1.alias("h1"), h2.alias("h2"))


def _halves() -> Column:
    """Keys of which two lines within one edit share at least one.

    With L the longer one's length, the edit is either behind the first L // 2
    characters, which then agree, or before the last L - L // 2, which then do.
    A line is the longer or the shorter one: L is its length, or one more.
    """
    n = F.length("line")
    keys = []
    for longer in (n, n + 1):
        half = F.floor(longer / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), longer, F.substring("line", F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), longer, F.right("line", longer - half)))
    return F.array_distinct(F.array(*keys))


def _pair(kind: str, *x: Column) -> list[Column]:
    return [F.xxhash64(F.lit(f"{kind}1"), *x), F.xxhash64(F.lit(f"{kind}2"), *x)]


def _blocks() -> Column:
    """A line cut to blocks, each struck out in turn: what stands around the block as a key, and the block.

    With L the longer one's length, blocks have about its square root of
    characters; two lines within one edit agree around the block that holds it,
    counted from the front before it and from the end behind it. A line stands
    as the longer one (or as one of equal length), and as the shorter.
    """
    n = F.length("line")

    def cut(longer: Column, role: str) -> Column:
        size = F.greatest(F.lit(4), F.ceil(F.sqrt(longer))).cast("int")

        def block(j: Column) -> Column:
            head, behind = j * size, F.greatest(F.lit(0), longer - (j + 1) * size)
            k = _pair("block", longer, j, F.substring("line", F.lit(1), head), F.right("line", behind))
            middle = F.substring("line", head + 1, n - head - behind)
            return F.struct(F.lit(role).alias("role"), k[0].alias("b1"), k[1].alias("b2"), middle.alias("middle"))

        return F.transform(F.sequence(F.lit(0), F.ceil(longer / size).cast("int") - 1), block)

    return F.concat(cut(n, "long"), cut(n + 1, "short"))


def _neighbourhood() -> Column:
    """The keys of a block's deletion neighbourhood, within equal surroundings.

    Side ``x`` is a shorter line's block, side ``y`` a longer one's with a character
    deleted; ``both`` is a block with a character deleted, and the place of that,
    met by a block that has another character there.
    """
    around = [F.col("b1"), F.col("b2")]
    without = lambda i: F.concat(F.substring("middle", F.lit(1), i), F.substring("middle", i + 2, F.length("middle")))
    key = lambda side, pair: F.struct(F.lit(side).alias("side"), pair[0].alias("k1"), pair[1].alias("k2"))
    places = F.sequence(F.lit(0), F.length("middle") - 1)
    gone = F.transform(places, lambda i: key("y", _pair("one", *around, without(i))))
    swap = F.transform(places, lambda i: key("both", _pair("swap", *around, i, without(i))))
    return F.when(F.col("role") == "short", F.array(key("x", _pair("one", *around, F.col("middle"))))).otherwise(F.concat(gone, swap))


def _thirds() -> Column:
    """Keys of which two lines within two edits share at least one.

    Of three parts of the longer one no edit touches some: the first, which then
    begins the other as well, the last, which ends it, or the middle, which then
    stands in it at most one place off. L is a line's length, or up to two more.
    """
    n, keys = F.length("line"), []
    for longer in (n, n + 1, n + 2):
        a, b = F.floor(longer / 3).cast("int"), F.floor(longer * 2 / 3).cast("int")
        keys.append(F.xxhash64(F.lit("head"), longer, F.substring("line", F.lit(1), a)))
        keys.append(F.xxhash64(F.lit("tail"), longer, F.right("line", longer - b)))
        keys += [F.xxhash64(F.lit("middle"), longer, F.substring("line", F.greatest(F.lit(1), a + 1 + k), b - a)) for k in (-1, 0, 1)]
    return F.array_distinct(F.array(*keys))


def _neighbourhood_of_two() -> Column:
    """The keys of a line's deletion neighbourhood within two edits, each with the side (``x``, ``y`` or both) that it meets the other from.

    An insertion deletes from the longer line only, a substitution from both, at
    one place of what is left. So lines meet whole (one or two deletions of the
    longer), with a deletion each, with a substitution's place and a deletion of
    the longer, or with two substitutions' places.
    """
    n = F.length("line")
    drop_ = lambda text, i: F.concat(F.substring(text, F.lit(1), i), F.substring(text, i + 2, F.length(text)))
    key = lambda side, kind, *x: F.struct(F.lit(side).alias("side"), *[c.alias(f"k{k + 1}") for k, c in enumerate(_pair(kind, *x))])
    each = F.sequence(F.lit(0), n - 1)
    line = F.col("line")
    whole = F.array(key("x", "one", line), key("x", "two", line))
    ones = F.flatten(F.transform(each, lambda i: F.array(key("y", "one", drop_(line, i)), key("both", "each", drop_(line, i)), key("x", "moved", i, drop_(line, i)))))

    def second(i: Column) -> Column:
        left = drop_(line, i)

        def twice(j: Column) -> Column:  # j counts in what the first deletion left, from its place on
            rest = drop_(left, j)
            return F.array(key("y", "two", rest), key("y", "moved", i, rest), key("y", "moved", j, rest), key("both", "places", i, j, rest))

        return F.flatten(F.transform(F.sequence(i, n - 2), twice))

    twos = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), second))).otherwise(F.slice(ones, F.lit(1), F.lit(0)))
    return F.concat(whole, ones, twos)


def _near(firsts: DataFrame, docs: DataFrame, max_edits: int) -> DataFrame:
    """(h1, h2) of the lines that are within ``max_edits`` edits of an earlier line."""
    # Screen: only lines that share a part with another line can have a neighbour.
    keys = firsts.where(F.col("parts").isNotNull()).select("h1", "h2", F.explode("parts").alias("k"))
    shared = keys.groupBy("k").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a != b").select("k")
    screened = table(keys.join(shared, "k", "left_semi").select("h1", "h2").distinct(), "line-candidates")
    few = screened.count() <= BROADCAST_LINES
    texts = _lines(docs).join(F.broadcast(screened) if few else screened, ["h1", "h2"], "left_semi")
    texts = texts.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("place"), F.first("line").alias("line"))
    texts = table(texts, "line-texts")
    if max_edits == 1:
        # Strike out blocks; only lines that then agree with another go on, with that block.
        struck = texts.select(F.struct("place", "h1", "h2").alias("me"), F.inline(_blocks()))
        agree = struck.groupBy("b1", "b2").agg(F.min("me").alias("a"), F.max("me").alias("b")).where("a != b").select("b1", "b2")
        emitted = struck.join(agree, ["b1", "b2"], "left_semi").select("me", F.inline(_neighbourhood()))
    else:
        emitted = texts.select(F.struct("place", "h1", "h2").alias("me"), F.inline(_neighbourhood_of_two()))
    # In a group of equal keys every line is within the bound of those of the other side, or of all.
    same = Window.partitionBy("k1", "k2")
    least = lambda side: F.min(F.when(F.col("side") == side, F.col("me"))).over(same)
    other = F.when(F.col("side") == "x", least("y")).when(F.col("side") == "y", least("x")).otherwise(least("both"))
    met = emitted.select("me", other.alias("other"))
    pairs = met.where(F.col("other") < F.col("me")).distinct()
    # Verify: fetch both lines and count the edits.
    mine = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    theirs = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    pairs = pairs.select("me.h1", "me.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    pairs = pairs.join(mine, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")))
    pairs = pairs.join(theirs, (F.col("o1") == F.col("b1")) & (F.col("o2") == F.col("b2")))
    edits = F.levenshtein("a", "b", max_edits)
    found = table(pairs.where((edits >= 0) & (edits <= max_edits)).select("h1", "h2").distinct(), "line-near")
    drop(screened)
    drop(texts)
    return found


def dedup(docs: DataFrame, max_edits: int = 1, min_fuzzy: int = 0) -> DataFrame:
    """Keep, of lines within ``max_edits`` edits of each other, the earliest.

    Lines are parted by newline. In the order of doc_id, then line number, a line
    goes if an earlier line is within ``max_edits`` insertions, deletions or
    substitutions of it (judged on the input, not on what is left); lines of fewer
    than ``min_fuzzy`` characters go only if an equal one stands earlier. Blank
    lines stay. Equal lines are joined by digest first. A screen on halves of lines
    finds all that can have a neighbour, and one on blocks finds where its edit
    can be. Those blocks emit their deletion neighbourhood as hashed keys, groups
    of equal keys name the earliest line, and the edit distance of those pairs is
    verified. A group gives each member one partner, never all pairs.

    Returns doc_id, d1, d2 (digest of the input text), n_lines, n_removed, kept
    (the text that is left); a row per distinct doc_id and text, since rows that
    repeat both are one document. Null text is null, with no lines; a null doc_id
    comes last in order; documents that share an id are ordered by digest. A long
    text is one row per line on the way, and whole again at the end. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    rows = _documents(docs)
    lines = _lines(rows)
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits is 0, 1 or 2")
    parts = {0: F.lit(None).cast("array<bigint>"), 1: _halves(), 2: _thirds()}[max_edits]
    lines = lines.withColumn("parts", F.when(F.length("line") >= min_fuzzy, parts))
    firsts = table(lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("place"), F.first("parts").alias("parts")), "line-firsts")
    kept = firsts
    if max_edits:
        kept = firsts.join(_near(firsts, rows, max_edits), ["h1", "h2"], "left_anti")
    kept = kept.select("place.*")
    blank = rows.select("no_id", "doc_id", "d1", "d2", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    blank = blank.where(F.length(F.trim("line")) == 0).select(*PLACE)
    stays = kept.unionByName(blank).groupBy("no_id", "doc_id", "d1", "d2").agg(F.array_sort(F.collect_set("line_no")).alias("stays"))
    stays = table(stays, "line-stays")
    drop(firsts)
    found = rows.dropDuplicates(["no_id", "doc_id", "d1", "d2"]).join(stays, ["no_id", "doc_id", "d1", "d2"], "left")
    found = found.withColumn("parts", F.split("text", "\n", -1)).withColumn("stays", F.coalesce("stays", F.array().cast("array<int>")))
    n_lines = F.coalesce(F.size("parts"), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    left = F.array_join(F.transform("stays", lambda i: F.get("parts", i)), "\n")
    return found.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "d1", "d2", n_lines.alias("n_lines"),
        (n_lines - F.size("stays")).alias("n_removed"), F.when(F.col("text").isNotNull(), left).alias("kept"),
    )


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the lines that :func:`dedup` removes taken out of ``text``; ``n_chars``, if there is one, is counted anew.

    Other columns stay, whatever their names. A row per input row: null texts
    stay null, rows that repeat a document all get what is left of it, and a null
    doc_id is an id like any other. An empty table gives no rows.
    """
    found = dedup(docs, **options).select("doc_id", "d1", "d2", "kept")
    d1, d2 = digest(docs["text"].cast("string"))
    rows = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (d1 == found["d1"]) & (d2 == found["d2"]))
    new = {"text": found["kept"], "n_chars": F.length(found["kept"]).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with t as (select distinct doc_id, text from documents),
l as (
  select doc_id, text, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10)))))::bigint no from t where text is not null),
f as (select line, min((doc_id, no)) place, length(line) n from l where length(trim(line, ' ')) > 0 group by line),
k as (
  select line, n, place, unnest([x || '<' || left(line, (x // 2)::bigint), x || '>' || right(line, (x - x // 2)::bigint)]) key
  from (select line, n, place, unnest([n, n + 1]) x from f)),
p as (
  select distinct a.line a, a.n m, b.line b, b.n n from k a join k b using (key)
  where a.place > b.place and a.line <> b.line and abs(a.n - b.n) <= 1),
near as (
  select distinct a from p
  where len(list_filter(range(0, greatest(m, n)), lambda i:
    left(a, i) = left(b, i) and substr(a, i + 1 + (m >= n)::int) = substr(b, i + 1 + (n >= m)::int))) > 0),
s as (select place from f where line not in (select a from near)),
j as (
  select l.*, length(trim(line, ' ')) = 0 or s.place is not null stays
  from l left join s on s.place = (l.doc_id, l.no) and length(trim(line, ' ')) > 0)
select t.doc_id, count(j.no)::bigint n_lines, (count(j.no) - count(j.no) filter (j.stays))::bigint n_removed,
       sha256(coalesce(string_agg(j.line, chr(10) order by j.no) filter (j.stays), '')) kept_sha256
from t left join j on t.doc_id = j.doc_id and t.text = j.text group by t.doc_id, t.text
"""
