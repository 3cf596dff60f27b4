"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftfield.llm import decontamination, line_dedup, media, mixing, quality, repeats, secrets, substring_dedup, suffix_dedup, warc
from driftfield.llm.prefix_free import earlier_runs

#: Columns of these names are used inside the operators.
CLASH = dict(h="a", x=1, d1="b", d2=2, line="c", at=3, size="d", target=4.0, raw="e", words="f", key=5, bucket="g", place=6, first="h")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(seed, n=60, vocabulary=12, longest=80, sep=" "):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 4 else f"Ñ{i}é" for i in range(vocabulary)]
    out = [sep.join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]
    return out + out[:6] + ["", None, " \t ", sep.join(rng.choices(words, k=3000))]


# Line dedup.


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def brute_lines(rows, fuzzy, bound=1):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], []
    for i, t in rows:
        kept = []
        lines = t.split("\n") if t is not None else []
        for line in lines:
            if not line.strip(" "):
                kept.append(line)
                continue
            near = any(s == line or len(line) >= fuzzy and len(s) >= fuzzy and abs(len(s) - len(line)) <= bound and edits(s, line) <= bound for s in seen)
            seen.append(line)
            if not near:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(documents):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdé ", k=rng.randint(15, 70))) for _ in range(25)]

    def changed(s):
        i, how = rng.randrange(len(s)), rng.randrange(4)
        return [s, s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]][how]

    rows = [(i, "\n".join([*(changed(rng.choice(base)) for _ in range(rng.randint(0, 6))), *[""] * (i % 3)])) for i in range(40)]
    long = "".join(rng.choices("abc", k=1500))
    rows += [(50, long), (51, long[:700] + "z" + long[700:]), (52, "short"), (53, "shor"), (54, None), (None, base[0]), rows[3], (55, long[1:]), (56, "\n\n")]
    got = line_dedup.dedup(documents(rows, **CLASH)).select("doc_id", "n_lines", "n_removed", "kept")
    assert result(got) == brute_lines(rows, 0)
    want = brute_lines(rows, 20)
    got = line_dedup.dedup(documents(rows, **CLASH), min_fuzzy=20).select("doc_id", "n_lines", "n_removed", "kept")
    assert result(got) == want
    assert sum(r[2] for r in want) > 40
    short = [(i, "\n".join("".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(4))) for i in range(30)]
    assert result(line_dedup.dedup(documents(short)).select("doc_id", "n_lines", "n_removed", "kept")) == brute_lines(short, 0)
    exact = line_dedup.dedup(documents(rows), max_edits=0).select("doc_id", "n_lines", "n_removed", "kept")
    assert result(exact) == brute_lines(rows, math.inf)
    assert line_dedup.dedup(documents([])).count() == 0


def test_line_dedup_within_two_edits(documents):
    rng = random.Random(31)
    base = ["".join(rng.choices("abé ", k=rng.randint(1, 24))) for _ in range(12)]

    def changed(s):
        for _ in range(rng.randint(0, 3)):
            i, how = rng.randint(0, len(s)), rng.randrange(3)
            s = [s[:i] + s[i + 1 :], s[:i] + rng.choice("abx") + s[i:], s[:i] + rng.choice("aby") + s[i + 1 :]][how]
        return s

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    got = line_dedup.dedup(documents(rows), max_edits=2).select("doc_id", "n_lines", "n_removed", "kept")
    assert result(got) == brute_lines(rows, 0, 2)


def test_line_dedup_clean_keeps_columns(documents):
    docs = documents([(1, "one line of some length here\nb"), (2, "one line of some length hare\nc"), (3, None)], **CLASH)
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("one line of some length here\nb", 30), 2: ("", 0), 3: (None, None)}


# Decontamination.


def brute_decontamination(docs, bench, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = defaultdict(set)
    for item, t in bench:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[i : i + n])].add(item)
    out = []
    for i, t in docs:
        w = words(t)
        hit, items = set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                found = grams.get(tuple(w[k : k + m]))
                if found:
                    hit |= set(range(k, k + m))
                    items |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [True, False])
def test_decontamination(spark, documents, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontamination, "BROADCAST_GRAMS", 0)
        monkeypatch.setattr(decontamination, "SLOTS", (8, 1, 8))  # a full table lets every place through
    rng = random.Random(2)
    vocabulary = ["Ab", "cD", "É", "é", "k9", "x", "ΑΣ", "ας", "İx", "zz"]
    line = lambda k: rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, k=k))
    bench = [(i, line(rng.randint(0, 25))) for i in range(20)] + [(2, line(12)), (None, line(11)), (31, None), (32, "one-word lone"), (33, "ΑΣ zz")]
    docs = [(i, " ".join([line(rng.randint(0, 30)), rng.choice(bench)[1] or "", line(5)])) for i in range(40)]
    docs += [(60, None), (61, ""), (None, bench[0][1]), docs[5], (5, "another text of the same id"), (62, "lone"), (63, " ".join([line(4000), bench[7][1]]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert result(decontamination.query(documents(docs, **CLASH), b)) == brute_decontamination(docs, bench)
    one = bench + [(34, "zz")]
    b = spark.createDataFrame(one, "item_id long, text string")
    assert result(decontamination.query(documents(docs), b)) == brute_decontamination(docs, one)
    assert decontamination.query(documents([]), b).count() == 0
    assert not any(r["contaminated"] for r in decontamination.query(documents(docs), b.where(F.lit(False))).collect())


def test_decontamination_survives_long_texts_and_large_benchmarks(spark, documents):
    """A one-word item, over 20,000 beginnings, and texts of 20,000 words: memory follows the text."""
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(12_000)] + [(12_000, "lone")]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=20_000), bench[i][1], "lone"])) for i in range(3)]
    assert result(decontamination.query(documents(docs), spark.createDataFrame(bench, "item_id long, text string"))) == brute_decontamination(docs, bench)


def test_decontamination_clean_judges_rows_by_their_text(spark, documents):
    text = " ".join(f"a{i}" for i in range(12))
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = documents([(1, "clean one"), (1, text), (None, "clean two"), (None, text.upper()), (2, None), (3, ""), (1, "clean one")], _bad="x", d1=1, e1=2)
    kept = decontamination.clean(docs, b)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "clean one")] * 2 + [(None, "clean two"), (2, None), (3, "")], key=str)
    assert decontamination.clean(documents([]), b).count() == 0


# Mixing.


def brute_targets(sizes, passes=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > passes * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(passes * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["hot"] * 6 + ["b", "c", None, "É", ""])) for i in range(300)]
    rows += [(None, "a b c", "b"), (7, None, "c"), rows[3], rows[3], (400, "x", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("skey", F.lit(1)).withColumn("w", F.lit("x"))
    mixed = mixing.mix(docs)
    got = mixed.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= len(sizes) for s in sizes)
    assert sum(taken.values()) == sum(sizes.values())  # the queue is cut at the budget
    # Closed form: at virtual time 1 each source has had its target.
    order = defaultdict(list)
    for i, t, s in rows:
        h = hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()
        order[s].append((h, i is not None, i or 0, len(WORD.findall(t or ""))))
    exact = Counter()
    for s, found in order.items():
        at = 0
        for *_, n in sorted(found):
            exact[s, n] += sum(min(n, max(0, math.ceil(targets[s]) - at - c * sizes[s])) for c in range(3))
            at += n
    close = Counter()
    for r in got:
        close[r["source"], r["size"]] += r["taken"]
    assert sum(abs(exact[k] - close[k]) for k in exact.keys() | close.keys()) < len(sizes)
    assert result(mixing.query(docs)) == result(mixing.query(docs.repartition(3)))
    plan = mixing.schedule(mixing.queue(docs)).collect()
    assert [r["finish"] for r in plan] == sorted(r["finish"] for r in plan) and plan[-1]["finish"] <= 1
    words = Counter()
    for r in plan:
        words[r["source"]] += r["words"]
    assert words == +taken
    assert mixing.query(docs.where(F.lit(False))).count() == 0
    assert {r["taken"] for r in mixing.query(docs.where("text is null or text = ''")).collect()} == {0}


# Secrets.


def test_windows_entropy():
    for text in ("abcabc" * 5, "a" * 30, "".join(random.Random(1).choices("abcdef0123", k=60))):
        fast = list(secrets.windows_entropy(text, 20, secrets.log_table(21)))
        slow = [-sum(c / 20 * math.log2(c / 20) for c in Counter(text[i : i + 20]).values()) for i in range(len(text) - 19)]
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(fast, slow, strict=True))


def brute_secrets(t):
    t = t or ""
    spans = []
    name = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    spans += [(m.start(), 0, m.end()) for m in re.finditer(name + "[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(documents):
    rng = random.Random(6)
    some = ["password = 'hunter22'", "TOKEN:abc", "Api_Key=\"a.b-c/d=\"", "token=token: value99", "ſecret=abcdefgh", "AKIA" + "A1B2" * 4, "AKIA12", "deadbeef" * 3, "0" * 40, "é",
            "secret\x20\x20:\x20x12345", "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=44)), "123e4567-e89b-12d3-a456-426614174000", "averyveryverylongidentifier_name"]
    rows = [(i, rng.choice(["", "é ", "x "]) + rng.choice([" ", "\n", ""]).join(rng.choices(some, k=rng.randint(0, 8)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, some[0]), rows[0], (102, "z " * 50_000 + some[0]), (103, some[11]), (104, some[12]), (105, some[13])]
    got = {(r["doc_id"], r["spans"]): r for r in secrets.query(documents(rows, **CLASH)).collect()}
    by_id = {i: r for (i, _), r in got.items()}
    for i, t in rows:
        base, r = brute_secrets(t), by_id[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        listed = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == sha(",".join(listed))
        assert [x for x in r["spans"].split(",") if x and not x.startswith("entropy")] == listed
    assert by_id[103]["spans"].startswith("entropy:") and not by_id[104]["spans"] and not by_id[105]["spans"]
    assert secrets.query(documents([])).count() == 0


def test_secrets_take_linear_time():
    """Rulers, words run together and repeated characters must not make the allow-list backtrack."""
    scanner = secrets.Scanner()
    began = time.perf_counter()
    for text in ("-" * 10_000 + "7", "a_" * 10_000 + "7", "=/+" * 5_000 + "0", "A" * 20_000 + "-1", "token" + " " * 20_000 + "x", "secret" * 5_000):
        scanner.scan(text)
    assert time.perf_counter() - began < 5


def brute_entropy(t, width=20):
    """Windows of ``width`` characters over the limit, counted anew for each, in candidates that no rule allows."""
    spans = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or ""):
        w = m[0]
        plain = all(c.isalpha() or c in "_/=+-" for c in w) or w.isdigit() or len(set(w)) == 1
        uuid = [len(x) for x in w.split("-")] == [8, 4, 4, 4, 12] and all(c in "0123456789abcdefABCDEF-" for c in w)
        known = any(x in w for x in ("EXAMPLE", "example", "0123456789", "abcdefgh", "ABCDEFGH"))
        if plain or uuid or known:
            continue
        limit = 3.0 if all(c in "0123456789abcdefABCDEF-" for c in w) else 3.8
        hot = [i for i in range(len(w) - width + 1) if -sum(n / width * math.log2(n / width) for n in Counter(w[i : i + width]).values()) >= limit - 1e-12]
        runs = []
        for i in hot:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + width
            else:
                runs.append([i, i + width])
        spans += [(m.start() + a, 3, m.start() + b) for a, b in runs]
    return spans


def test_entropy_spans_match_brute_force():
    rng = random.Random(10)
    pieces = ["a" * 15, "-" * 12, "deadbeef", "0123456789", "example", "word_word", "".join(rng.choices("abcdef0123456789", k=30)), "123e4567-e89b-12d3-a456-426614174000", "x"]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    scanner, found = secrets.Scanner(), 0
    for _ in range(600):
        t = rng.choice([" ", "", "\n"]).join(rng.choice([*pieces, "".join(rng.choices(letters, k=rng.randint(5, 40)))]) for _ in range(rng.randint(1, 6)))
        assert scanner.entropy(t) == brute_entropy(t), t
        found += len(scanner.entropy(t))
    assert found > 200


# Media.


def boxes(data):
    """Offset and size of sync samples, and the codec, found by the names of the tables instead of a walk."""
    at = lambda kind: data.index(kind, 0, data.index(b"mdat")) + 4
    numbers = lambda start, n: [int.from_bytes(data[start + 4 * k : start + 4 * k + 4]) for k in range(n)]
    size, n = numbers(at(b"stsz") + 4, 2)
    first = numbers(at(b"stco") + 8, 1)[0]
    sync = numbers(at(b"stss") + 8, numbers(at(b"stss") + 4, 1)[0])
    return [(first + (k - 1) * size, size) for k in sync], n  # all chunks lie end to end


def test_media(documents):
    rows = [(0, None), (1, ""), (2, "x" * 192), (3, "é" * 97), (4, "long " * 60_000), (5, ""), (None, "id"), (2, "x" * 192)]
    out = media.query(documents(rows, **CLASH)).collect()
    assert len(out) == len(rows)
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = next(r for r in out if r["doc_id"] == i)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        stored = media.write(payload)
        keys, n = boxes(stored)
        assert stored.endswith(payload) and [stored[a : a + k] for a, k in keys] == [payload[192 * x : 192 * x + 192] for x in range(0, n, 25)]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), sha(stored))
        assert r["feature"] == f"codec=raw;seconds={n / 25:.2f};samples={n};keyframes=" + ",".join(f"{a}+{k}" for a, k in keys)
    same = [r[1:] for r in out if r["doc_id"] in (0, 1, 5)]
    assert len(set(same)) == 1
    assert media.query(documents([])).count() == 0


def test_media_that_cannot_be_read(spark):
    whole = media.write(b"x" * 19200)
    mute = whole.replace(b"stss", b"free", 1)  # without the table every sample is a sync sample
    rows = [(1, None), (2, whole[:-10]), (3, b""), (4, b"not a media file"), (5, mute), (6, whole), (None, whole.replace(b"stsz", b"free", 1))]
    df = spark.createDataFrame([(i, 0, None if m is None else bytearray(m)) for i, m in rows], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.read_back(df.withColumn("keyframes", F.lit(1))).collect()}
    assert all(got[i]["error"] and got[i]["payload_bytes"] is None for i in (1, 2, 3, 4, None))
    assert got[2]["media_bytes"] == len(whole) - 10 and got[1]["media_bytes"] is None
    assert len(got[5]["keyframes"]) == 100 and len(got[6]["keyframes"]) == 4 and got[6]["error"] is None and got[6]["codec"] == "raw"


def test_media_container():
    payload = bytes(random.Random(0).randbytes(192 * 1300))
    stored = media.write(payload)
    track = media.Track(stored)
    assert track.payload() == payload and track.codec == "raw " and len(track.sizes) == 1300 and track.duration == 1300
    keys = track.keyframes()
    assert len(keys) == 52 and all(stored[a : a + n] == payload[25 * k * 192 : 25 * k * 192 + 192] for k, (a, n) in enumerate(keys))
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in [p for p, _, _ in media.walk(memoryview(stored))]
    with pytest.raises(ValueError):
        media.write(b"odd")
    with pytest.raises(ValueError):
        list(media.walk(memoryview(stored[:-5])))


# Quality.


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.query(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    truth = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in truth) / len(truth) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.query(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}  # held-out labels are never seen
    kept = quality.clean(docs.withColumn("score", F.lit("x")), labels)
    assert kept.columns == [*docs.columns, "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_quality_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "good text here"), (2, None), (3, ""), (None, "none"), (4, "w" * 600_000), (1, "good text here")]
    out = quality.query(documents(rows, **CLASH), labels).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
    assert {r["score"] for r in quality.query(documents(rows), labels.where(F.lit(False))).collect()} == {0.5}
    assert quality.query(documents([]), labels).count() == 0


# Substrings.


def brute_substrings(rows, length):
    places = Counter()
    for _, t in rows:
        w = WORD.findall(t or "")
        places.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k for s in range(len(w) - length + 1) if places[tuple(w[s : s + length])] > 1 for k in range(s, s + length)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, gram, vocabulary, screened", [(6, 3, 12, 1 << 25), (6, 2, 3, 0), (5, 5, 8, 1 << 25)])
def test_substring_dedup(documents, monkeypatch, length, gram, vocabulary, screened):
    monkeypatch.setattr(repeats, "SCREENED", screened)
    found = texts(vocabulary, vocabulary=vocabulary, longest=40, sep="  ")
    rows = list(enumerate(found)) + [(2, found[2]), (None, found[3]), (None, "alone")]
    df = substring_dedup.dedup(documents(rows, **CLASH), length, gram)
    got = df.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256))
    assert result(got) == brute_substrings(rows, length)


def test_substring_dedup_empty(documents):
    assert substring_dedup.query(documents([])).count() == 0
    assert [tuple(r)[1:3] for r in substring_dedup.query(documents([None, ""])).collect()] == [(0, 0)] * 2


# Suffixes.


def brute_suffixes(rows, length):
    seen, out = set(), []
    done = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if (i, t) not in done:
            data = (t or "").encode()
            gone = set()
            for s in range(len(data) - length + 1):
                w = data[s : s + length]
                if w in seen:
                    gone |= set(range(s, s + length))
                seen.add(w)
            spans = sum(k - 1 not in gone for k in gone)
            done[i, t] = (i, len(data), len(gone), spans, sha(bytes(c for k, c in enumerate(data) if k not in gone)))
        out.append(done[i, t])
    return sorted(out, key=str)


@pytest.mark.parametrize("length, gram, group, alphabet, screened", [(20, 8, 2000, "ab é", 1 << 25), (20, 8, 1, "abcdef ", 1 << 25), (12, 12, 2000, "abc", 0), (9, 4, 3, "a", 0), (20, 8, 2, "ab é", 0)])
def test_suffix_dedup(documents, monkeypatch, length, gram, group, alphabet, screened):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(repeats, "SCREENED", screened)
    rng = random.Random(length)
    piece = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(15)]
    rows = [(i, "".join(rng.choices(piece, k=rng.randint(0, 6)))) for i in range(50)]
    rows += [(60, None), (61, ""), (None, rows[1][1]), rows[7], (62, "".join(rng.choices(piece, k=400))), ((1 << 63) - 1, rows[2][1]), (None, rows[3][1])]
    df = suffix_dedup.dedup(documents(rows, **CLASH), length, gram)
    assert result(df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == brute_suffixes(rows, length)


def test_suffix_dedup_splits_crowded_anchors(documents):
    """One phrase in over 4,000 different surroundings, the ends of a passage among them."""
    rng = random.Random(12)
    phrase, passage = "a phrase of over a hundred bytes " * 4, "".join(rng.choices("abcdefghij ", k=70))
    rows = [(i, f"{rng.random()}{passage[: rng.randint(40, 70)]}{rng.random()} {phrase[: rng.randint(60, 132)]}{rng.random()}") for i in range(4_500)]
    got = suffix_dedup.dedup(documents(rows), 60, 20).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    want = brute_suffixes(rows, 60)
    assert result(got) == want and sum(r[2] for r in want) > 100_000


def test_suffix_dedup_empty(documents):
    assert suffix_dedup.query(documents([])).count() == 0


def test_prefix_free_parsing():
    import numpy as np

    rng = random.Random(8)
    for alphabet in ("ab", "abcdefghij", "a"):
        found = [bytes("".join(rng.choices(alphabet, k=rng.randint(0, 90))), "ascii") for _ in range(40)]
        found += found[:5]
        places = np.array([i * 1000 for i in rng.sample(range(45), 45)])
        text, start = earlier_runs(found, places, 17)
        least = {}
        for i, t in enumerate(found):
            for s in range(len(t) - 16):
                least[t[s : s + 17]] = min(least.get(t[s : s + 17], 1 << 60), places[i] + s)
        want = [(i, s) for i, t in enumerate(found) for s in range(len(t) - 16) if places[i] + s > least[t[s : s + 17]]]
        assert list(zip(text.tolist(), start.tolist(), strict=True)) == want


# WARC.


def brute_warc(rows, least=0):
    keeper = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= least and i is not None:
            keeper[data] = max(i, keeper.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        k = keeper.get(data) if len(data) >= least else None
        kind = "response" if k is None or i == k else "revisit"
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, k if kind == "revisit" else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n\r\nx"), (2, None, None), (3, "u\r\nX-Page-Id: 9", ""), (4, "u", "<p>é\r\n\r\nWARC/1.1\r\n\r\nx"), (5, "v", "y" * 300_000),
    (None, "w", "same"), (6, "w", "same"), (7, "w", "only"), (None, "w", "nobody"), (6, "w", "same"), (8, "w", "\r\n\r\n"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha256", F.lit("x"))
    out = warc.archive(pages, least).cache()
    assert result(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == brute_warc(PAGES, least)
    for r in out.collect():
        assert bytes(r["head"]).startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in out.collect()} == {(i, h or "") for i, _, h in PAGES}
    assert warc.query(pages.where(F.lit(False))).count() == 0


def test_warc_stores_a_payload_once(spark):
    from driftfield.llm.common import new_path

    path = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    payloads, heads = warc.store(warc.read(spark, path))
    assert payloads.count() == len({h or "" for _, _, h in PAGES}) and heads.count() == len(PAGES)
    data = b"".join(gzip.decompress(bytes(r[0])) for r in spark.read.format("binaryFile").load(path).select("content").collect())
    records = list(warc.parse(io.BytesIO(data)))
    assert len(records) == len(PAGES)
    assert b"".join(r.head + (r.payload or b"") + b"\r\n\r\n" for r in records) == data  # exact bytes
    assert sorted(bytes(r["head"]) for r in heads.collect()) == sorted(r.head for r in records)
    for bad in (data.replace(b"yyyy", b"yyyz", 1), data[:-3], data[5:], data[: len(data) // 2]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))
    lone = warc.reconstruct(payloads.where(F.lit(False)), heads)
    assert lone.count() == len(PAGES) and {r["payload"] for r in lone.collect()} == {None}


def test_warc_files_are_bounded_in_bytes(spark, monkeypatch):
    from driftfield.llm.common import new_path

    monkeypatch.setattr(warc, "CLASSES", ((1000, 8), (10_000, 2)))
    pages = [(i, "u", "p" * n + str(i)) for i, n in enumerate([10] * 30 + [5_000] * 5 + [50_000] * 3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc-test")
    warc.write(df, path)
    files = [gzip.decompress(bytes(r[0])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()]
    assert max(len(list(warc.parse(io.BytesIO(f)))) for f in files) == 8
    assert max(map(len, files)) < 52_000 and sum(len(f) > 20_000 for f in files) == 3
    assert result(warc.query(df)) == brute_warc(pages)
