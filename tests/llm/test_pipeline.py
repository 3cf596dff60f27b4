"""Every stage of the pipeline, and the classifier, against plain versions that share no code with them."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import test_near
import test_operators

from driftfield.llm import mixing, quality
from driftfield.llm.common import table

SF = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1
PHI, BASE = 0x9E3779B97F4A7C15, 0x243F6A8885A308D3


def bucket(value, bits):
    return ((value ^ value >> 29) * PHI & FULL) >> (64 - bits)


def plain_features(text, bits):
    """Buckets of words, of words said twice in a row, and of 3- and 4-character runs without white space inside, one by one."""
    text = "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text or "")
    code = [(ord(c) + 1) * PHI & FULL for c in text]
    out, last, at = [0], None, 0
    while at < len(text):
        if text[at] == " ":
            at += 1
            continue
        end = at
        while end < len(text) and text[end] != " ":
            end += 1
        value = sum(code[k] * pow(BASE, k - at, 1 << 64) for k in range(at, end)) & FULL
        out += [bucket(value, bits)] + [1] * (text[at:end] == last)
        last, at = text[at:end], end
    for n in (3, 4):
        for i in range(len(text) - n + 1):
            if " " not in text[i + 1 : i + n - 1]:
                value = n
                for k in range(n):
                    value = (value * BASE + code[i + k]) & FULL
                out.append(bucket(value, bits))
    return out


def plain_score(model, text):
    found = plain_features(text, model.bits)
    return 1 / (1 + math.exp(-sum(float(model.slope[k]) for k in found) / len(found)))


def plain_train(rows, bits, dim=8, epochs=6, rate=1.0, seed=1):
    """Softmax over the mean of a document's vectors, one document and one number at a time."""
    rng = np.random.default_rng(seed)
    vectors = {k: [float(x) for x in v] for k, v in enumerate(rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)))}
    classes, step = [[0.0] * dim for _ in range(2)], 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, text = rows[i]
            counts = Counter(plain_features(text, bits))
            total = sum(counts.values())
            mean = [sum(n / total * vectors[k][d] for k, n in counts.items()) for d in range(dim)]
            logits = [sum(c * x for c, x in zip(row, mean, strict=True)) for row in classes]
            p = [math.exp(x - max(logits)) for x in logits]
            error = [x / sum(p) - (label == k) for k, x in enumerate(p)]
            back = [sum(error[k] * classes[k][d] for k in range(2)) for d in range(dim)]
            now = rate * (1 - step / (epochs * len(rows)))
            classes = [[c - now * error[k] * mean[d] for d, c in enumerate(row)] for k, row in enumerate(classes)]
            for k, n in counts.items():
                vectors[k] = [x - now * math.sqrt(len(counts)) * n / total * back[d] for d, x in enumerate(vectors[k])]
            step += 1
    return [sum(v * (classes[1][d] - classes[0][d]) for d, v in enumerate(vectors[k])) for k in range(1 << bits)]


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["good", "prose", "flows", "été", "buy", "now", "now", "!!!", "x", "日本語", "cheap"]
    return [rng.choice([" ", "\n", "  "]).join(rng.choices(words[k % 2 * 4 :], k=rng.randint(0, 12))) for k in range(n)] + [" ", "\t ab\tc ", "é"]


def test_features_match_plain_ones():
    for text in some_texts(1, 60):
        found = np.concatenate([[0], *(quality._features(b, 12) for b in quality.blocks(text))])
        assert sorted(found.tolist()) == sorted(plain_features(text, 12)), text


def test_training_matches_a_plain_loop():
    rows = [(k % 2, t) for k, t in enumerate(some_texts(2, 24))]
    model = quality.train([(label, *quality.bag(t, 8)) for label, t in rows], 8, dim=4, epochs=3)
    want = plain_train(rows, 8, dim=4, epochs=3)
    assert np.allclose(model.slope, want, rtol=1e-3, atol=1e-4)
    for t in some_texts(3, 20):
        assert math.isclose(model.score(t), plain_score(model, t), rel_tol=1e-5)


def test_held_out_ranking(spark):
    """Area under the ROC curve over the held-out labels, by counting pairs."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.query(docs, labels).collect()}
    held = [(r["quality"], scores[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.98


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_quality(rows, spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    return [r for r in rows if plain_score(model, r[1]) >= 0.3]


def one_edit(a, b):
    """Whether what is left between the common beginning and the common end is one character at most."""
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] in (b[i + 1 :], b[i:])


def plain_lines(rows, *_):
    """In order of documents, a line stays unless an earlier one is within one edit of it; blank lines stay."""
    seen, left = defaultdict(list), {}
    for r in sorted(rows):
        kept = []
        for line in r[1].split("\n"):
            if line.strip(" "):
                near = any(one_edit(s, line) for n in (-1, 0, 1) for s in seen[len(line) + n])
                seen[len(line)].append(line)
                if near:
                    continue
            kept.append(line)
        left[r[0]] = "\n".join(kept)
    return [(r[0], left[r[0]], *r[2:4], len(left[r[0]])) for r in rows]


def plain_near(rows, *_):
    component = dict(test_near.brute([(r[0], r[1]) for r in rows]))
    return [r for r in rows if component[r[0]] == r[0]]


def plain_leaks(rows, spark, _):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in test_operators.brute_decontamination([(r[0], r[1]) for r in rows], bench) if r[5]}
    return [r for r in rows if r[0] not in hit]


STAGES = {"quality": plain_quality, "line_dedup": plain_lines, "near_copies": plain_near, "decontamination": plain_leaks}


def test_stages_match_plain_ones(spark):
    """On whole tables: each stage is judged on what the one before it left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = table(stage(spark, docs, SF), f"test-{name}")
        assert rows_of(out) == sorted(STAGES[name](before, spark, docs), key=str), name
        docs = out
    mixed = {r["doc_id"]: r["taken"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    left = docs.collect()
    assert mixed.keys() == {r["doc_id"] for r in left}
    sizes, taken = Counter(), Counter()
    for r in left:
        sizes[r["source"]] += len(test_operators.WORD.findall(r["text"]))
        taken[r["source"]] += mixed[r["doc_id"]]
    targets = test_operators.brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= len(sizes) for s in sizes) and sum(taken.values()) == sum(sizes.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_documents(spark, documents, name):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names, and none at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    long = "\n".join(f"line {i} " + "word " * 50 for i in range(300))
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (None, None), (3, ""), (4, long), (5, long), (6, "\n\n"), (1, "d e f g")]
    docs = documents(rows).unionByName(documents([(9, "nulls beside it")]).selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars"))
    extra = docs.selectExpr("*", "1 d1", "'x' kept", "2 size", "3 root", "4 score", "5 head")
    out = stage(spark, extra, SF)
    if name == "mixing":
        assert out.count() == len(rows) + 1
    else:
        assert out.columns == list(corpus_pipeline.COLUMNS) and 0 < out.count() <= len(rows) + 1
    assert stage(spark, documents([]), SF).count() == 0


def test_queue_is_in_one_order(spark, documents):
    docs = documents([(i, "w " * (i % 40)) for i in range(400)])
    assert rows_of(mixing.query(docs)) == rows_of(mixing.query(docs.repartition(7)))
