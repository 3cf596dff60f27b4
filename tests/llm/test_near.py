from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from driftfield.llm import near, simhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label, changed = list(range(len(rows))), True
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 10 * len(a & b) >= 8 * len(a | b)]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    least = {}
    for (doc, _), c in zip(rows, label, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return [(doc, least.get(c)) for (doc, _), c in zip(rows, label, strict=True)]


def corpus(seed):
    """Chains of edits, a crowd of near copies, a passage that all share, exact thresholds, and texts of few or no words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(300)]
    shared = rng.choices(vocabulary, k=40)
    texts = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        at = rng.randint(0, len(words))
        texts.append(words[:at] + shared + words[at:])
        for _ in range(rng.randint(0, 4)):
            words = list(texts[-1])
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
    base = rng.choices(vocabulary, k=100)
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(words)
    edge = [f"e{i}" for i in range(14)]  # 10 shingles; 8 and 7 of them in the others
    texts += [edge, edge[:12], edge[:11], edge[3:]]
    rows = list(enumerate(" ".join(x) for x in texts)) + [(3, " ".join(texts[3])), (None, " ".join(texts[4])), (None, "alone without an id")]
    rows += [(900 + i, t) for i, t in enumerate(["", None, "one", "One", "one two", "a b c d", "A  b\tc d", " \x0b "])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds, sample", [(4, 8_000), (0, 8_000), (4, 1)])
def test_groups_match_brute_force(documents, monkeypatch, rounds, sample):
    monkeypatch.setattr(near, "ROUNDS", rounds)
    monkeypatch.setattr(near, "SAMPLE", sample)
    monkeypatch.setattr(near, "LEAST_MOVED", 1 if rounds == 0 else 1 << 24)  # pairs in several parts
    rows = corpus(rounds)
    got = [tuple(r) for r in near.groups(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_pipeline_stage_drops_near_copies(spark, documents):
    words = [f"word{i}" for i in range(120)]
    other = [*words[:40], "changed", *words[41:80], "again", *words[81:]]  # 10 of 116 shingles differ: 0.84
    far = [w if i % 12 else f"far{i}" for i, w in enumerate(words)]
    docs = documents([(4, " ".join(words)), (2, " ".join(other)), (7, " ".join(far))])
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7]


def test_clean_with_null_and_repeated_ids(documents):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = documents([(1, a), (None, a), (None, b), (2, a), (2, b + " end"), (1, a)], root="x", id=3, d1=4)
    kept = near.clean(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (1, a), (2, b + " end")]


def test_empty(documents):
    assert near.groups(documents([(1, "a b")]).where(F.lit(False))).count() == 0


def test_bitmaps_rule_out_long_sets(documents):
    """Long texts that share a passage only move no whole sets; similar ones do, on both sides of a bitmap's size."""
    rng = random.Random(7)
    fresh = lambda n: [f"v{rng.random()}" for _ in range(n)]
    shared, base = fresh(300), fresh(4090)
    texts = [fresh(2700) + shared, shared + fresh(2500), base, base + fresh(300)]
    sets = near.prefixes(near.texts_of(documents([" ".join(x) for x in texts])), 5, 80)
    ids = {r["doc_id"]: (r["id"], r["n"], len(r["bits"])) for r in sets.collect()}
    assert ids[2][2] < ids[3][2]
    pairs = sets.sparkSession.createDataFrame([(ids[a][0], ids[b][0]) for a, b in ((0, 1), (2, 3), (0, 2))], "u long, v long")
    got = [tuple(r) for r in near.possible(pairs, sets, 80).collect()]
    assert got == [(ids[2][0], ids[3][0], ids[2][1] + ids[3][1])]


def test_simhash_links_come_first(documents, monkeypatch):
    """All sets with fingerprints within the radius are connected by what SimHash hands on, and the stage goes through it."""
    rng = random.Random(5)
    words = [f"n{i}" for i in range(900)]
    texts = [[w if rng.random() > 0.002 else f"x{rng.random()}" for w in words] for _ in range(12)] + [[f"o{rng.random()}" for _ in range(50)] for _ in range(5)]
    docs = documents([" ".join(x) for x in texts])
    rows = near.prefixes(near.texts_of(docs), 5, 80).collect()
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), texts, strict=True):
        keys = [int(k) for k in near.shingle_set(" ".join(text).encode(), 5)]
        assert r["fp"] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(k >> b & 1 for k in keys) > len(keys))
    prints = {r["id"]: r["fp"] % (1 << 64) for r in rows}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= near.RADIUS]
    assert close
    sets = docs.sparkSession.createDataFrame([(r["id"], r["fp"]) for r in rows], "id long, fp long").distinct()
    label = {k: k for k in prints}
    for u, v in [tuple(r) for r in near.nearest(sets, near.RADIUS).collect()] * len(prints):
        label[u] = label[v] = min(label[u], label[v])
    assert all(label[a] == label[b] for a, b in close)
    used, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: used.append(a[1]) or links(*a))
    assert dict(corpus_pipeline.STAGES)["near_copies"](sets.sparkSession, docs, "").count() == 6
    assert used == [near.RADIUS]
