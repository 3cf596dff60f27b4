from __future__ import annotations

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from driftfield.llm import simhash
from driftfield.llm.components import components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius=2):
    label = {i: i for i in range(len(items))}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(items):
            for j, (_, b) in enumerate(items):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            least[label[i]] = min(doc, least.get(label[i], doc))
    return [least.get(label[i]) for i in range(len(items))]


def test_masks_cover_every_pair():
    for radius in (1, 2):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        for a in range(64):
            for b in range(64) if radius == 2 else [a]:
                assert any(not m >> a & 1 and not m >> b & 1 for m in masks)
    rng = random.Random(1)
    for radius in (3, 4):
        masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
        for _ in range(2000):
            places = rng.sample(range(64), radius)
            assert any(not any(m >> a & 1 for a in places) for m in masks)


def test_groups_match_brute_force(spark, documents):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(50)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    texts += texts[:10] + ["", None, "one", "One two", "one\ttwo", " x\x0by  z ", "É é É É"]
    long = rng.choices(vocabulary, k=40_000)
    for i in range(6):  # near copies
        changed = list(long)
        changed[i * 100] = "new"
        texts.append(" ".join(changed))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "alone without an id")]
    got = sorted(map(tuple, simhash.groups(documents(rows, fp=1, key="x", u=2)).collect()), key=str)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = [(i, fp - (1 << 64) if fp >> 63 else fp, c) for (i, fp), c in zip(prints, brute_components(prints), strict=True)]
    assert got == sorted(want, key=str)
    assert len({fp for _, fp, _ in got}) < len({t for _, t in rows})


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_find_chains_and_stars(spark, radius):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for x in base[:10]:
        for _ in range(12):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(x)
    fps |= {base[0] ^ 1 << i for i in range(64)}
    items = sorted((x - (1 << 64) if x >> 63 else x) for x in fps)
    df = spark.createDataFrame([(x,) for x in items], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, radius)).collect()}
    want = brute_components([(x, x & (1 << 64) - 1) for x in items], radius)
    assert {x: found.get(x, x) for x in items} == dict(zip(items, want, strict=True))


def test_clean_keeps_one_of_each_group(documents):
    text = "a b c d e f g h i j"
    docs = documents([(5, text), (2, text), (9, text.upper()), (4, "something else here"), (7, None), (8, "")], extra="x")
    kept = simhash.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 7]
    assert simhash.groups(docs.where(F.lit(False))).count() == 0


def test_clean_with_null_and_repeated_ids(documents):
    """Copies go whatever their ids; a second text of a kept id stays or goes by itself."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = documents([(1, a), (None, a), (None, b), (2, a), (2, c), (3, c), (None, None), (None, ""), (1, a)], _head="x", d1=1, head=2)
    kept = simhash.clean(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert got == Counter({(1, a): 2, (None, b): 1, (2, c): 1, (None, ""): 1})
