"""Queries and operators that once left rows out act on all of them."""

from __future__ import annotations

import random

from driftfield.plans import catalogue, overdamped
from driftfield.sources.tables import compress_particles
from tests.conftest import SF


def first_fit(tracks):
    """{(dataset, particle): column} of tracks (dataset, particle, frames), by trying every column in turn."""
    found, columns = {}, {}
    for dataset, particle, frames in sorted(tracks, key=lambda x: (x[0], min(x[2]), x[1])):
        ends = columns.setdefault(dataset, [])
        slot = next((i for i, end in enumerate(ends) if end <= min(frames) - 2), len(ends))
        ends[slot : slot + 1] = [max(frames)]
        found[dataset, particle] = slot
    return found


def test_packing_matches_brute_force(spark):
    rng = random.Random(4)
    tracks = []
    for particle in range(150):
        start = rng.randint(0, 200)
        tracks.append((particle % 3, particle, sorted(rng.sample(range(start, start + 30), rng.randint(1, 8)))))
    rows = [(d, p, t) for d, p, frames in tracks for t in frames]
    packed = compress_particles(spark.createDataFrame(rows, "dataset_id int, particle_id long, time_idx long")).collect()
    want = first_fit(tracks)
    assert sorted((r["dataset_id"], r["original_particle_id"], r["time_idx"], r["particle_id"]) for r in packed) == sorted((d, p, t, want[d, p]) for d, p, t in rows)
    assert len(set(want.values())) < 50


def test_compress_particles_packs_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    frames = {}
    for r in orders:
        frames.setdefault((r["o_custkey"] % 5, r["o_custkey"]), []).append(r["o_orderkey"] // 4)
    want = {}
    for (dataset, customer), slot in first_fit([(d, c, f) for (d, c), f in frames.items()]).items():
        tracks, n = want.get((dataset, slot), (0, 0))
        want[dataset, slot] = tracks + 1, n + len(frames[dataset, customer])
    got = {(r["dataset_id"], r["particle_id"]): (r["tracks"], r["n"]) for r in catalogue.QUERIES["compress_particles"](spark, SF).collect()}
    assert got == want
    assert sum(n for _, n in got.values()) == len(orders)


def test_every_event_is_predicted(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalogue.QUERIES["predict_ci_all"](spark, SF).count() == events
    assert catalogue.QUERIES["predict_ci_p2"](spark, SF).count() < events  # its SQL has the prefix


def test_every_dataset_has_its_gram_entry(spark):
    series = {}
    for r in overdamped.events(spark, SF).select("dataset_id", "t").collect():
        series.setdefault(r["dataset_id"], []).append(r["t"])
    want = {k: max(t) - min(t) for k, t in series.items()}
    got = {r["dataset_id"]: r["g"] for r in catalogue.QUERIES["dataset_indicator_gram_all"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 3
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
