"""Crowded tracks: blocks of tracks give what the grid and the joins give."""

from __future__ import annotations

import numpy as np

from obsfuse.operators import joins, tracks

CFG = tracks.AssociationConfig(distance=1.0, distance_scale=0.7, minimum_support=0.3)


def _tracks(spark, first: int, n: int, seed: int):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(first, first + n):
        for frame in range(4):
            if rng.random() < 0.8:
                for _ in range(2 if rng.random() < 0.1 else 1):
                    p = None if rng.random() < 0.1 else float(rng.random())
                    rows.append((t, frame, *map(float, 2 * rng.random(3)), p))
    rows.append((None, 0, 1.0, 1.0, 1.0, 0.5))
    return spark.createDataFrame(rows, "track_id long, frame long, x double, y double, z double, association_probability double")


def _rounded(df):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("left_id", "right_id", "shared_frames", "support", "maximum_distance", "rms", "score").collect())


def test_blocks_equal_the_grid(spark, monkeypatch):
    monkeypatch.setattr(tracks, "PAIR_BLOCK", 7)
    left, right = _tracks(spark, 0, 30, 1), _tracks(spark, 100, 25, 2)
    blocks = tracks.candidate_scores(left, right, CFG)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pairs are compared in place
    monkeypatch.setattr(tracks, "_crowded", lambda *_: (False, 0, 0))
    assert str(_rounded(blocks)) == str(_rounded(tracks.candidate_scores(left, right, CFG)))


def test_links_of_the_best_pairs_equal_links_of_all(spark):
    left, right = _tracks(spark, 0, 40, 3), _tracks(spark, 100, 35, 4)
    some, every = tracks.candidate_scores(left, right, CFG, best=True), tracks.candidate_scores(left, right, CFG)
    assert some.count() < every.count()
    got, want = (sorted(map(str, tracks.mutual_links(c, CFG).collect())) for c in (some, every))
    assert got == want and got


def test_gated_pairs_of_crowded_tracks_are_not_shuffled(spark):
    left, right = _tracks(spark, 0, 30, 5), _tracks(spark, 100, 25, 6)
    got = tracks.gated_pairs(left, right, 1.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    known = [df.where("track_id IS NOT NULL") for df in (left, right)]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joins.spatial_pairs(*known, 1.0).collect()))
