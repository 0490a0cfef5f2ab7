"""Candidates are ranked from arrays: no pair is a row of a shuffle, and no window sorts them."""

import numpy as np

from obsfuse.functions.vec3 import SYM
from obsfuse.operators import tracks
from obsfuse.plans.catalogue import REGISTRY


def test_places_equal_a_window_over_pairs(spark, monkeypatch):
    monkeypatch.setattr(tracks, "PAIR_BLOCK", 5)
    rng = np.random.default_rng(9)
    rows = []
    for t in range(30):
        for frame in range(3):
            a = rng.normal(size=(3, 4))
            weight = float(rng.integers(1, 3))  # equal weights and points: scores tie
            rows.append(("c", "ab"[t % 2], t, frame, *map(float, rng.integers(0, 2, 3)), weight, rng.normal(size=21).tolist(), *(a @ a.T + np.eye(3))[np.triu_indices(3)].tolist()))
    df = spark.createDataFrame(rows, "case_id string, window_id string, track_id long, frame long, x double, y double, z double, association_probability double, jacobian array<double>, " + ", ".join(f"k_{s} double" for s in SYM))
    joint = np.eye(14)
    blocks = [("c", p, q, joint[7 * i : 7 * i + 7, 7 * k : 7 * k + 7].ravel().tolist()) for i, p in enumerate("ab") for k, q in enumerate("ab")]
    blocks = spark.createDataFrame(blocks, "case_id string, window_i string, window_j string, block array<double>")
    left, right = df.where("track_id % 2 = 0"), df.where("track_id % 2 = 1")
    cfg = tracks.AssociationConfig(distance=1.5, distance_scale=0.7)
    got = tracks.ranked_link_evidence(left, right, blocks, cfg)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tracks, "_crowded", lambda *_: (False, 0, 0))
    want = tracks.ranked_link_evidence(left, right, blocks, cfg)
    key = ["left_id", "place"]
    a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(a) > 100 and a[[*key, "right_id"]].astype(int).equals(b[[*key, "right_id"]].astype(int))
    assert a.groupby("left_id")["score"].agg(lambda s: s.round(9).duplicated().any()).any()
    np.testing.assert_allclose(a.to_numpy(float), b[a.columns].to_numpy(float), rtol=1e-8)


def test_query_sorts_no_pairs(spark):
    plan = REGISTRY["joint_link_evidence"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "array<double>" not in plan.split("\n")[0]
