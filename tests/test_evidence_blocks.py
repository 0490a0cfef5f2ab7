"""Evidence of crowded tracks comes from blocks of tracks and equals the joins of pairs with frames."""

from __future__ import annotations

import numpy as np

from obsfuse.functions.vec3 import SYM
from obsfuse.operators import tracks


def test_blocks_equal_joins_and_shuffle_no_pair(spark, monkeypatch):
    monkeypatch.setattr(tracks, "PAIR_BLOCK", 5)
    rng = np.random.default_rng(4)
    rows = []
    for t in range(24):
        for frame in range(4):
            for _ in range(2 if rng.random() < 0.2 else 1):
                a = rng.normal(size=(3, 4))
                c = a @ a.T * (0.0 if t == 0 else 1.0) + np.diag([1.0, 1.0, 0.0 if t == 0 else 1.0])
                rows.append((f"c{t // 2 % 2}", f"{'ab'[t % 2]}{t // 4 % 2}", t, frame, *map(float, rng.random(3)), float(rng.random()), rng.normal(size=21).tolist(), *c[np.triu_indices(3)].tolist()))
    df = spark.createDataFrame(rows, "case_id string, window_id string, track_id long, frame long, x double, y double, z double, association_probability double, jacobian array<double>, " + ", ".join(f"k_{s} double" for s in SYM))
    blocks = []
    names = ["a0", "a1", "b0", "b1"]
    for case in ("c0", "c1"):
        r = rng.normal(size=(28, 30))
        joint = r @ r.T / 30
        blocks += [(case, p, q, joint[7 * i : 7 * i + 7, 7 * k : 7 * k + 7].ravel().tolist()) for i, p in enumerate(names) for k, q in enumerate(names) if (case, p, q) != ("c1", "a1", "b1")]
    blocks = spark.createDataFrame(blocks, "case_id string, window_i string, window_j string, block array<double>")
    left, right = df.where("track_id % 2 = 0"), df.where("track_id % 2 = 1")
    cfg = tracks.AssociationConfig(distance=0.9, distance_scale=0.7)
    got = tracks.joint_link_evidence(left, right, blocks, cfg)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tracks, "_crowded", lambda *_: (False, 0, 0))
    want = tracks.joint_link_evidence(left, right, blocks, cfg)
    key, cols = ["left_id", "right_id"], ["shared_frames", "support", "rms", "score", "normalized_rms"]
    a, b = (d.select(*key, *cols).toPandas().sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(a) and a[key].equals(b[key]) and a["normalized_rms"].isna().any() and a["normalized_rms"].notna().any()
    np.testing.assert_allclose(a[cols].to_numpy(float), b[cols].to_numpy(float), rtol=1e-8)
