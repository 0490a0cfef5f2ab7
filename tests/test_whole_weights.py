"""Weights of groups that fit one task take one pass, and equal those of the rounds over all groups."""

from __future__ import annotations

import numpy as np

from obsfuse.operators import fusion
from obsfuse.operators.fusion import COV


def test_grouped_weights_equal_rounds_without_any(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for cell in range(30):
        for w in range(3 + cell % 2):
            a = rng.normal(size=(3, 3)) * (1 + w)
            rows.append((cell % 2, cell, f"w{w}", *map(float, rng.random(3)), *(a @ a.T + np.eye(3))[np.triu_indices(3)].tolist()))
    est = spark.createDataFrame(rows, "frame int, cell int, contributor string, x double, y double, z double, " + ", ".join(f"{c} double" for c in COV))
    cells = fusion._with_pattern(est, ["frame", "cell"])

    def weights(df):
        return {(r.frame, tuple(r.pattern)): np.array(r.weights) for r in df.collect()}

    monkeypatch.setattr(fusion, "GROUP_CELLS", 0, raising=False)
    want = weights(fusion.nway_weights(cells, ["frame", "pattern"]))
    monkeypatch.setattr(fusion, "GROUP_CELLS", 100, raising=False)
    rounds = []
    real = fusion._curvature
    monkeypatch.setattr(fusion, "_curvature", lambda *a: rounds.append(1) or real(*a))
    got = weights(fusion.nway_weights(cells, ["frame", "pattern"]))
    assert not rounds and got.keys() == want.keys() and len(got) == 2
    for k in got:
        np.testing.assert_allclose(got[k], want[k], atol=1e-7)
