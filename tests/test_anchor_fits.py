"""Anchors of windows that fit one task are not fitted by rounds over all points."""

from __future__ import annotations

import numpy as np
from pytest import approx

from obsfuse.operators import align


def test_small_windows_are_fitted_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    truth, rows = [], []
    for row in range(6):
        for col in range(6):
            p = rng.random(3) * 5
            truth.append(("c", 0, row, col, *map(float, p), True))
            rows += [("c", w, 0, row, col, *map(float, (p - k) / (k + 1.5)), True) for k, w in enumerate(("w0", "w1"))]
    truth = spark.createDataFrame(truth, "case_id string, frame long, row int, col int, x double, y double, z double, valid boolean")
    samples = spark.createDataFrame(rows, "case_id string, window_id string, frame long, row int, col int, x double, y double, z double, valid boolean")
    monkeypatch.setattr(align, "fit_edges_distributed", lambda *_, **__: (_ for _ in ()).throw(AssertionError("rounds over all points")))
    got = {r.window_id: r for r in align.metric_anchor(samples, truth, 10).collect()}
    for k, w in enumerate(("w0", "w1")):
        assert got[w].status == "ok" and got[w].n == 36
        assert got[w].scale == approx(k + 1.5) and got[w].tx == approx(k, abs=1e-6)
