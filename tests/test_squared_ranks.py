"""Trajectory nodes are chosen by squared distance, as the SQL does."""

from __future__ import annotations

import numpy as np

from obsfuse.operators import tracks


def test_roots_that_are_equal_do_not_tie(spark):
    a = next(x for x in np.random.default_rng(0).uniform(1.0, 1.4, 10_000) if np.nextafter(x, 2) ** 2 > x * x and np.sqrt(x * x + 9.0) == np.sqrt(np.nextafter(x, 2) ** 2 + 9.0) and x * x + 9.0 < np.nextafter(x, 2) ** 2 + 9.0)
    nodes = spark.createDataFrame([("c", 1, 0, float(np.nextafter(a, 2)), 3.0, 0.0), ("c", 2, 0, float(a), 3.0, 0.0)], "case_id string, node_id long, frame long, x double, y double, z double")
    points = spark.createDataFrame([("c", 7, 0.0, 0.0, 0.0)], "case_id string, point_id long, x double, y double, z double")
    got = tracks.anchored_rollout(points, nodes, 0, offset=False).first()
    assert got["x"] == float(a)
    near = tracks.nearest_points(points, nodes, ["case_id"], "point_id", "node_id").first()
    assert near["target_id"] == 1  # by the root the two tie, so the smaller id
