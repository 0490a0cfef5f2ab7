"""Nearest points through tiles: crowded keys, crowds at one place, odd coordinates, and rows moved for each source."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsfuse.operators import tracks


def frame_of(spark, p, frame="1"):
    return spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(frame=frame, point_id=np.arange(len(p))))


@pytest.mark.parametrize("squared", [False, True])
def test_tiles_give_the_nearest(spark, squared, monkeypatch):
    monkeypatch.setattr(tracks, "_TILE_SOURCES", 50)
    rng = np.random.default_rng(3)
    b = np.vstack([rng.integers(0, 6, size=(500, 3)), np.tile([2.0, 2.0, 2.0], (300, 1)), rng.normal(size=(100, 3)) * 1e-6, [[1e6, 0, 0]]]).astype(float)
    a = np.vstack([rng.uniform(-1, 7, size=(300, 3)), np.tile([2.5, 2.5, 2.5], (200, 1)), [[1e7, -1e7, 3.0]]])
    extra = rng.normal(size=(5, 3))
    fa = frame_of(spark, a).union(frame_of(spark, a[:7], "2")).union(frame_of(spark, a[:2], "no target"))
    fb = frame_of(spark, b).union(frame_of(spark, extra, "2"))
    rows = tracks.nearest_points(fa, fb, ["frame"], tile=16, squared=squared).toPandas()
    assert len(rows) == len(a) + 7
    for frame, p, q in (("1", a, b), ("2", a[:7], extra)):
        got = rows[rows["frame"] == frame].sort_values("source_id")
        d = ((p[:, None] - q[None]) ** 2).sum(axis=2)
        d = d if squared else np.sqrt(d)
        assert (got["target_id"].to_numpy() == d.argmin(axis=1)).all()
        assert np.allclose(got["distance"], np.sqrt(d.min(axis=1)) if squared else d.min(axis=1))


def test_missing_coordinates_take_the_smallest_id(spark):
    kinds = "frame long, point_id long, x double, y double, z double"
    a = spark.createDataFrame([(1, 1, None, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0), (2, 3, 0.0, 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0)], kinds)
    b = spark.createDataFrame([(1, 5, 9.0, 0.0, 0.0), (1, 6, 3.0, 0.0, 0.0), (1, 7, None, 0.0, 0.0), (2, 9, None, 0.0, 0.0), (2, 8, None, 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0)], kinds)
    got = sorted((r.source_id, r.target_id, r.distance) for r in tracks.nearest_points(a, b, ["frame"]).collect())
    assert got == [(1, 5, None), (2, 6, 3.0), (3, 8, None)]


def test_sources_are_not_copied_to_cells_around_them(spark):
    rng = np.random.default_rng(5)
    fa, fb = frame_of(spark, rng.uniform(size=(3000, 3))), frame_of(spark, rng.uniform(size=(3000, 3)))
    low_high = tracks._tiles(fb.select("frame", "point_id", *[F.col(c).alias(f"t{c}") for c in "xyz"]), ["frame"], 256)[1]
    boxes = low_high[("1",)]
    p = np.array(fa.select("x", "y", "z").collect(), float)
    gap = sum(np.maximum(np.maximum(boxes[1][:, c] - p[:, c, None], p[:, c, None] - boxes[2][:, c]), 0) ** 2 for c in range(3))
    near = tracks.nearest_points(fa, fb, ["frame"], tile=256).orderBy("source_id").toPandas()["distance"].to_numpy()
    assert (gap <= near[:, None] ** 2).sum() < 2.5 * len(p)  # visits: before, each source went to 27 cells
