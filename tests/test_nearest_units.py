"""Nearest units through cells, and transport p-values, against brute force."""

import numpy as np
import pandas as pd
import pytest

from obsfuse.operators import transport


def units(spark, vectors):
    return spark.createDataFrame(pd.DataFrame({"unit_id": range(len(vectors)), "embedding": [v.tolist() for v in vectors], "rows": 3}))


def clusters(rng, near=40, equal=60):
    """Ten clusters, and one vector that a third of all units share."""
    centres = rng.normal(size=(10, 4)) * 30
    return np.round(np.vstack([np.repeat(centres, near // 4, axis=0) + rng.normal(size=(10 * (near // 4), 4)), np.tile(centres[3], (equal, 1))]), 3)


@pytest.mark.parametrize(("k", "itself"), [(3, True), (5, False), (500, False)])
def test_cells_give_the_nearest(spark, k, itself):
    v = clusters(np.random.default_rng(4))
    e = units(spark, v)
    scale = spark.createDataFrame([([1.0, 2.0, 0.5, 3.0],)], "scale array<double>")
    got = transport.nearest_units(e, e, scale, k, exclude_self=itself, block=8).toPandas()
    z = v / np.array([1.0, 2.0, 0.5, 3.0])
    for u in range(0, len(v), 7):
        d = np.sqrt(((z - z[u]) ** 2).mean(axis=1))
        order = [i for i in np.lexsort((np.arange(len(v)), np.round(d, 9))) if not (itself and i == u)][:k]
        mine = got[got["unit_id"] == u].sort_values("rank")
        assert np.allclose(mine["distance"], d[order])
        if k < 500:  # equal distances go by id
            assert mine["source_id"].tolist() == order
    table, packed = transport.source_cells(e, scale, 8)
    visits = transport.cell_visits(e, table, 3)
    parts = packed.count()
    assert visits.count() < 0.6 * len(v) * parts  # most cells are not visited
    assert max(len(r["__s"]) for r in packed.collect()) <= 20  # equal units lie in several parts


def test_p_values_count_sources_at_or_above(spark):
    rng = np.random.default_rng(8)
    v = clusters(rng, 12, 15)
    e = units(spark, v)
    model = transport.fit_transport(e.where("unit_id % 3 <> 0"), 2)
    got = transport.evaluate_transport(e.where("unit_id % 3 = 0"), model, 2, 2, 2).toPandas()
    known = np.array([r.score for r in model["scores"].collect()])
    assert len(got) == e.where("unit_id % 3 = 0").count()
    for r in got.itertuples():
        assert r.p_value == pytest.approx((1 + (known >= r.score).sum()) / (len(known) + 1))
