"""Variances of the samples are written once: medians and selections do not join and group the tables again."""

import pytest

from obsfuse.plans.catalogue import REGISTRY


@pytest.mark.parametrize("name", ["tile_argmax", "reliability_features"])
def test_rows_come_from_written_variances(spark, name):
    out = REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    assert "Relation [" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not out.isEmpty()
