"""Estimates are grouped in parts of a fixed number of rows, and what is grouped by cell after that is not shuffled again."""

from obsfuse.operators import fusion
from obsfuse.plans import adapters as ad


def test_cells_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(ad, "PART_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    est = ad.estimates(spark, sf)
    rows = ad.read(spark, sf, "lineitem").count()
    assert est.rdd.getNumPartitions() == -(-rows // 500)
    fused = fusion.fuse_uniform(est, ["cell"])
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert fused.count() == ad.read(spark, sf, "lineitem").select("l_orderkey").distinct().count()
