"""Folds of an edge are fitted in one group of its pairs, with the fits of one group for each fold."""

import pytest
from pyspark.sql import functions as F

from obsfuse.operators import align
from obsfuse.operators import disagreement as dis


def test_folds_share_a_group_and_equal_their_own_fits(spark):
    pairs = _pairs(spark)
    plan = dis.fold_assignment(pairs, 3, 5)
    training = pairs.join(plan, [*dis.EDGE, "cluster"]).select("*", F.explode(F.sequence(F.lit(0), F.col("fold_count").cast("int") - 1)).alias("held_fold")).where("fold != held_fold")
    want = {(r.moving_id, r.held_fold): r for r in align.fit_edges(training, [*dis.EDGE, "held_fold"]).collect()}
    held = align.fit_held_folds(pairs, dis.EDGE, 3, dis._fold_draw(5))
    assert "Generate" not in held._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.moving_id, r.held_fold): r for r in held.collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, r in want.items():
        assert (got[k].n, got[k].clusters, got[k].status) == (r.n, r.clusters, "ok")
        assert [got[k].scale, got[k].tx, *got[k].cov] == pytest.approx([r.scale, r.tx, *r.cov], rel=1e-9, abs=1e-15)


def _pairs(spark):
    i = F.col("id")
    rows = spark.range(600, numPartitions=3).select("id", (i % 40).alias("cluster"), *[(10 * F.sin(i * k)).alias(f"s{a}") for a, k in zip("xyz", (1, 2, 3), strict=True)])
    return rows.select(
        F.lit("c").alias("case_id"), F.lit("w0").alias("reference_id"), F.concat(F.lit("w"), (1 + i % 2).cast("string")).alias("moving_id"), "cluster",
        "sx", "sy", "sz", *[(1.2 * F.col(f"s{a}") + F.cos(i * k) / 5).alias(f"p{a}") for a, k in zip("xyz", (5, 7, 11), strict=True)],
    )
