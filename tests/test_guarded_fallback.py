"""Arms that fall back are compared with the very rows they fall back to."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from obsfuse.operators import groups


def test_rows_that_differ_when_computed_again_are_computed_once(spark):
    drawn = F.udf(lambda _: random.SystemRandom().random(), "double").asNondeterministic()
    base = spark.range(8).select(F.col("id").alias("group_id")).withColumn("query_rmse", drawn("group_id"))
    live = F.col("arm_id") == "F"
    rows = base.select("*", F.explode(F.array(F.lit("O"), F.lit("F"))).alias("arm_id")).select(
        "*", F.when(live, F.lit(False)).alias("accepted"), F.lit(0.5).alias("accepted_coverage"), F.lit(1.0).alias("accepted_width"),
        F.when(live, F.lit(True)).alias("exact_fallback"), F.lit(False).alias("technical_failure"),
    )
    arms, gates = groups.guarded_query(rows, "O", "F", groups.QueryGuardPolicy(), 20, 1)
    assert arms.where(live).first()["exact_fallback_count"] == 8
    assert gates.first()["exact_fallback_passed"]
