"""Scoped and provider evaluations read their rows in few passes and spread what grows from small tables."""

from pyspark.sql import functions as F

from obsfuse.operators import joins, scores
from obsfuse.operators.bootstrap import group_bootstrap
from obsfuse.plans import q_geometry


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_fits_of_keys_are_not_salted_onto_the_rows(spark):
    rows = spark.range(40).select(
        F.lit("c").alias("case_id"), F.lit("m").alias("method_id"), "id", *[(F.col("id") * k).cast("double").alias(c) for c, k in zip("xyz", (1, 2, 3), strict=True)]
    )
    fit = rows.groupBy("case_id", "method_id").agg(F.lit(2.0).alias("scale"), *[F.lit(1.0).alias(f"fit_t{c}") for c in "xyz"])
    out = scores.apply_scale_translation(rows, fit, ["case_id", "method_id"])
    assert "__salt" not in _plan(out)
    assert {(r.id, r.x, r.z) for r in out.collect()} == {(i, 2.0 * i + 1, 6.0 * i + 1) for i in range(40)}


def test_counts_of_windows_come_with_the_methods(spark):
    assert _plan(q_geometry._scoped(spark, "/root/testdata/sf0.001")).count("Relation [") == 2  # methods and truth


def test_common_rows_carry_values_that_the_truth_does_not_have(spark):
    p = spark.createDataFrame([("c", 1, 0, 0, m, 1.0, n, True) for m, n in (("a", 5), ("b", 7))], "case_id string, frame bigint, row int, col int, method_id string, x double, contributors int, valid boolean")
    t = spark.createDataFrame([("c", 1, 0, 0, 3.0, True)], "case_id string, frame bigint, row int, col int, x double, valid boolean")
    got = joins.common_rows(t, p, ["x", "contributors"], known="x").collect()
    assert sorted((r.method_id, r.x, r.contributors, r.tx) for r in got) == [("a", 1.0, 5, 3.0), ("b", 1.0, 7, 3.0)]


def test_slots_of_a_small_table_are_spread_before_they_grow(spark):
    values = spark.range(30, numPartitions=1).select(F.lit("m").alias("k"), F.col("id").alias("g"), F.sin("id").alias("v"))
    plan = _plan(group_bootstrap(values, ["k"], "g", "v", 50), "executedPlan")
    assert f", {spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
