"""All evaluation modes come from one pass over the rows, with the cards of one pass for each mode."""

import pytest
from pyspark.sql import functions as F

from obsfuse.operators import scores

KEYS = ["case_id", "method_id"]


def test_modes_share_a_pass_and_equal_their_own_cards(spark):
    base = spark.range(2 * 2 * 6 * 12, numPartitions=3).select(
        F.concat(F.lit("c"), F.floor(F.col("id") / 144)).alias("case_id"), F.concat(F.lit("m"), F.floor(F.col("id") / 72) % 2).alias("method_id"),
        (F.floor(F.col("id") / 12) % 6).alias("frame"), (F.floor(F.col("id") / 4) % 3).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), "id",
    )
    df = base.select(
        *KEYS, "frame", "row", "col", F.col("col").cast("double").alias("tx"), F.col("row").cast("double").alias("ty"), F.col("frame").cast("double").alias("tz"),
        (1.3 * F.col("col") + F.sin("id")).alias("x"), (0.9 * F.col("row") - 2 + F.cos("id")).alias("y"), (1.1 * F.col("frame") + F.sin(3 * F.col("id"))).alias("z"),
    )
    bounds = spark.createDataFrame([("c0", 3), ("c1", 2)], "case_id string, frame bigint")
    out = scores.evaluation_modes(df, KEYS, F.lit(4), bounds)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2  # rows and seams
    got = {(r.case_id, r.method_id, r.mode): r for r in out.collect()}
    assert len(got) == 12
    for mode, part in (("metric", None), ("prefix_aligned", df.where("frame < 4")), ("oracle_aligned", df)):
        rows = df
        if part is not None:
            fit = scores.scale_translation_fit(part, KEYS).withColumnsRenamed({f"t{c}": f"fit_t{c}" for c in "xyz"})
            rows = scores.apply_scale_translation(df, fit, KEYS)
        for want in scores.sequence_scorecard(rows, KEYS, bounds).collect():
            have = got[want.case_id, want.method_id, mode]
            assert [have[c] for c in want.__fields__] == [v if isinstance(v, str) else pytest.approx(v, abs=1e-9) for v in want]
