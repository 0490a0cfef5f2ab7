"""Estimates that lie together by frame are fused there, and cards of all variants come from sums of frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsfuse.operators import fusion, scores
from obsfuse.operators.fusion import COV
from obsfuse.runtime import placed

KEY = ["case_id", "frame", "row", "col"]


def test_intersection_moves_no_cell(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        for w in range(1 + i % 4):
            a = rng.normal(size=(3, 3)) * (1 + w)
            m = (a @ a.T + np.eye(3))[np.triu_indices(3)].tolist()
            rows.append((f"c{i % 3}", i % 2, i // 10, i % 10, f"w{w}", *rng.normal(size=3).tolist(), *m))
    schema = "case_id string, frame long, row int, col int, contributor string, x double, y double, z double, " + ", ".join(f"{c} double" for c in COV)
    est = spark.createDataFrame(rows, schema)
    dealt = placed(est.repartition(4, "case_id", "frame"))
    out = [fusion.fuse(dealt, KEY, "covariance_intersection", frame_keys=["case_id", "frame"], written=w) for w in (False, True)]
    out.append(fusion.fuse(dealt, KEY, "precision"))
    for df in out:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    a, b = ([tuple(r) for r in df.orderBy(*KEY).collect()] for df in out[:2])
    assert a == b and len(a) == 120
    only = {tuple(r[:4]): r for r in rows if sum(s[:4] == r[:4] for s in rows) == 1}
    for r in a:
        if r[:4] in only:
            assert r[4:13] == only[r[:4]][5:] and r[13:] == (1, [1.0])
        else:
            assert r[13] > 1 and sum(r[14]) == pytest.approx(1)


def test_frame_cards_are_both_cards(spark):
    df = spark.range(400).selectExpr("id % 3 AS k", "id % 5 AS frame", *[f"sin(id + {i}) AS {c}" for i, c in enumerate(["x", "y", "z", "tx", "ty", "tz"])], "1D + id % 4 AS target_norm", "id % 50 AS odd")
    df = df.withColumns({f"e{c}": F.col(c) - F.col(f"t{c}") for c in "xyz"}).withColumns({"c_xx": F.lit(1.0), "c_xy": F.lit(0.1), "c_xz": F.lit(0.0), "c_yy": F.lit(2.0), "c_yz": F.lit(0.2), "c_zz": F.col("target_norm")})
    df = df.withColumn("ez", F.when(F.col("odd") == 7, F.lit(float("nan"))).otherwise(F.col("ez")))
    want = scores.sequence_scorecard(df, ["k"]).join(scores.uncertainty_diagnostics(df, ["k"], ranks=False), ["k"])
    got = scores.frame_cards(df, ["k"])
    assert set(got.columns) == set(want.columns)
    for g, w in zip(got.orderBy("k").collect(), want.orderBy("k").collect(), strict=True):
        assert g.asDict() == pytest.approx(w.asDict())
