"""Ranks, quantiles and runs against NumPy, for several partitionings and a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsfuse.operators import ranking as rk


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 6, n))  # one key holds most rows
    return pd.DataFrame({"k": key, "i": np.arange(n), "v": np.round(rng.normal(size=n), 1), "r": rng.random(n)})


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles(spark, pdf, parts):
    df = spark.createDataFrame(pdf).repartition(parts)
    got = rk.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["a", "b", "c"]].astype(float), np.quantile(g.v, [0.25, 0.5, 0.99]))


def test_running_sum_and_row_number(spark, pdf):
    df = spark.createDataFrame(pdf).repartition(5)
    got = rk.with_running(df, ["k"], ["i"], {"s": F.col("r")}).toPandas().sort_values(["k", "i"])
    want = pdf.sort_values(["k", "i"]).groupby("k").r.cumsum()
    assert np.allclose(got.s, want)
    assert (rk.with_row_number(df, [], ["i"], "n").toPandas().sort_values("i").n.to_numpy() == np.arange(1, 601)).all()


def _auc(risk, score):
    order = np.argsort(score, kind="stable")
    r, s = risk[order], score[order]
    total, n, out = 0.0, 0, 0.0
    for value in np.unique(s):
        g = r[s == value]
        for j in range(1, len(g) + 1):
            out += (total + j * g.mean()) / (n + j)
        n, total = n + len(g), total + g.sum()
    return out / n


def test_risk_curves(spark, pdf):
    df = spark.createDataFrame(pdf)
    got = rk.risk_coverage_auc(df, ["k"], "r", "v").toPandas().set_index("k").auc
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(_auc(g.r.to_numpy(), g.v.to_numpy()), rel=1e-9)


def test_harmonic_gap_large_tie(spark):
    df = spark.createDataFrame([(1, float(v), 5.0) for v in range(500)], "k int, r double, v double")
    assert rk.risk_coverage_auc(df, ["k"], "r", "v").collect()[0].auc == pytest.approx(249.5, rel=1e-9)


def test_spearman_ties_and_constant(spark, pdf):
    df = spark.createDataFrame(pdf.assign(c=1.0))
    got = rk.spearman(df, ["k"], "v", "r").toPandas().set_index("k").spearman
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g.v.rank().corr(g.r.rank()), abs=1e-9)
    assert set(rk.spearman(df, ["k"], "c", "r").toPandas().spearman) == {0.0}


def test_runs_intervals_and_positions(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, True, True, True, False])], "k int, i int, b boolean")
    assert rk.longest_run(df, ["k"], ["i"], "b").collect()[0].longest == 3
    fr = spark.createDataFrame([(1, f) for f in (3, 4, 5, 9, 10, 20)], "k int, f long")
    rows = {(r.start, r.stop) for r in rk.contiguous_intervals(fr, ["k"], "f").collect()}
    assert rows == {(3, 6), (9, 11), (20, 21)}
    many = spark.range(1000).withColumn("k", F.lit(1))
    got = sorted(r.id for r in rk.representative_positions(many, ["k"], ["id"], 37).collect())
    assert got == sorted(set(np.linspace(0, 999, 37, dtype=np.int64)))


def test_subsample_is_seeded_and_bounded(spark, pdf):
    df = spark.createDataFrame(pdf)
    a = rk.subsample(df, ["k"], ["i"], 20, 1).select("i").toPandas().i
    b = rk.subsample(df.repartition(7), ["k"], ["i"], 20, 1).select("i").toPandas().i
    assert set(a) == set(b) and len(a) == sum(min(20, n) for n in pdf.k.value_counts())
