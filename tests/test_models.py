"""Structured Gaussians, regressions, units, hypotheses against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsfuse.operators import bootstrap, calibrate, conformal, gaussian, groups, identity, joins, regress, tracks, transport

SYM = ["xx", "xy", "xz", "yy", "yz", "zz"]
IJ = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def gaussian_rows(spark, groups_=3, n=6, rank=2):
    rng = np.random.default_rng(4)
    rows, dense = [], {}
    for g in range(groups_):
        big, e, us = np.zeros((3 * n, 3 * n)), rng.normal(size=3 * n), []
        for i in range(n):
            a = rng.normal(size=(3, 3))
            d = a @ a.T + 0.3 * np.eye(3)
            u = rng.normal(size=(3, rank))
            big[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = d
            us.append(u)
            rows.append((f"g{g}", i, *e[3 * i : 3 * i + 3].tolist(), *[float(d[p, q]) for p, q in IJ], u.ravel().tolist()))
        u = np.vstack(us)
        dense[f"g{g}"] = (e, big + u @ u.T, big, u)
    schema = "group_id string, row_id long, ex double, ey double, ez double, " + ", ".join(f"c_{s} double" for s in SYM) + ", factor array<double>"
    return spark.createDataFrame(rows, schema), dense


def test_joint_scores_match_dense(spark):
    df, dense = gaussian_rows(spark)
    got = gaussian.joint_scores(df, ["group_id"], 2).toPandas().set_index("group_id")
    for g, (e, cov, _, _) in dense.items():
        assert got.loc[g, "m2"] == pytest.approx(e @ np.linalg.solve(cov, e), rel=1e-8)
        assert got.loc[g, "log_det"] == pytest.approx(np.linalg.slogdet(cov)[1], rel=1e-8)
    zero = gaussian.dependence_ablation(df, "group_id", 2)
    assert zero.count() == 6 and gaussian.ablation_summary(zero, "group_id", 50).count() == 2


def test_query_conditioning_and_compression(spark):
    df, dense = gaussian_rows(spark)
    rows = df.withColumn("cross", F.array(*[F.lit(v) for v in (0.1, 0.0, 0.2)]))
    prior = rows.select("group_id").distinct().withColumns({"mean": F.array(F.lit(1.0)), "cov": F.array(F.lit(50.0))})
    got = gaussian.condition_query(rows, ["group_id"], 1, 2, prior).toPandas().set_index("group_id")
    for g, (e, cov, _, _) in dense.items():
        c = np.tile([0.1, 0.0, 0.2], 6)
        assert got.loc[g, "mean"][0] == pytest.approx(1 + c @ np.linalg.solve(cov, e), rel=1e-8)
        assert got.loc[g, "cov"][0] == pytest.approx(50 - c @ np.linalg.solve(cov, c), rel=1e-8)
    dup = rows.withColumn("factor", F.array(*[F.col("factor")[2 * i] * k for i in range(3) for k in (1.0, 0.5)]))
    out, info = gaussian.compress_factor(dup.withColumn("jac", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), 2, {"q": ("jac", 1)}, {"q": 1.0})
    assert info["rank"] == 1 and info["applied"] and len(out.first().factor) == 3


def test_orthogonal_basis(spark):
    df, _ = gaussian_rows(spark, rank=1)
    rows = df.withColumn("gauge", F.array(F.lit(1.0), F.col("ex"), F.lit(0.5)))
    o = gaussian.orthogonalize_basis(rows, ["group_id"], 1, 1)
    both = o.withColumn("factor", F.array(*[c for i in range(3) for c in (F.col("gauge")[i], F.col("factor")[i])]))
    s = gaussian.sufficient_statistics(both, ["group_id"], 2).toPandas()
    assert all(abs(w[1]) < 1e-8 for w in s.ww)


def test_bias_rank_prefers_real_bias(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(8):
        b = rng.normal() * 3
        for _ in range(20):
            e = rng.normal(size=3) + np.array([b, 0, 0])
            rows.append((f"g{g}", *e.tolist(), 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    df = spark.createDataFrame(rows, "group_id string, ex double, ey double, ez double, " + ", ".join(f"c_{s} double" for s in SYM) + ", factor array<double>")
    table, decision = gaussian.select_bias_rank(gaussian.bias_statistics(df, "group_id", 2), "group_id", 2)
    d = decision.collect()[0]
    assert table.count() == 3 and d.selected_rank >= 1 and d.best_nll < d.baseline_nll and d.covariance[0] > 1


def test_logistic_matches_numpy_and_balances_groups(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(float)
    g = np.where(np.arange(300) < 240, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"group_id": g, "features": x.tolist(), "label": y}))
    model, report = regress.fit_logistic(df, 2, ridge=0.01)
    w = np.where(g == "a", 1 / (2 * 240), 1 / (2 * 60))
    z = np.column_stack([np.ones(300), (x - np.array(model.standardiser.center)) / np.array(model.standardiser.scale)])
    p = 1 / (1 + np.exp(-z @ model.theta))
    grad = z.T @ (w * (p - y)) + 0.01 * np.array([0, *model.theta[1:]])
    assert model.converged and np.abs(grad).max() < 1e-6 and report.collect()[0].groups == 2


def test_choice_and_variance_regressions_are_stationary(spark):
    rng = np.random.default_rng(9)
    rows = []
    for e in range(60):
        f = rng.normal(size=(3, 1))
        t = int(np.argmax(f[:, 0] + rng.gumbel(size=3)))
        for c in range(3):
            rows.append((f"g{e % 4}", f"e{e}", f"c{c}", "null" if c == 0 else "linked", f[c].tolist(), c == t))
    df = spark.createDataFrame(rows, "group_id string, example_id string, candidate_id string, kind string, features array<double>, is_true boolean")
    m = regress.fit_choice(df, 1)
    assert m.converged and m.theta[1] > 0.2
    pred = regress.choice_probabilities(df, m)
    assert pred.groupBy("example_id").agg(F.abs(F.sum("probability") - 1).alias("d")).agg(F.max("d")).first()[0] < 1e-9
    assert regress.choice_report(pred).collect()[0].log_loss < np.log(3)
    n = 400
    x = rng.normal(size=n)
    e = rng.normal(size=(n, 3)) * np.exp(0.4 * x)[:, None]
    v = spark.createDataFrame(pd.DataFrame({"group_id": np.arange(n) % 5, "features": x[:, None].tolist(), "e_ray": e[:, 0], "e_tangent": e[:, 1], "e_normal": e[:, 2]}))
    fit = regress.fit_variance_regression(v, 1)
    assert fit.converged and np.allclose(fit.theta[:, 1], 0.8, atol=0.25)


def test_nearest_units_blocks_are_exact(spark):
    rng = np.random.default_rng(0)
    e = spark.createDataFrame(pd.DataFrame({"unit_id": np.arange(30), "embedding": rng.normal(size=(30, 4)).tolist()}))
    scale = spark.createDataFrame([([1.0] * 4,)], "scale array<double>")
    a = transport.nearest_units(e, e, scale, 3, True, block=4).toPandas().sort_values(["unit_id", "rank"])
    b = transport.nearest_units(e, e, scale, 3, True).toPandas().sort_values(["unit_id", "rank"])
    assert (a.source_id.to_numpy() == b.source_id.to_numpy()).all()


def test_nearest_points_against_brute_force(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(80, 3)), rng.normal(size=(60, 3))
    a[0] = [50.0, 50.0, 50.0]  # far outside the target box
    fa = spark.createDataFrame(pd.DataFrame(a, columns=list("xyz")).assign(frame=1, point_id=np.arange(80)))
    fb = spark.createDataFrame(pd.DataFrame(b, columns=list("xyz")).assign(frame=1, point_id=np.arange(60)))
    got = tracks.nearest_points(fa, fb, ["frame"]).toPandas().sort_values("source_id")
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert (got.target_id.to_numpy() == d.argmin(axis=1)).all() and np.allclose(got.distance, d.min(axis=1))


def test_identity_posterior(spark):
    rows = [(1, "a", 0.0, -1.0, [0.0], [1.0]), (1, "b", float(np.log(3.0)), -2.0, [2.0], [2.0])]
    df = spark.createDataFrame(rows, "target_id int, candidate_id string, log_weight double, log_likelihood double, mean array<double>, cov array<double>")
    prior = {r.candidate_id: r.probability for r in identity.posterior(df, 0.0).collect()}
    assert prior["b"] == pytest.approx(0.75)
    m = identity.moment_match(identity.posterior(df, 0.0), 1).collect()[0]
    assert m["mean"][0] == pytest.approx(1.5) and m.covariance[0] == pytest.approx(0.25 * 1 + 0.75 * 2 + 0.25 * 2.25 + 0.75 * 0.25)


def test_conformal_boundary(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 20)], "s double")
    r = conformal.upper_threshold(df, "s", 0.05).collect()[0]
    assert r["rank"] == 19 and r.threshold == 19.0
    with pytest.raises(Exception, match="fewer than"):
        conformal.upper_threshold(df.where("s < 19"), "s", 0.05).collect()
    got = conformal.availability(spark.createDataFrame([(19,), (18,)], "n long"), "n", ["0.95"]).toPandas()
    assert dict(zip(got.n, got.finite, strict=True)) == {19: True, 18: False}


def test_bootstrap_single_group_and_interval(spark):
    one = spark.createDataFrame([("m", 1, 3.0)], "m string, g int, v double")
    r = bootstrap.group_bootstrap(one, ["m"], "g", "v", 50).collect()[0]
    assert r.ci_lower == r.ci_upper == r["mean"] == 3.0
    rng = np.random.default_rng(1)
    v = rng.normal(size=60)
    df = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(v)], "m string, g int, v double")
    r = bootstrap.group_bootstrap(df, ["m"], "g", "v", 800).collect()[0]
    half = 1.96 * v.std() / np.sqrt(60)
    assert r.ci_upper - r.ci_lower == pytest.approx(2 * half, rel=0.2)


def test_group_balance_and_inflation(spark):
    df = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 5.0)], "group_id string, par_ratio double").withColumn("lat_ratio", F.col("par_ratio"))
    assert calibrate.group_balanced_calibration(df).collect()[0].par_update == pytest.approx(3.0)
    assert calibrate.pooled_calibration(df, 1.0).collect()[0].par_update == pytest.approx(2.0)
    cov = np.eye(7) * 0.5
    e = spark.createDataFrame([([1.0] * 7, cov.ravel().tolist())] * 4, "error array<double>, cov array<double>")
    inf = calibrate.fit_inflation(e)
    out = calibrate.apply_inflation(e, inf).first().cov
    assert np.allclose(np.diag(np.array(out).reshape(7, 7)), 1.0)


def test_guards(spark):
    a = spark.createDataFrame([(1,), (2,)], "g int")
    with pytest.raises(ValueError, match="both sides"):
        joins.assert_disjoint(a, a.where("g = 1"), "g")
    with pytest.raises(ValueError, match="repeated"):
        joins.exact_sidecar(a.unionByName(a), a, ["g"])
    rows = spark.createDataFrame([("c1", 1, "g1", 2.0), ("c2", 0, "g1", 1.0)], "candidate_id string, complexity_rank int, group_id string, m double")
    rule = groups.SelectionRule(groups.MetricOrder("m"), constraints=(groups.Constraint("m", "mean", "<=", 0.5),))
    with pytest.raises(Exception, match="feasible"):
        groups.selected_candidate(groups.candidate_order(rows, rule)).collect()
    ratio, reason = groups.safe_ratio(F.col("a"), F.col("b"))
    r = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0)], "a double, b double").select(ratio.alias("r"), reason.alias("w")).collect()
    assert r[0].r == 1.0 and r[1].r is None and r[1].w


def test_spatial_pairs_brute(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((40, 3)), rng.random((40, 3))
    fa = spark.createDataFrame(pd.DataFrame(a, columns=list("xyz")).assign(frame=0, track_id=np.arange(40)))
    fb = spark.createDataFrame(pd.DataFrame(b, columns=list("xyz")).assign(frame=0, track_id=np.arange(40)))
    got = {(r.left_id, r.right_id) for r in joins.spatial_pairs(fa, fb, 0.2).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert got == {tuple(map(int, p)) for p in np.argwhere(d <= 0.2)}
