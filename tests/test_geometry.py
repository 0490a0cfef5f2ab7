"""Similarity fits, gauges and fusion against dense NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.operators import align, fusion, gauges, joins

RNG = np.random.default_rng(11)
SYM = ["xx", "xy", "xz", "yy", "yz", "zz"]
IJ = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def random_transform(rng=RNG):
    return float(np.exp(rng.normal() * 0.2)), sim3.so3_exp(rng.normal(size=3)), rng.normal(size=3)


@pytest.mark.parametrize("size", [0.0, 1e-10, 0.3, 2.0, np.pi - 1e-7])
def test_log_exp(size):
    axis = RNG.normal(size=3)
    w = size * axis / np.linalg.norm(axis)
    assert np.allclose(sim3.so3_exp(sim3.so3_log(sim3.so3_exp(w))), sim3.so3_exp(w), atol=1e-6)


def test_group_laws_and_jacobians():
    for _ in range(8):
        a, b = random_transform(), random_transform()
        ident = sim3.compose(a, sim3.invert(a))
        assert np.allclose(ident[1], np.eye(3)) and ident[0] == pytest.approx(1.0) and np.allclose(ident[2], 0, atol=1e-9)
        va, vb = sim3.to_vector(a), sim3.to_vector(b)
        ja, jb = sim3.compose_jacobians(a, b)
        f = lambda v: sim3.to_vector(sim3.compose(sim3.from_vector(v), b))
        g = lambda v: sim3.to_vector(sim3.compose(a, sim3.from_vector(v)))
        if np.linalg.norm(sim3.so3_log(a[1] @ b[1])) < 2.8:
            assert np.allclose(ja, sim3.numeric_jacobian(f, va), atol=1e-5)
            assert np.allclose(jb, sim3.numeric_jacobian(g, vb), atol=1e-5)
        h = lambda v: sim3.to_vector(sim3.invert(sim3.from_vector(v)))
        assert np.allclose(sim3.inverse_jacobian(a), sim3.numeric_jacobian(h, va), atol=1e-5)


def test_point_jacobian_polynomial():
    t, m = random_transform(), RNG.normal(size=(7, 7))
    cov, p = m @ m.T, RNG.normal(size=3)
    f = lambda v: sim3.transform_points(sim3.from_vector(v), p)
    j = sim3.numeric_jacobian(f, sim3.to_vector(t))
    want = j @ cov @ j.T
    basis = sim3.jacobian_basis(t)
    assert np.allclose(basis[0] + np.einsum("k,kij->ij", p, basis[1:]), j, atol=1e-5)
    coef = sim3.covariance_polynomial(t, cov).reshape(10, 6)
    mono = np.array([1, *p])
    terms = np.array([mono[a] * mono[b] for a in range(4) for b in range(a, 4)])
    assert np.allclose(terms @ coef, [want[i, j] for i, j in IJ], rtol=1e-4)


def pairs_frame(spark, noise=0.01, n=300, edges=2):
    rows, truth = [], {}
    rng = np.random.default_rng(5)
    for e in range(edges):
        t = random_transform(rng)
        truth[f"m{e}"] = t
        s = rng.normal(size=(n, 3)) * 3 + 40
        p = sim3.transform_points(t, s) + rng.normal(size=(n, 3)) * noise
        p[: n // 10] += rng.normal(size=(n // 10, 3)) * 2  # outliers
        for i in range(n):
            rows.append(("c", "r", f"m{e}", i // 12, *p[i].tolist(), *s[i].tolist()))
    cols = "case_id string, reference_id string, moving_id string, cluster long, px double, py double, pz double, sx double, sy double, sz double"
    return spark.createDataFrame(rows, cols), truth


def test_robust_fit_both_forms(spark):
    df, truth = pairs_frame(spark)
    keys = ["case_id", "reference_id", "moving_id"]
    loose = {"tolerance": 1e-2}  # the first iterations are compared exactly
    a = {r.moving_id: r.asDict() for r in align.fit_edges(df, keys, **loose).collect()}
    b = {r.moving_id: r.asDict() for r in align.fit_edges_distributed(df, keys, **loose).collect()}
    for m, t in truth.items():
        assert a[m]["status"] == b[m]["status"] == "ok"
        assert a[m]["scale"] == pytest.approx(t[0], rel=2e-2)
        for c in sim3.GAUGE_COLUMNS:
            assert a[m][c] == pytest.approx(b[m][c], abs=1e-5)
        cov, other = sim3.square(a[m]["cov"]), sim3.square(b[m]["cov"])
        assert np.linalg.eigvalsh(cov).min() > 0 and a[m]["clusters"] == b[m]["clusters"] == 25
        assert np.allclose(cov, other, rtol=1e-3, atol=1e-9)
        for c in ("rms", "inlier_fraction", "n", "covariance_method", "iterations"):
            assert a[m][c] == pytest.approx(b[m][c], rel=1e-4) if c != "covariance_method" else a[m][c] == b[m][c]


def test_distributed_fit_loses_no_edge(spark):
    """A small edge, one without extent and one with few clusters come out with a status or a fallback."""
    df, _ = pairs_frame(spark, edges=1)
    three = df.limit(3).withColumn("moving_id", F.lit("few"))
    flat = df.limit(40).withColumn("moving_id", F.lit("flat")).withColumns({c: F.lit(1.0) for c in ("sx", "sy", "sz")})
    lone = df.withColumn("moving_id", F.lit("lone")).withColumn("cluster", F.col("cluster") % 3)
    keys = ["case_id", "reference_id", "moving_id"]
    both = df.union(three).union(flat.select(df.columns)).union(lone.select(df.columns)).repartition(7)
    got = {r.moving_id: r for r in align.fit_edges_distributed(both, keys, tolerance=1e-2).collect()}
    want = {r.moving_id: r for r in align.fit_edges(both, keys, tolerance=1e-2).collect()}
    assert set(got) == set(want) == {"m0", "few", "flat", "lone"}
    assert {k: r.status for k, r in got.items()} == {k: r.status for k, r in want.items()}
    assert got["lone"].covariance_method == want["lone"].covariance_method == "pointwise_fallback"
    assert np.allclose(got["lone"].cov, want["lone"].cov, rtol=1e-3, atol=1e-9)


def test_failed_fit_is_a_status_row(spark):
    df, _ = pairs_frame(spark, n=3, edges=1)
    r = align.fit_edges(df, ["case_id"]).collect()[0]
    assert r.status != "ok" and r.scale is None


def chain(spark, noise=1e-3):
    """Four windows with edges to both predecessors, exact up to noise."""
    rng = np.random.default_rng(2)
    world = [sim3.IDENTITY, *[random_transform(rng) for _ in range(3)]]
    rows = []
    for j in range(1, 4):
        for i in range(max(0, j - 2), j):
            rel = sim3.relative(world[i], world[j])
            rel = sim3.from_vector(sim3.to_vector(rel) + rng.normal(size=7) * noise)
            rows.append({"case_id": "c", "reference_id": f"w{i}", "moving_id": f"w{j}", **sim3.pack(rel), "cov": (np.eye(7) * 1e-4).ravel().tolist(),
                         "rms": 0.01, "n": 100 + i, "status": "ok", "reference_position": i, "moving_position": j})
    return spark.createDataFrame(pd.DataFrame(rows)), world


def test_gauge_estimators_recover_a_chain(spark):
    edges, world = chain(spark, 1e-5)
    cols = [c.strip().split()[0] for c in gauges.GAUGES.split(",")]
    for table in (
        gauges.sequential_gauges(edges), gauges.joint_tree(edges), gauges.joint_graph(edges), gauges.fixed_lag_gauges(edges, 3), gauges.fixed_lag_gauges(edges, 3, False),
    ):
        for r in table.select(*cols).toPandas().to_dict("records"):
            t = sim3.unpack(r)
            assert np.allclose(sim3.to_vector(sim3.relative(world[int(r["position"])], t)), 0, atol=2e-3)
    with pytest.raises(Exception, match="fixed lag"):
        gauges.fixed_lag_gauges(edges, 2).collect()


def test_tree_covariance_blocks_and_root(spark):
    edges, _ = chain(spark)
    joint = gauges.joint_tree(edges)
    blocks = {(r.window_i, r.window_j): sim3.square(r.block) for r in gauges.covariance_blocks(joint).collect()}
    assert len(blocks) == 16
    assert np.allclose(blocks["w1", "w2"], blocks["w2", "w1"].T)
    root = {r.window_id: np.array(r.block).reshape(7, -1) for r in gauges.covariance_root(joint).collect()}
    assert np.allclose(root["w1"] @ root["w3"].T, blocks["w1", "w3"], atol=1e-7)
    with pytest.raises(Exception, match="trace"):
        gauges.covariance_root(joint, 1).collect()


def test_cycles_and_guard(spark):
    edges, _ = chain(spark, 1e-4)
    cyc = gauges.cycle_audit(edges).toPandas()
    assert len(cyc) == 2 and cyc.displacement.max() < 0.01 and cyc.normalized_score.max() < 1.0
    assert {r["mode"] for r in gauges.guarded_gauges(edges, 1.0).collect()} == {"graph"}
    assert {r["mode"] for r in gauges.guarded_gauges(edges, 1e-9).collect()} == {"tree"}


def estimates(spark, groups=3, k=3):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(groups):
        for c in range(k):
            a = rng.normal(size=(3, 3))
            m = a @ a.T + 0.1 * np.eye(3)
            rows.append((g, f"k{c}", *rng.normal(size=3).tolist(), *[float(m[i, j]) for i, j in IJ]))
    return spark.createDataFrame(rows, "cell int, contributor string, x double, y double, z double, " + ", ".join(f"c_{s} double" for s in SYM))


def dense(r):
    full = np.zeros((3, 3))
    for s, (i, j) in zip(SYM, IJ, strict=True):
        full[i, j] = full[j, i] = r[f"c_{s}"]
    return np.array([r["x"], r["y"], r["z"]], float), full


def test_fusion_methods_match_numpy(spark):
    est = estimates(spark)
    pdf = est.toPandas()
    uni = fusion.fuse(est, ["cell"], "uniform").toPandas().set_index("cell")
    pre = fusion.fuse(est, ["cell"], "precision").toPandas().set_index("cell")
    ci = fusion.fuse(est, ["cell"], "covariance_intersection").toPandas().set_index("cell")
    w = np.array(ci.weights.iloc[0])
    assert w.sum() == pytest.approx(1.0) and len(w) == 3
    for g, rows in pdf.groupby("cell"):
        ms, cs = zip(*[dense(r) for r in rows.sort_values("contributor").to_dict("records")], strict=True)
        mean = np.mean(ms, axis=0)
        assert np.allclose(dense(uni.loc[g])[1], np.mean([c + np.outer(m - mean, m - mean) for m, c in zip(ms, cs, strict=True)], axis=0))
        info = [np.linalg.inv(c) for c in cs]
        cov = np.linalg.inv(sum(info))
        assert np.allclose(dense(pre.loc[g])[1], cov)
        assert np.allclose(dense(pre.loc[g])[0], cov @ sum(i @ m for i, m in zip(info, ms, strict=True)))
        assert np.allclose(dense(ci.loc[g])[1], np.linalg.inv(sum(a * i for a, i in zip(w, info, strict=True))))


def test_ci_is_conservative_and_order_free(spark):
    est = estimates(spark, k=2)
    same = est.where("contributor = 'k0'")
    twice = same.unionByName(same.withColumn("contributor", F.lit("k9")))
    out = fusion.fuse(twice, ["cell"], "covariance_intersection").toPandas().set_index("cell")
    for r in same.toPandas().to_dict("records"):
        assert np.allclose(dense(out.loc[r["cell"]])[1], dense(r)[1])
    a = fusion.fuse(est.repartition(7), ["cell"], "covariance_intersection").toPandas().sort_values("cell")
    b = fusion.fuse(est.coalesce(1), ["cell"], "covariance_intersection").toPandas().sort_values("cell")
    assert np.allclose(a[["x", "c_xx"]], b[["x", "c_xx"]])


def test_near_singular_rows_use_the_floor(spark):
    est = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0)], "cell int, contributor string, x double, y double, z double, " + ", ".join(f"c_{s} double" for s in SYM))
    r = fusion.information(est).collect()[0]
    assert np.isfinite(r.i_xx) and r.i_xx > 1e10


def test_mixing_weights_are_stationary():
    """At the optimum no contributor's gain exceeds the dimension, and those with weight reach it."""
    rng = np.random.default_rng(5)
    for k in (2, 3, 5):
        p = np.array([(lambda a: a @ a.T + 0.1 * np.eye(7))(rng.normal(size=(7, 7)) * rng.uniform(0.2, 3)) for _ in range(k)])
        w = gauges.mixing_weights(p)
        gain = np.trace(np.linalg.solve(np.tensordot(w, p, 1), p), axis1=1, axis2=2)
        assert w.sum() == pytest.approx(1) and w.min() >= 0
        assert gain.max() <= 7 + 1e-6 and np.allclose(gain[w > 1e-6], 7, atol=1e-5)
        assert gauges.mixing_weights(p, 0.05).min() >= 0.05 - 1e-12


def test_many_contributor_weights_use_all_rows(spark):
    """Weights of the distributed rounds are stationary for the mean over every row."""
    rng = np.random.default_rng(8)
    rows = []
    for cell in range(300):
        for c in range(4):
            a = rng.normal(size=(3, 3)) * rng.uniform(0.3, 2)
            m = a @ a.T + 0.05 * np.eye(3)
            rows.append((cell, f"w{c}", *rng.normal(size=3).tolist(), *m[np.triu_indices(3)].tolist()))
    est = spark.createDataFrame(rows, "cell long, contributor string, x double, y double, z double, c_xx double, c_xy double, c_xz double, c_yy double, c_yz double, c_zz double")
    cells = fusion._with_pattern(est, ["cell"])
    (got,) = fusion.nway_weights(cells, ["pattern"]).collect()
    w = np.array(got.weights)
    info = np.array([[[m[i] for i in fusion.INFO] for m in r.members] for r in cells.collect()])[:, :, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(300, 4, 3, 3)
    gain = np.trace(np.linalg.solve(np.einsum("k,nkij->nij", w, info)[:, None], info), axis1=2, axis2=3).mean(axis=0)
    assert w.sum() == pytest.approx(1) and gain.max() <= 3 + 1e-6
    assert np.allclose(gain[w > 1e-6], 3, atol=1e-5)


def test_window_order_is_canonical_not_alphabetic(spark):
    """Twelve windows w0..w11: w10 comes after w9, and the tree takes every case."""
    cols = "case_id string, window_id string, frame long, row int, col int, x double, y double, z double, valid boolean"
    rng = np.random.default_rng(3)
    rows = [("c", f"w{w}", f, 0, c, *rng.normal(size=3).tolist(), True) for w in range(12) for f in (w, w + 1) for c in range(6)]
    samples = spark.createDataFrame(rows, cols)
    got = {(r.reference_id, r.moving_id) for r in joins.overlap_correspondences(samples).collect()}
    assert got == {(f"w{i}", f"w{i + 1}") for i in range(11)}
    assert {(r.reference_id, r.moving_id) for r in joins.all_edges(samples).collect()} == got
