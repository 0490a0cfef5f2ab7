"""Gauge trees by pointer doubling against a dense sequential walk in NumPy."""

import numpy as np
import pandas as pd
import pytest

from obsfuse.functions import sim3
from obsfuse.operators import gauge_trees as gt
from obsfuse.operators.gauges import START


def random_edges(rng, case, windows, missing=()):
    """Edges from one to three earlier windows for all but the ``missing`` windows."""
    rows = []
    for j in range(1, windows):
        for i in rng.choice(j, min(j, 3), replace=False) if j not in missing else ():
            root = rng.normal(size=(7, 7)) * 0.02
            t = sim3.from_vector(rng.normal(size=7) * 0.4)
            rows.append({"case_id": case, "reference_id": f"w{i:03}", "moving_id": f"w{j:03}", **sim3.pack(t), "cov": (root @ root.T).ravel().tolist(),
                         "rms": float(rng.integers(3)), "n": int(rng.integers(5)), "status": "ok", "reference_position": int(i), "moving_position": j})
    return rows


def dense(rows, windows):
    """Global transforms, parents and the whole covariance, one window after the other."""
    joint = np.zeros((7 * windows, 7 * windows))
    ts, parents, roots = [], [], []
    for j in range(windows):
        own = slice(7 * j, 7 * j + 7)
        options = [r for r in rows if r["moving_position"] == j]
        if not options:
            joint[own, own] = START
            ts.append(sim3.IDENTITY)
            parents.append(None)
            roots.append(j)
            continue
        r = min(options, key=lambda r: (-r["n"], r["rms"], r["reference_position"]))
        p = r["reference_position"]
        ja, jb = sim3.compose_jacobians(ts[p], sim3.unpack(r))
        joint[own, : 7 * j] = ja @ joint[7 * p : 7 * p + 7, : 7 * j]
        joint[: 7 * j, own] = joint[own, : 7 * j].T
        joint[own, own] = ja @ joint[7 * p : 7 * p + 7, 7 * p : 7 * p + 7] @ ja.T + jb @ sim3.square(r["cov"]) @ jb.T
        ts.append(sim3.compose(ts[p], sim3.unpack(r)))
        parents.append(p)
        roots.append(roots[p])
    return ts, joint, parents, roots


def test_tree_and_blocks_equal_the_dense_walk(spark):
    rng = np.random.default_rng(5)
    size = {"a": 12, "b": 9}
    rows = {"a": random_edges(rng, "a", 12, missing={5}), "b": random_edges(rng, "b", 9)}
    failed = {**rows["b"][0], "moving_id": "w008", "moving_position": 8, "n": 99, "status": "few_points"}
    edges = spark.createDataFrame(pd.DataFrame([*rows["a"], *rows["b"], failed]))
    tree = gt.tree_gauges(edges)
    paths = gt.ancestors(tree)
    solved = gt.tree_covariances(tree, paths)
    got = {(r.case_id, r.position): r for r in solved.collect()}
    pairs = spark.createDataFrame([(c, f"w{i:03}", f"w{j:03}") for c, n in size.items() for i in range(n) for j in range(n)], "case_id string, window_i string, window_j string")
    blocks = {(r.case_id, int(r.window_i[1:]), int(r.window_j[1:])): sim3.square(r.block) for r in gt.tree_blocks(solved, paths, pairs.union(pairs)).collect()}
    for case, n in size.items():
        ts, joint, parents, roots = dense(rows[case], n)
        for j in range(n):
            r = got[case, j]
            assert r.parent_id == (None if parents[j] is None else f"w{parents[j]:03}")
            assert r.status == ("ok" if roots[j] == 0 else "no-causal-overlap" if parents[j] is None else "detached")
            assert np.allclose(sim3.to_vector(sim3.unpack(r.asDict())), sim3.to_vector(ts[j]), atol=1e-9)
            assert np.allclose(sim3.square(r.cov), joint[7 * j : 7 * j + 7, 7 * j : 7 * j + 7], atol=1e-9)
            for i in range(n):
                if roots[i] != roots[j]:
                    assert (case, i, j) not in blocks
                else:
                    assert np.allclose(blocks[case, i, j], joint[7 * i : 7 * i + 7, 7 * j : 7 * j + 7], atol=1e-9), (case, i, j)


@pytest.mark.parametrize("windows", [1, 2, 33])
def test_long_chain_and_star(spark, windows):
    """A chain doubles its pointers; a star has one hot root."""
    half = {**sim3.pack((0.5, np.eye(3), np.array([1.0, 0.0, 0.0]))), "cov": [0.0] * 49, "rms": 0.0, "n": 1, "status": "ok"}
    rows = [{"case_id": kind, "reference_id": f"w{p:03}", "moving_id": f"w{j:03}", **half, "reference_position": p, "moving_position": j}
            for kind in ("chain", "star") for j in range(1, windows + 1) for p in [j - 1 if kind == "chain" else 0]]
    tree = gt.tree_gauges(spark.createDataFrame(pd.DataFrame(rows)))
    for r in tree.collect():
        depth = r.position if r.case_id == "chain" else min(r.position, 1)
        assert (r.depth, r.root_id, r.status) == (depth, "w000", "ok")
        assert r.scale == pytest.approx(0.5**depth) and r.tx == pytest.approx(2 - 2 * 0.5**depth)
    n = gt.ancestors(tree).groupBy("case_id").count().collect()
    assert {r["case_id"]: r["count"] for r in n} == {"chain": (windows + 1) * (windows + 2) // 2, "star": 2 * windows + 1}


def test_no_edges(spark):
    edges = spark.createDataFrame(pd.DataFrame(random_edges(np.random.default_rng(1), "a", 3))).limit(0)
    tree = gt.tree_gauges(edges)
    assert tree.count() == 0 and gt.tree_covariances(tree, gt.ancestors(tree)).count() == 0


def test_pairs_of_windows_stay_single_rows(spark, monkeypatch):
    """The paths of a pair meet as arrays: no plan of the blocks groups pairs by their ancestors, and only windows with others below are copied wide."""
    from obsfuse.functions import sim3 as s3

    good = [("c", f"w{j // 2 if j > 1 else 0}", f"w{j}", j // 2 if j > 1 else 0, j, "ok", 5, 0.1, 1.01, *np.eye(3).ravel().tolist(), 0.1 * j, 0.0, 0.0, (np.eye(7) * 1e-3).ravel().tolist()) for j in range(1, 30)]
    names = "case_id string, reference_id string, moving_id string, reference_position long, moving_position long, status string, n long, rms double, scale double, "
    edges = spark.createDataFrame(good, names + ", ".join(f"{c} double" for c in (*s3.ROT, "tx", "ty", "tz")) + ", cov array<double>")
    tree = gt.tree_gauges(edges)
    paths = gt.ancestors(tree)
    solved = gt.tree_covariances(tree, paths).localCheckpoint()
    pairs = spark.createDataFrame([("c", f"w{i}", f"w{j}") for i in range(30) for j in range(30)], "case_id string, window_i string, window_j string")
    wide = []
    real = gt.attach_few
    monkeypatch.setattr(gt, "attach_few", lambda f, s, *a, **k: wide.append((f, s)) or real(f, s, *a, **k))
    blocks = {(r.window_i, r.window_j): np.array(r.block).reshape(7, 7) for r in gt.tree_blocks(solved, paths, pairs).collect()}
    ((meet, tops),) = wide
    plan = meet._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and meet.count() == 900 == len(blocks)
    assert tops.count() == 30  # the pairs of a window with itself ask for all
    covs = {r.window_id: np.array(r["cov"]).reshape(7, 7) for r in solved.collect()}
    for (i, j), block in blocks.items():
        np.testing.assert_allclose(block, blocks[j, i].T, atol=1e-12)
        if i == j:
            np.testing.assert_allclose(block, covs[i], atol=1e-12)
    wide.clear()
    assert gt.tree_blocks(solved, paths, pairs.where("window_i <> window_j")).count() == 870 and wide[0][1].count() == 15
