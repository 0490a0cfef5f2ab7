"""Joint covariances, causal tracks, image grids and ray ranges against dense or step-by-step versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsfuse.operators import disagreement, gaussian, project, tracks

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")
FULL = [0, 1, 2, 1, 3, 4, 2, 4, 5]


def spd(rng: np.random.Generator, n: int) -> np.ndarray:
    a = rng.normal(size=(n, n))
    return a @ a.T / n + 0.1 * np.eye(n)


def packed(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def blocks_of(spark, joint: np.ndarray, names: list[str]):
    rows = [("c", a, b, joint[7 * i : 7 * i + 7, 7 * j : 7 * j + 7].ravel().tolist()) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "case_id string, window_i string, window_j string, block array<double>")


# --- joint covariance ------------------------------------------------------------------------


def test_link_evidence_uses_the_cross_blocks(spark):
    rng = np.random.default_rng(1)
    joint = spd(rng, 14)
    rows, jac, cov, at = [], {}, {}, {}
    for w, ids in (("a", (1, 2)), ("b", (11, 12))):
        for t in ids:
            for frame in range(3):
                key = (t, frame)
                at[key], jac[key], cov[key] = 0.02 * rng.normal(size=3) + t % 10, rng.normal(size=(3, 7)), spd(rng, 3)
                rows.append(("c", w, t, frame, *map(float, at[key]), 0.5 + 0.1 * frame, jac[key].ravel().tolist(), *packed(cov[key])))
    columns = "case_id string, window_id string, track_id long, frame long, x double, y double, z double, association_probability double, jacobian array<double>, "
    df = spark.createDataFrame(rows, columns + ", ".join(f"k_{s} double" for s in SYM))
    left, right = df.where("window_id = 'a'"), df.where("window_id = 'b'")
    cfg = tracks.AssociationConfig(distance=0.5, distance_scale=0.2)
    got = tracks.joint_link_evidence(left, right, blocks_of(spark, joint, ["a", "b"]), cfg).toPandas()
    assert set(zip(got.left_id, got.right_id, strict=True)) == {(1, 11), (2, 12)}
    for r in got.itertuples():
        num = den = 0.0
        for frame in range(3):
            l, q = (r.left_id, frame), (r.right_id, frame)  # noqa: E741
            both = np.hstack([jac[l], -jac[q]])
            total = cov[l] + cov[q] + both @ joint @ both.T
            d = at[l] - at[q]
            w = (0.5 + 0.1 * frame) ** 2
            num, den = num + w * (d @ np.linalg.solve(total, d)) / 3, den + w
        assert r.normalized_rms == pytest.approx(np.sqrt(num / den), rel=1e-9)
    plain = tracks.candidate_scores(left, right, cfg).toPandas().set_index(["left_id", "right_id"])
    for r in got.itertuples():  # score and support stay geometric
        assert r.score == plain.loc[(r.left_id, r.right_id), "score"] and r.support == plain.loc[(r.left_id, r.right_id), "support"]


def test_gauge_query_equals_the_dense_product(spark):
    rng = np.random.default_rng(2)
    names = ["w0", "w1", "w2", "w3"]
    joint, n, q = spd(rng, 28), 40, 3
    window = rng.integers(0, 3, n)  # the last window has no rows
    jac, cov, a = rng.normal(size=(n, 3, 7)), [spd(rng, 3) for _ in range(n)], rng.normal(size=(q, n, 3))
    rows = [("c", names[window[i]], i, jac[i].ravel().tolist(), *packed(cov[i]), a[:, i].ravel().tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id string, window_id string, row_id long, jacobian array<double>, " + ", ".join(f"k_{s} double" for s in SYM) + ", query array<double>")
    got = gaussian.gauge_query(df.repartition(3), blocks_of(spark, joint, names), q).first()
    dense = np.zeros((3 * n, 28))
    for i in range(n):
        dense[3 * i : 3 * i + 3, 7 * window[i] : 7 * window[i] + 7] = jac[i]
    flat = a.reshape(q, 3 * n)
    conditional = sum(a[:, i] @ cov[i] @ a[:, i].T for i in range(n))
    gauge = flat @ dense @ joint @ dense.T @ flat.T
    assert got.n == n
    for name, want in (("conditional", conditional), ("gauge", gauge), ("marginal", conditional + gauge)):
        assert np.allclose(np.reshape(got[name], (q, q)), want)


# --- causal tracks -----------------------------------------------------------------------------


def stepwise(df: pd.DataFrame, stop: int, seeds: list[tuple[int, int]], cfg: tracks.LinkConfig) -> tuple[set, dict]:
    """Tracks of one window, frame by frame."""
    sigma = cfg.sigma or cfg.maximum_error / 3
    frames = sorted(f for f in df.frame.unique() if f < stop)
    pix = {(r.frame, r.row, r.col): r for r in df.itertuples()}
    start = [s for s in sorted(seeds) if (p := pix.get((frames[0], *s))) is not None and p.valid and p.deform]
    told = {t: [(frames[0], *s, 1.0)] for t, s in enumerate(start)}
    active, why = dict(enumerate(start)), {}
    for f, g in zip(frames, frames[1:], strict=False):
        claims: dict = {}
        for t, (r, c) in active.items():
            p = pix[(f, r, c)]
            if not (p.valid and p.deform):
                why[t] = "invalid-source"
                continue
            near = [pix[k] for a in range(-cfg.radius, cfg.radius + 1) for b in range(-cfg.radius, cfg.radius + 1) if (k := (g, r + a, c + b)) in pix and pix[k].valid]
            usable = [n for n in near if n.deform or not cfg.require_target_deform]
            if not usable:
                why[t] = "target-mask" if near else "no-candidate"
                continue
            ahead = np.array([p.x + p.fx, p.y + p.fy, p.z + p.fz])
            e = sorted((float(np.linalg.norm([n.x - ahead[0], n.y - ahead[1], n.z - ahead[2]])), n.row, n.col) for n in usable)
            link = np.exp(-0.5 * (e[0][0] / sigma) ** 2) * (1 if len(e) == 1 else 1 - np.exp(-0.5 * ((e[1][0] - e[0][0]) / sigma) ** 2))
            if e[0][0] > cfg.maximum_error:
                why[t] = "step-error"
            elif link < cfg.minimum_link:
                why[t] = "low-probability"
            else:
                claims.setdefault(e[0][1:], []).append((-link, e[0][0], t))
        active = {}
        for at, bids in claims.items():
            bids.sort()
            for _, _, t in bids[1:]:
                why[t] = "collision"
            active[bids[0][2]] = at
            told[bids[0][2]].append((g, *at, -bids[0][0]))
    kept = [t for t in sorted(told) if len(told[t]) >= cfg.minimum_length]
    reasons = list(why.values()) + ["short"] * (len(told) - len(kept))
    rows = {(i, f, r, c, round(float(p), 9)) for i, t in enumerate(kept) for f, r, c, p in told[t]}
    return rows, {r: reasons.count(r) for r in set(reasons)}


def movie(seed: int, frames: int = 7, n: int = 12, flat: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        for r in range(n):
            for c in range(n):
                if rng.random() < 0.75:
                    noise = np.zeros(3) if flat else 0.3 * rng.normal(size=3)
                    flow = rng.integers(-1, 2, 3) * [0.75, 0.75, 0.0] if flat else 0.3 * rng.normal(size=3)
                    rows.append(("c", "w", 2 * f, r, c, c + noise[0], r + noise[1], 0.0 + noise[2], *map(float, flow), bool(rng.random() < 0.9), bool(rng.random() < 0.85)))
    names = ["case_id", "window_id", "frame", "row", "col", "x", "y", "z", "fx", "fy", "fz", "valid", "deform"]
    return pd.DataFrame(rows, columns=names)


@pytest.mark.parametrize(("seed", "flat", "mask"), [(1, False, False), (2, False, True), (3, True, True), (4, True, False)])
def test_causal_tracks_equal_a_walk_over_frames(spark, seed, flat, mask):
    """``flat`` movies are full of exactly equal errors, so ties of claims are met in chains."""
    pdf = movie(seed, flat=flat)
    cfg = tracks.LinkConfig(radius=2, maximum_error=0.9, sigma=0.7, minimum_link=1e-3 if not flat else 1e-9, require_target_deform=mask)
    seeds = [(r, c) for r in range(12) for c in range(12) if (r + c) % 2 == 0]
    df = spark.createDataFrame(pdf).repartition(3)
    seed_df = spark.createDataFrame([("c", "w", r, c) for r, c in seeds], "case_id string, window_id string, row long, col long")
    out, report = tracks.causal_tracklets(df, 10, seed_df, cfg)
    want, reasons = stepwise(pdf, 10, seeds, cfg)
    got = {(r.track_id, r.frame, r.row, r.col, round(r.link_probability, 9)) for r in out.collect()}
    assert got == want
    assert {r.reason: r.tracks for r in report.collect()} == reasons
    assert reasons.get("collision", 0) > 0
    product = out.groupBy("track_id").agg(F.max_by("association_probability", "frame").alias("a"), F.product("link_probability").alias("p"))
    assert all(r.a == pytest.approx(r.p) for r in product.collect())


def test_causal_tracks_ignore_what_comes_later(spark):
    pdf = movie(5)
    cfg = tracks.LinkConfig(radius=2, maximum_error=0.9, sigma=0.7, minimum_link=1e-3)
    seeds = spark.createDataFrame([("c", "w", r, r) for r in range(12)], "case_id string, window_id string, row long, col long")
    changed = pdf.assign(x=pdf.x + np.where(pdf.frame >= 8, 5.0, 0.0))
    a, b = (sorted(tracks.causal_tracklets(spark.createDataFrame(p), 8, seeds, cfg)[0].collect()) for p in (pdf, changed))
    assert a == b
    with pytest.raises(ValueError, match="seed"):
        tracks.causal_tracklets(spark.createDataFrame(pdf), 8, seeds.where("row > 99"), cfg)


# --- image grids -------------------------------------------------------------------------------


def test_farthest_points_equal_the_greedy_choice(spark):
    rng = np.random.default_rng(4)
    masks = {f: rng.random((9, 11)) < p for f, p in ((0, 0.6), (1, 0.2), (2, 0.03))}
    rows = [("c", "w", f, r, c, bool(m[r, c])) for f, m in masks.items() for r in range(9) for c in range(11)]
    df = spark.createDataFrame(rows, "case_id string, window_id string, frame long, row int, col int, valid boolean").repartition(3)
    for shape in (None, (9, 11)):
        got = project.farthest_points(df, 6, shape=shape).orderBy("frame", "rank").collect()
        for f, m in masks.items():
            pts = np.argwhere(m)
            picks = [int(np.argmin(((pts - [4, 5]) ** 2).sum(1)))] if len(pts) else []
            while 0 < len(picks) < min(6, len(pts)):
                d = ((pts[:, None] - pts[picks][None]) ** 2).sum(-1).min(1)
                picks.append(int(np.argmax(d)))
            assert [(r.row, r.col) for r in got if r.frame == f] == [tuple(p) for p in pts[picks].tolist()]


@pytest.mark.parametrize("target", [(3, 4), (5, 6), (11, 9), (1, 1)])
def test_resampling_covers_the_grid_and_cuts_at_half_support(spark, target):
    rng = np.random.default_rng(5)
    src, mask = rng.random((5, 6)), rng.random((5, 6)) > 0.4
    rows = [(1, r, c, float(src[r, c]) if mask[r, c] else float("nan"), bool(mask[r, c])) for r in range(5) for c in range(6)]
    df = spark.createDataFrame(rows, "f int, row int, col int, v double, valid boolean")
    got = {(r.row, r.col): r for r in project.resample_grid(df, (5, 6), target, ["v"], ["f"]).collect()}
    assert len(got) == target[0] * target[1]
    for i, y in enumerate(np.linspace(0, 4, target[0])):
        for j, x in enumerate(np.linspace(0, 5, target[1])):
            w = np.maximum(0, 1 - np.abs(np.arange(5) - y))[:, None] * np.maximum(0, 1 - np.abs(np.arange(6) - x))[None] * mask
            r = got[(i, j)]
            assert r.support == pytest.approx(w.sum()) and r.valid == (r.support >= 0.5)
            assert r.v == (pytest.approx((w * src).sum() / w.sum()) if r.valid else 0.0)


def test_resampling_shuffles_pixels_and_not_cells(spark):
    df = spark.createDataFrame([(f, r, c, 1.0, r % 2 == 0) for f in range(3) for r in range(40) for c in range(50)] + [(9, 0, 0, 1.0, False)], "f int, row int, col int, v double, valid boolean")
    out = project.resample_grid(df, (40, 50), (55, 60), ["v"], ["f"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # cells gather their neighbours inside a band
    assert out.count() == 4 * 55 * 60 and out.where("f = 9 AND support = 0 AND NOT valid").count() == 55 * 60


def test_links_meet_in_tiles_and_not_by_every_offset(spark):
    rng = np.random.default_rng(8)
    rows = [("c", "w", f, r, c, *rng.random(3).tolist(), bool(rng.random() > 0.2), bool(rng.random() > 0.2)) for f in range(2) for r in range(14) for c in range(17) if rng.random() > 0.3]
    names = ["case_id", "window_id", "local", "row", "col", "x", "y", "z", "valid", "deform"]
    pix = spark.createDataFrame(rows, "case_id string, window_id string, local int, row int, col int, x double, y double, z double, valid boolean, deform boolean")
    out = tracks.pixel_links(pix.withColumns({f"f{c}": F.lit(0.1) for c in "xyz"}), tracks.LinkConfig(radius=3, maximum_error=1.0, minimum_link=0.0))
    generated = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert generated and all("sequence" in line for line in generated)
    data = [dict(zip(names, r, strict=True)) for r in rows]
    for got in out.where("local = 0").collect():
        here = next(d for d in data if (d["local"], d["row"], d["col"]) == (0, got.row, got.col))
        near = [d for d in data if d["local"] == 1 and d["valid"] and abs(d["row"] - got.row) <= 3 and abs(d["col"] - got.col) <= 3]
        found = sorted((float(np.sqrt(sum((d[c] - here[c] - 0.1) ** 2 for c in "xyz"))), d["row"], d["col"]) for d in near)
        assert (got.to_row, got.to_col) == ((found[0][1], found[0][2]) if found else (None, None))


# --- ranges ------------------------------------------------------------------------------------------


def test_range_status_names_what_is_wrong(spark):
    rng = np.random.default_rng(6)
    centre, rows = np.array([1.0, 2.0, -3.0]), []

    def add(frame: int, n: int, make) -> None:
        for i in range(n):
            p = rng.normal(size=3) + [0, 0, 5]
            ray, point = make(p, i)
            rows.append(("c", "w", frame, i, 0, *map(float, point), *map(float, ray), True))

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.linalg.norm(v)

    add(0, 12, lambda p, i: (unit(p - centre), p))
    add(1, 2, lambda p, i: (unit(p - centre), p))
    add(2, 12, lambda p, i: (np.array([0.0, 0.0, 1.0]), p))
    near = [unit(np.array([0.0, 0.0, 1.0]) + 1e-8 * rng.normal(size=3)) for _ in range(12)]
    add(3, 12, lambda p, i: (near[i], p))
    add(4, 12, lambda p, i: (unit(p - centre), p + (0.01 if i == 3 else 0.0)))
    add(5, 12, lambda p, i: (-unit(p - centre) if i == 7 else unit(p - centre), p))
    rows.append(("c", "w", 6, 0, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, False))
    df = spark.createDataFrame(rows, "case_id string, window_id string, frame long, row int, col int, x double, y double, z double, rx double, ry double, rz double, valid boolean")
    got = {r.frame: r for r in disagreement.range_status(df).collect()}
    wanted = ["ok", "too-few-rays", "ill-conditioned", "ill-conditioned", "inconsistent-rays", "inconsistent-rays", "too-few-rays"]
    assert [got[f].status for f in range(7)] == wanted
    assert np.allclose([got[0].cx, got[0].cy, got[0].cz], centre) and got[2].cx is None
    var = disagreement.range_variances(df, None).collect()
    assert {r.frame for r in var} == {0} and len(var) == 12
    for r in var:
        assert r.var_par == pytest.approx(2.5e-4 + 2.5e-5 * np.sum((np.array([r.x, r.y, r.z]) - centre) ** 2))
