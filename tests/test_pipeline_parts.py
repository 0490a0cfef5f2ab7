"""Ingest, tracks, projections, sinks, streaming."""

import json
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsfuse.operators import project, tracks
from obsfuse.plans.registry import REGISTRY
from obsfuse.sources import archives, manifests, tables
from obsfuse.streaming import admission, incremental


def write_window(path, frames, h=4, w=5, flow=True, shift=0.0, **extra):
    rng = np.random.default_rng(0)
    t = len(frames)
    base = np.stack(np.meshgrid(np.arange(h), np.arange(w), indexing="ij"), -1).astype(float)
    pts = np.zeros((t, h, w, 3))
    for k, f in enumerate(frames):
        pts[k, ..., :2] = base
        pts[k, ..., 2] = 5 + 0.1 * f + shift
    out = {"frame_indices": np.array(frames), "point_map": pts + rng.normal(size=pts.shape) * 1e-4, "valid_mask": np.ones((t, h, w), bool)}
    if flow:
        out["scene_flow"] = np.zeros_like(pts)
        out["scene_flow"][..., 2] = 0.1
        out["deform_mask"] = np.ones((t, h, w), bool)
    np.savez(path, **(out | extra))


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="obs-", dir="/tmp")
    write_window(f"{d}/w0.npz", [0, 1, 2])
    write_window(f"{d}/w1.npz", [1, 2, 3], shift=0.5)
    return d


def test_ingest_and_bundle(spark, folder):
    out = tempfile.mkdtemp(prefix="obs-out-", dir="/tmp")
    archives.ingest_archives(spark, folder, f"{out}/s", case_id="c")
    df = spark.read.parquet(f"{out}/s")
    assert df.count() == 2 * 3 * 20 and df.select("window_id").distinct().count() == 2
    archives.check_grid(df)
    m = {"overlap_windows": [{"window_id": "w0", "path": "w0.npz", "start_frame": 0, "stop_frame": 3}], "disjoint_baseline": "w1.npz", "latent_linear_baseline": None}
    with open(f"{out}/m.json", "w") as f:
        json.dump(m, f)
    listed = manifests.bundle_windows(spark, f"{out}/m.json").toPandas()
    assert set(listed.window_id) == {"w0", "baseline_disjoint"}
    with open(f"{folder}/m.json", "w") as f:
        json.dump(m, f)
    assert manifests.read_bundle(spark, f"{folder}/m.json", "c").where("error IS NULL").count() == 120


def test_bad_archives_are_quarantined(spark):
    d = tempfile.mkdtemp(prefix="obs-bad-", dir="/tmp")
    pts = np.zeros((1, 2, 2, 3))
    np.savez(f"{d}/half.npz", point_map=pts, valid_mask=np.ones((1, 2, 2), bool), frame_indices=np.array([0]), scene_flow=pts)
    np.savez(f"{d}/nan.npz", point_map=pts * np.nan, valid_mask=np.ones((1, 2, 2), bool), frame_indices=np.array([0]))
    np.savez(f"{d}/masked.npz", point_map=pts * np.nan, valid_mask=np.zeros((1, 2, 2), bool), frame_indices=np.array([0]))
    got = archives.read_archives(spark, d, "c").toPandas()
    assert got.error.notna().sum() == 2 and got.error.isna().sum() == 4
    with pytest.raises(ValueError, match="refused"):
        archives.ingest_archives(spark, d, f"{d}/out", case_id="c")


def test_provider_manifest(spark):
    d = tempfile.mkdtemp(prefix="obs-man-", dir="/tmp")
    lin = [{"output_frame_id": i, "source_frame_start": 0, "source_frame_stop_exclusive": 3 + i, "contributor_ids": ["a"]} for i in range(3)]
    p = {"payload_id": "p", "product_role": "r", "window_id": "w", "path": "x.npz", "sha256": "0" * 64, "byte_count": 1, "view_id": "v", "stochastic_member_id": "m",
         "dependence_group_ids": ["d"], "dense_storage_dtype": "float32", "has_scene_flow": False, "has_ray_directions": False, "frame_lineage": lin}
    with open(f"{d}/m.json", "w") as f:
        json.dump({"artifact_id": "a", "sequence_id": "s", "provider_family": "f", "coordinate_semantics": "metric-world", "payloads": [p]}, f)
    _, lineage = manifests.provider_payloads(spark, f"{d}/m.json")
    assert project.admitted_payloads(lineage, 5).count() == 1 and project.admitted_payloads(lineage, 4).count() == 0


def test_causal_tracklets_follow_flow_and_ignore_the_future(spark, folder):
    df = archives.read_archives(spark, folder, "c").where("error IS NULL AND window_id = 'w0'").drop("error")
    seeds = tracks.spatial_seeds(df.where("frame = 0"), 4, 5, 2, (2, 2))
    cfg = tracks.LinkConfig(radius=1, maximum_error=0.05)
    out, report = tracks.causal_tracklets(df, 3, seeds, cfg)
    rows = out.toPandas()
    assert rows.groupby("track_id").frame.count().eq(3).all() and rows.groupby("track_id").row.nunique().eq(1).all()
    assert {r.reason: r.tracks for r in report.collect()} == {}
    short, _ = tracks.causal_tracklets(df, 2, seeds, cfg)
    a = rows[rows.frame < 2].sort_values(["track_id", "frame"]).association_probability
    b = short.toPandas().sort_values(["track_id", "frame"]).association_probability
    assert np.allclose(a, b)


def test_seeds_cover_cells(spark):
    pix = spark.createDataFrame([("c", "w", r, c) for r in range(8) for c in range(8)], "case_id string, window_id string, row int, col int")
    s = tracks.spatial_seeds(pix, 8, 8, 4, (2, 2), 2).toPandas()
    assert s.groupby("cell_id").size().tolist() == [2, 2, 2, 2] and (1, 1) in set(zip(s.row, s.col, strict=True))
    assert tracks.spatial_seeds(pix, 8, 8, 4, (2, 2), regular=True).count() == 4


def test_causal_prefix(spark):
    m = spark.createDataFrame([("c", "a", 0, 5, 0), ("c", "b", 3, 8, 1), ("c", "d", 6, 11, 2)], "case_id string, window_id string, start_frame int, stop_frame int, position int")
    assert {r.window_id for r in project.causal_windows(m, 8).collect()} == {"a", "b"}
    bad = m.withColumn("stop_frame", F.when(F.col("window_id") == "a", 99).otherwise(F.col("stop_frame")))
    with pytest.raises(ValueError, match="prefix"):
        project.causal_windows(bad, 8)


def test_resample_matches_dense(spark):
    rng = np.random.default_rng(0)
    src, mask = rng.random((5, 6)), rng.random((5, 6)) > 0.3
    df = spark.createDataFrame(pd.DataFrame([(1, r, c, float(src[r, c]), bool(mask[r, c])) for r in range(5) for c in range(6)], columns=["f", "row", "col", "v", "valid"]))
    got = project.resample_grid(df, (5, 6), (3, 4), ["v"], ["f"]).toPandas().set_index(["row", "col"])
    for i, y in enumerate(np.linspace(0, 4, 3)):
        for j, x in enumerate(np.linspace(0, 5, 4)):
            w = np.maximum(0, 1 - np.abs(np.arange(5) - y))[:, None] * np.maximum(0, 1 - np.abs(np.arange(6) - x))[None] * mask
            if w.sum() > 1e-9:
                assert got.loc[(i, j), "support"] == pytest.approx(w.sum())
                assert got.loc[(i, j), "v"] == pytest.approx((w * src).sum() / w.sum() if w.sum() >= 0.5 else 0.0)


def test_error_basis_is_orthonormal(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 1.0, 2.0, 3.0), (1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 2.0, 3.0)], "rx double, ry double, rz double, qx double, qy double, qz double, ex double, ey double, ez double")
    for r in project.error_basis(df).collect():
        assert r.e_ray**2 + r.e_tangent**2 + r.e_normal**2 == pytest.approx(14.0)


def test_fused_sink_round_trip(spark):
    d = tempfile.mkdtemp(prefix="obs-fused-", dir="/tmp")
    df = spark.createDataFrame([("c1", 0, 0, 0, 1.0, 2.0, 3.0, *[0.5] * 6, 2)], "case_id string, frame long, row int, col int, x double, y double, z double, " + ", ".join(f"c_{s} double" for s in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", contributors int")
    tables.write_fused(df, f"{d}/f", "m1", "precision")
    tables.write_fused(df, f"{d}/f", "m2", "uniform")
    back = tables.read_fused(spark, f"{d}/f", ["m1"])
    assert back.count() == 1 and back.first().x == 1.0 and back.first().deform is None
    with pytest.raises(ValueError, match="columns changed"):
        tables.write_fused(df.withColumn("oops", F.lit(1)), f"{d}/g", "m", "uniform")


def test_digest_is_order_free(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = tables.content_digest(df).first(), tables.content_digest(df.repartition(7)).first()
    assert a == b and a != tables.content_digest(df.withColumn("v", F.col("v") + F.when(F.col("id") == 5, 1).otherwise(0))).first()


UPDATES = [("s", "a", 0, 5), ("s", "b", 5, 9), ("s", "c", 12, 15), ("s", "a2", 4, 9), ("s", "d", 9, 12), ("t", "x", 3, 4)]


def updates(spark):
    return spark.createDataFrame(UPDATES, "stream_id string, update_id string, start long, stop long").withColumns({"identity": F.lit("i"), "content_hash": F.col("update_id")})


def test_admission_batch_and_stream_agree(spark):
    judged = admission.admit_batch(updates(spark)).toPandas().set_index("update_id")
    assert judged.loc[["a", "b", "d", "c", "x"]].admitted.all() and judged.loc["a2", "reason"] == "reopened-interval"
    d = tempfile.mkdtemp(prefix="obs-stream-", dir="/tmp")
    updates(spark).where("start < 6").coalesce(1).write.parquet(f"{d}/in/1")
    src = spark.readStream.schema(updates(spark).schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    incremental.run_available(admission.admit_stream(src), f"{d}/out")
    updates(spark).where("start >= 6").coalesce(1).write.parquet(f"{d}/in/2")  # a later micro-batch
    incremental.run_available(admission.admit_stream(src), f"{d}/out")
    got = spark.read.parquet(f"{d}/out").toPandas().set_index("update_id")
    assert got.sort_index()[["admitted", "chain_id"]].equals(judged.sort_index()[["admitted", "chain_id"]])


def test_admission_rules():
    s, why = admission.admit_identity({"windows": ["w0"]}, {"identity": "w1", "sources": ["w0"], "stops": [3]})
    assert why is None and s["windows"] == ["w0", "w1"]
    for row, want in (
        ({"identity": "w0", "sources": ["w0"]}, "target-already-admitted"),
        ({"identity": "w2", "sources": ["w9"]}, "source-not-admitted"),
        ({"identity": "w2", "sources": ["w0", "w0"]}, "repeated-source"),
        ({"identity": "w2", "sources": ["w0", "w1"], "stops": [1, 2]}, "causal-stop-differs"),
    ):
        assert admission.admit_identity(s, row)[1] == want
    b, why = admission.admit_bias({}, {"start": 0, "stop": 2, "identity": "m", "update_id": "u", "rows": 4})
    assert why is None and b["rows"] == 4
    assert admission.admit_bias(b, {"start": 1, "stop": 3, "identity": "m", "update_id": "v"})[1] == "overlaps-retained"
    assert admission.admit_bias(b, {"start": 2, "stop": 3, "identity": "n", "update_id": "v"})[1] == "model-changed"
    assert admission.admit_decision({"done": True}, {})[1] == "group-already-decided"


def test_ledger_is_append_only(spark):
    d = tempfile.mkdtemp(prefix="obs-ledger-", dir="/tmp")
    sink = incremental.append_ledger(f"{d}/l")
    rows = spark.createDataFrame([("g1", True, True), ("g2", False, True)], "group_id string, accepted boolean, exact_fallback boolean")
    sink(rows, 0)
    sink(rows.unionByName(spark.createDataFrame([("g3", True, True)], rows.schema)), 1)
    s = incremental.ledger_summary(spark.read.parquet(f"{d}/l")).first()
    assert (s.groups, s.accepted, s.fallback) == (3, 2, 1)


def test_catalogue_is_complete():
    from __spark_entry__ import oracle_sql, queries

    assert len(queries()) >= 90 and set(oracle_sql()) <= set(queries())
    assert {"residual_scorecard", "fuse_ci_pair", "stream_admission"} <= set(REGISTRY)
