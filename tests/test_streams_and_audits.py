"""Half turns, identity streams, late rows, support audits and the fused table."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.operators import joins
from obsfuse.sources import tables
from obsfuse.streaming import admission, incremental

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")


def folder() -> str:
    return tempfile.mkdtemp(prefix="obs-stream-", dir="/tmp")


@pytest.mark.parametrize("axis", [(-0.1, 0.8, 0.3), (0.0, -1.0, 0.2), (0.0, 0.0, -1.0), (1.0, -1.0, 1.0), (-1.0, 1e-9, 0.0)])
def test_half_turns_have_one_logarithm(axis):
    a = np.array(axis) / np.linalg.norm(axis)
    one, two = (sim3.so3_log(sim3.so3_exp(s * np.pi * a)) for s in (1, -1))
    lead = a[np.flatnonzero(np.abs(a) > 1e-12)[0]]
    assert np.allclose(one, two, atol=1e-12) and np.allclose(one, np.pi * a * np.sign(lead), atol=1e-7)
    assert np.linalg.norm(one) == pytest.approx(np.pi, abs=1e-15)


def test_logarithms_close_to_half_turns_keep_their_side():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(200, 3))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    for angle in (np.pi - 1e-6, np.pi - 1e-9, np.pi - 1e-12, 3.0, 1e-7, 1e-9, 0.0):
        got = sim3.so3_logs(np.stack([sim3.so3_exp(angle * v) for v in w]))
        assert np.allclose(got, angle * w, atol=2e-7 if angle > 3.1 else 1e-9)


def test_right_jacobian_at_small_angles():
    w = np.array([3e-8, -4e-8, 1e-8])
    k = sim3.skew(w)
    assert np.allclose(sim3.right_jacobian(w), np.eye(3) - 0.5 * k + k @ k / 6.0, atol=1e-22, rtol=0)


UPDATES = "stream_id string, update_id string, position long, target string, sources array<string>, stops array<long>, content_hash string"
LOG = [
    ("s", "u0", 0, "a", [], [], "h0", None),
    ("s", "u1", 1, "b", ["a"], [4], "h1", None),
    ("s", "u2", 2, "b", ["a"], [5], "h2", "target-already-admitted"),
    ("s", "u3", 3, "c", [], [], "h3", "no-association"),
    ("s", "u4", 4, "c", ["a", "a"], [5, 5], "h4", "repeated-source"),
    ("s", "u5", 5, "c", ["a", "z"], [5, 5], "h5", "source-not-admitted"),
    ("s", "u6", 6, "c", ["a", "b"], [5, 6], "h6", "causal-stop-differs"),
    ("s", "u7", 7, "c", ["b"], [3], "h7", "causal-stop-decreases"),
    ("s", "u8", 8, "c", ["a", "b"], [4, 4], "h8", None),
    ("s", "u9", 9, "z", ["c"], [9], "h9", None),
    ("t", "v0", 0, "q", ["a"], [1], "g0", "source-not-admitted"),
    ("t", "v1", 1, "q", [], [], "g1", None),
]


def test_identity_stream_gives_one_result_however_it_is_cut(spark):
    def run(cuts: list[list[tuple]]) -> list[tuple]:
        d = folder()
        for part in cuts:
            spark.createDataFrame([r[:7] for r in part], UPDATES).coalesce(1).write.mode("append").parquet(f"{d}/in")
            stream = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).parquet(f"{d}/in")
            incremental.run_available(admission.admit_identities(stream), f"{d}/out")  # each run goes on from the checkpoint
        return sorted(spark.read.parquet(f"{d}/out").select("update_id", "admitted", "reason", "hypotheses", "chain_id").collect())

    whole = run([LOG])
    assert {r.update_id: r.reason for r in whole} == {r[1]: r[7] for r in LOG}
    chain = None
    for r in LOG[:10]:
        if r[7] is None:
            chain = admission.chain_hash(chain, r[6])
            assert next(w for w in whole if w.update_id == r[1]).chain_id == chain
    assert run([LOG[:3] + LOG[10:], LOG[3:8], LOG[8:10]]) == whole


def test_late_rows_are_kept_apart_and_earlier_rows_never_change(spark):
    d = folder()
    batches = [[(1, 100), (2, 140)], [(3, 90), (4, 129), (5, 130), (6, 200)], [(7, 150), (8, 189), (9, 190)]]
    seen = {}
    for part in batches:
        rows = spark.createDataFrame(part, "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
        rows.coalesce(1).write.mode("append").parquet(f"{d}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).parquet(f"{d}/in")
        incremental.causal_rows(stream, f"{d}/out", delay="10 seconds")
        now = {r.id: (r.late, r.epoch) for r in spark.read.parquet(f"{d}/out/rows").collect()}
        assert seen.items() <= now.items()
        seen = now
    assert {i for i, (late, _) in seen.items() if late} == {3, 4, 7, 8} and len(seen) == 9
    # nothing new: no batch, no change
    incremental.causal_rows(spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).parquet(f"{d}/in"), f"{d}/out", delay="10 seconds")
    assert {r.id: (r.late, r.epoch) for r in spark.read.parquet(f"{d}/out/rows").collect()} == seen


def test_support_audit_names_planted_faults(spark):
    points = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 3), ("h", 1)], "k string, row_id long")
    axes = [("g", 1, a) for a in "xyz"] + [("g", 2, a) for a in "xyz"] + [("g", 3, "x"), ("g", 3, "y"), ("g", 9, "x"), ("h", 1, "x"), ("h", 1, "y"), ("h", 1, "y"), ("h", 1, "z")]
    scores = spark.createDataFrame(axes, "k string, row_id long, axis string")
    seams = spark.createDataFrame([("g", 3), ("g", 4)], "k string, row_id long")
    roster = spark.createDataFrame([("g",), ("i",)], "k string")
    declared = spark.createDataFrame([("g", 4, 8), ("h", 1, 2), ("j", 1, 1)], "k string, declared long, declared_sum long")
    found, differ = joins.audit_support(points, scores, declared, ["k"], 3, {"seam": seams}, roster)
    assert {tuple(r) for r in found.collect()} == {
        ("g", 9, "orphan_score"), ("g", 4, "orphan_seam"), ("g", 2, "duplicate_point"), ("g", 3, "axis_roster"), ("h", 1, "axis_roster"), ("i", None, "missing_pair"), ("h", None, "extra_pair")
    }
    assert {r.k for r in differ.collect()} == {"h", "j"}


def fused(spark, case: str, value: float):
    columns = "case_id string, frame long, row int, col int, x double, y double, z double, " + ", ".join(f"c_{s} double" for s in SYM) + ", contributors int"
    return spark.createDataFrame([(case, 0, r, 0, value + r / 3, 2.0, 3.0, *[0.1 + i for i in range(6)], 2) for r in range(3)], columns)


def test_fused_table_after_repeated_writes(spark):
    path = f"{folder()}/f"
    for case, value in (("1", 0.0), ("2", 5.0), ("1", 7.0)):  # the third write replaces the first one's case
        tables.write_fused(fused(spark, case, value), path, "m", "uniform")
    back = {(r.case_id, r.row): r for r in tables.read_fused(spark, path).collect()}
    assert len(back) == 6
    for (case, row), r in back.items():
        assert r.x == float(np.float32({"1": 7.0, "2": 5.0}[case] + row / 3))
        assert [r[f"c_{s}"] for s in SYM] == [float(np.float32(0.1 + i)) for i in range(6)]
    bare = tables.read_fused(spark, path, ["m"], covariance=False)
    assert bare.where("c_xx IS NOT NULL").isEmpty() and bare.count() == 6
    scan = bare._jdf.queryExecution().executedPlan().toString()
    assert "c_xx" not in scan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="semantics"):
        tables.write_fused(fused(spark, "3", 1.0), path, "m", "precision")
    assert tables.read_fused(spark, path).count() == 6
