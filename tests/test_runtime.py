"""Packaging, checkpoint folders and sinks that may run twice."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F

from obsfuse.runtime import fresh_folder
from obsfuse.sources import tables
from obsfuse.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_udfs_run_from_a_foreign_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from obsfuse.runtime import session, ship
spark = session("foreign", cores=1); ship(spark); ship(spark)
def f(batches):
    from obsfuse.functions import sim3
    for b in batches:
        yield b.assign(id=len(sim3.GAUGE_COLUMNS))
print("rows", spark.range(2).mapInPandas(f, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert "rows 2" in out.stdout, out.stderr[-800:]


def test_fresh_folders_differ(spark):
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")


def test_ledger_keeps_the_first_decision(spark, tmp_path):
    sink = incremental.append_ledger(f"file://{tmp_path}/ledger")
    first = spark.createDataFrame([(1, True), (2, False)], "group_id long, accepted boolean")
    sink(first, 0)
    sink(first.withColumn("accepted", F.lit(True)).union(spark.createDataFrame([(3, True)], first.schema)), 1)
    got = {r.group_id: (r.accepted, r.epoch) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()}
    assert got == {1: (True, 0), 2: (False, 0), 3: (True, 1)}


def test_fused_rows_are_replaced_not_doubled(spark, tmp_path):
    cols = "case_id string, frame long, row int, col int, x double, y double, z double, c_xx double, c_xy double, c_xz double, c_yy double, c_yz double, c_zz double, contributors int"
    rows = spark.createDataFrame([("c", 1, 0, i, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 2) for i in range(3)], cols)
    for method in ("a", "b", "a"):
        tables.write_fused(rows, f"{tmp_path}/fused", method, "uniform")
    got = tables.read_fused(spark, f"{tmp_path}/fused").groupBy("method_id").count().collect()
    assert {r.method_id: r["count"] for r in got} == {"a": 3, "b": 3}
