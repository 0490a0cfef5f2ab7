"""Streams over tables that are folders of files."""

from __future__ import annotations

import shutil

from obsfuse.plans.catalogue import REGISTRY

SF = "/root/testdata/sf0.001"


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    for table in ("conversations", "events"):
        (tmp_path / f"{table}.parquet").mkdir()
        shutil.copy(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet" / "part-00000.parquet")
    for name in ("stream_admission", "stream_window_counts"):
        got, want = (sorted(map(str, REGISTRY[name].run(spark, str(d)).collect())) for d in (tmp_path, SF))
        assert got and got == want
