"""Dense-window archives (zipped array members) -> long sample tables.

``binaryFile`` lists a directory, one task decodes one archive at a time and streams its
grid out frame by frame, so a task holds one window and one frame of rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsfuse.runtime import violations
from obsfuse.schemas import SAMPLES, columns

#: member names of the versioned layout; fixed values.
REQUIRED = {"schema_name", "schema_version", "dense_storage_dtype", "window_id", "frame_indices", "point_map", "valid_mask"}
OPTIONAL = {"scene_flow", "deform_mask", "ray_directions"}
METADATA = {"schema_name", "schema_version", "dense_storage_dtype"}

_OUT = SAMPLES + ", error string"
_NAMES = [n for n, _ in columns(SAMPLES)]


def _decode(content: bytes, window_id: str | None, start_frame: int | None, schema_name: str | None) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as data:
        files = set(data.files)
        versioned = METADATA & files
        if versioned and versioned != METADATA:
            raise ValueError("incomplete storage metadata")
        if versioned:
            if files - REQUIRED - OPTIONAL or REQUIRED - files:
                raise ValueError("archive members changed")
            if schema_name is not None and str(data["schema_name"].item()) != schema_name:
                raise ValueError("unsupported archive schema")
            want = np.dtype(str(data["dense_storage_dtype"].item()))
            for m in ("point_map", "scene_flow", "ray_directions"):
                if m in files and data[m].dtype != want:
                    raise ValueError(f"{m} dtype disagrees with the storage metadata")
            if data["frame_indices"].dtype != np.int64:
                raise ValueError("frame_indices must be int64")
        elif not {"point_map", "valid_mask"} <= files:
            raise ValueError("archive lacks point_map or valid_mask")
        if ("scene_flow" in files) != ("deform_mask" in files):
            raise ValueError("flow needs scene_flow and deform_mask together")
        out = {m: data[m] for m in files & ({"point_map", "valid_mask", "frame_indices"} | OPTIONAL)}
        if window_id is None and "window_id" in files:
            window_id = str(data["window_id"].item())
    for m in ("valid_mask", "deform_mask"):
        if m in out and out[m].dtype != bool:
            raise ValueError(f"{m} must be boolean")
    steps = out["point_map"].shape[0]
    if "frame_indices" not in out:
        if start_frame is None:
            raise ValueError("archive without frame ids needs an explicit start frame")
        out["frame_indices"] = np.arange(start_frame, start_frame + steps)
    frames = out["frame_indices"]
    if frames.shape != (steps,) or (np.diff(frames) <= 0).any() or frames.min() < 0:
        raise ValueError("frame ids must be non-negative and strictly increasing")
    shape = out["valid_mask"].shape
    if out["point_map"].shape != (*shape, 3):
        raise ValueError("point_map and valid_mask shapes differ")
    active = out["point_map"][out["valid_mask"]]
    if not np.isfinite(active).all():
        raise ValueError("active points must be finite")
    if "deform_mask" in out and (out["deform_mask"] & ~out["valid_mask"]).any():
        raise ValueError("deform_mask must be inside valid_mask")
    out["window_id"] = np.asarray(window_id or "")
    return out


def _rows(a: dict[str, np.ndarray], case_id: str, t: int) -> pd.DataFrame:
    h, w = a["valid_mask"].shape[1:]
    n = h * w
    out = {
        "case_id": case_id,
        "window_id": str(a["window_id"]),
        "frame": np.full(n, int(a["frame_indices"][t]), dtype=np.int64),
        "row": np.repeat(np.arange(h, dtype=np.int32), w),
        "col": np.tile(np.arange(w, dtype=np.int32), h),
        "valid": a["valid_mask"][t].ravel(),
    }
    for member, names in (("point_map", "xyz"), ("scene_flow", ("fx", "fy", "fz")), ("ray_directions", ("rx", "ry", "rz"))):
        flat = a[member][t].reshape(n, 3).astype(np.float64) if member in a else None
        for i, name in enumerate(names):
            out[name] = flat[:, i] if flat is not None else None
    out["deform"] = a["deform_mask"][t].ravel() if "deform_mask" in a else None
    out["error"] = None
    return pd.DataFrame(out)[[*_NAMES, "error"]]


def decode_archives(files: DataFrame, schema_name: str | None = None) -> DataFrame:
    """``files``: case_id, path, content, window_id (nullable), start_frame (nullable).

    A bad archive becomes one row with ``error`` set and no sample values.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                start = None if pd.isna(r.start_frame) else int(r.start_frame)
                try:
                    a = _decode(bytes(r.content), r.window_id, start, schema_name)
                except Exception as error:  # noqa: BLE001 - reported as a quarantine row
                    bad = {n: None for n in _NAMES} | {"case_id": r.case_id, "window_id": r.path, "error": str(error)}
                    yield pd.DataFrame([bad])[[*_NAMES, "error"]]
                    continue
                if not str(a["window_id"]):
                    a["window_id"] = np.asarray(r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                for t in range(len(a["frame_indices"])):
                    yield _rows(a, r.case_id, t)

    need = files.select("case_id", "path", "content", "window_id", "start_frame")
    return need.mapInPandas(run, _OUT)


def read_archives(spark: SparkSession, directory: str, case_id: str | None = None, start_frame: int | None = None, schema_name: str | None = None) -> DataFrame:
    """Decode every archive below ``directory``; the case is the parent folder by default."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(directory)
    parent = F.element_at(F.split("path", "/"), -2)
    return decode_archives(
        files.select(
            (F.lit(case_id) if case_id is not None else parent).alias("case_id"), "path", "content",
            F.lit(None).cast("string").alias("window_id"), F.lit(start_frame).cast("bigint").alias("start_frame"),
        ),
        schema_name,
    )


def ingest_archives(spark: SparkSession, directory: str, target: str, strict: bool = True, **options) -> DataFrame:  # noqa: ANN003
    """Decode a directory into Parquet partitioned by case and sorted by frame.

    With ``strict`` any bad archive fails the job after the write of nothing; otherwise
    bad archives are returned as the quarantine table.
    """
    decoded = read_archives(spark, directory, **options)
    bad = decoded.where("error IS NOT NULL").select("case_id", F.col("window_id").alias("path"), "error")
    if strict:
        violations(bad, "archive refused")
    rows = decoded.where("error IS NULL").drop("error")
    # ranges, not a hash of the case: one huge case is still written by many tasks
    rows.repartitionByRange("case_id", "frame", "window_id", "row").sortWithinPartitions("case_id", "frame").write.mode("overwrite").partitionBy("case_id").parquet(target)
    return bad


def check_grid(samples: DataFrame) -> None:
    """Windows that are combined must share one grid resolution."""
    size = samples.groupBy("case_id", "window_id").agg(F.max("row").alias("h"), F.max("col").alias("w"))
    violations(
        size.groupBy("case_id").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("w").alias("w0"), F.max("w").alias("w1")).where("h0 <> h1 OR w0 <> w1"),
        "grid resolution differs between windows",
    )
