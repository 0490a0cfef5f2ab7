"""Explicit table schemas; reads never infer and unknown columns are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.functions.vec3 import SYM

_C = ", ".join(f"c_{s} double" for s in SYM)
_F = ", ".join(f"f_{s} double" for s in SYM)

SAMPLES = (
    "case_id string, window_id string, frame bigint, row int, col int, x double, y double, z double, valid boolean,"
    " fx double, fy double, fz double, deform boolean, rx double, ry double, rz double"
)
TRUTH = "case_id string, frame bigint, row int, col int, x double, y double, z double, valid boolean, fx double, fy double, fz double, deform boolean"
FUSED = (
    "case_id string, method_id string, frame bigint, row int, col int, x double, y double, z double, valid boolean, "
    f"{_C}, contributors int, fx double, fy double, fz double, {_F}, deform boolean"
)
OBSERVATIONS = (
    "case_id string, frame bigint, entity_id bigint, view_index int, window_index int, x double, y double, z double, "
    f"{_C}, factor array<double>, prior_reliability double, association_probability double,"
    " correlation_group_id bigint, factor_group_id bigint"
)
OBSERVATION_GROUPS = "case_id string, group_id bigint, prior_nominal_probability double, composite_weight double"
LINEAGE = "payload_id string, output_frame bigint, source_start bigint, source_stop bigint, contributors array<string>"
CASES = "case_id string, group_id string, method_id string, boundary_frames array<bigint>, prefix_frame_stop bigint"


def columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(",")]  # type: ignore[misc]


def conform(df: DataFrame, schema: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the schema's columns in order; missing or unknown columns raise."""
    want = dict(columns(schema))
    extra = sorted(set(df.columns) - set(want))
    missing = sorted(set(want) - set(df.columns) - set(optional))
    if extra or missing:
        raise ValueError(f"table columns changed; missing={missing}, extra={extra}")
    return df.select(
        *[
            (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
            for n, t in want.items()
        ]
    )
