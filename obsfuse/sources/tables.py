"""Parquet sinks and scans, content digests, family split, batch preflight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsfuse import schemas
from obsfuse.functions.vec3 import SYM
from obsfuse.operators.ranking import with_row_number
from obsfuse.runtime import maybe_broadcast, violations

#: fusion method -> (covariance meaning, correlation assumption); fixed values.
SEMANTICS = {
    "uniform": ("mixture-second-moment", "none"),
    "precision": ("information-sum", "independence"),
    "covariance_intersection": ("conservative-bound", "unknown-correlation"),
}
#: Columns that say what a covariance of the fused table means.
SIGNATURE = ["fusion_method", "covariance_semantics", "correlation_assumption"]


def write_truth(df: DataFrame, path: str) -> None:
    t = schemas.conform(df, schemas.TRUTH, optional=("fx", "fy", "fz", "deform"))
    t.withColumns({c: F.col(c).cast("float") for c in ("x", "y", "z", "fx", "fy", "fz")}).write.mode("overwrite").partitionBy("case_id").parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.TRUTH)


_DENSE = ["x", "y", "z", *[f"c_{s}" for s in SYM], "fx", "fy", "fz", *[f"f_{s}" for s in SYM]]


def write_fused(df: DataFrame, path: str, method_id: str, fusion_method: str, include_covariance: bool = True) -> None:
    """Float32 at rest, packed covariance, and the dependence semantics as columns.

    A second run replaces the (case, method) partitions that it writes and leaves the others; a method
    that the table holds with other semantics is refused before anything is written.
    """
    if fusion_method not in SEMANTICS:
        raise ValueError(f"unknown fusion method {fusion_method!r}")
    meaning, assumption = SEMANTICS[fusion_method]
    try:
        known = df.sparkSession.read.parquet(path).where(F.col("method_id") == method_id)
    except AnalysisException:  # no table yet
        known = None
    if known is not None:
        violations(known.where(F.col("fusion_method") != fusion_method).select("method_id", "fusion_method"), "method changed its covariance semantics")
    out = df.withColumn("method_id", F.lit(method_id))
    if "valid" not in out.columns:
        out = out.withColumn("valid", F.lit(True))
    if "flow_contributors" in out.columns:
        out = out.withColumn("deform", F.col("flow_contributors") > 0).drop("flow_contributors")
    optional = ("fx", "fy", "fz", "deform", *[f"f_{s}" for s in SYM])
    out = schemas.conform(out, schemas.FUSED, optional)
    if not include_covariance:
        out = out.withColumns({f"{p}_{s}": F.lit(None).cast("double") for p in "cf" for s in SYM})
    out = out.withColumns({c: F.col(c).cast("float") for c in _DENSE})
    out.withColumns(
        {"fusion_method": F.lit(fusion_method), "covariance_semantics": F.lit(meaning), "correlation_assumption": F.lit(assumption)}
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "method_id").parquet(path)


def read_fused(spark: SparkSession, path: str, methods: Sequence[str] | None = None, covariance: bool = True) -> DataFrame:
    """Fused rows as doubles; one method must have one semantic signature.

    Without ``covariance`` the packed covariances are not read; their columns are null.
    """
    df = spark.read.parquet(path)
    if methods is not None:
        df = df.where(F.col("method_id").isin(*methods))
    sig = df.groupBy("method_id").agg(F.min(F.struct(*SIGNATURE)).alias("a"), F.max(F.struct(*SIGNATURE)).alias("b"))
    violations(sig.where("a <> b").select("method_id"), "method changed its covariance semantics")
    packed = [] if covariance else [f"{p}_{s}" for p in "cf" for s in SYM]
    rows = df.drop(*SIGNATURE, *packed).withColumn("case_id", F.col("case_id").cast("string"))
    return schemas.conform(rows, schemas.FUSED, tuple(packed))


def write_observations(rows: DataFrame, groups: DataFrame, path: str) -> None:
    r, g = schemas.conform(rows, schemas.OBSERVATIONS), schemas.conform(groups, schemas.OBSERVATION_GROUPS)
    violations(
        r.select("case_id", F.col("correlation_group_id").alias("group_id")).distinct().join(g, ["case_id", "group_id"], "left_anti"),
        "observation row without group",
    )
    r.write.mode("overwrite").partitionBy("case_id").parquet(f"{path}/rows")
    g.write.mode("overwrite").partitionBy("case_id").parquet(f"{path}/groups")


def read_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = schemas.conform(spark.read.parquet(f"{path}/rows"), schemas.OBSERVATIONS)
    return rows, schemas.conform(spark.read.parquet(f"{path}/groups"), schemas.OBSERVATION_GROUPS)


def content_digest(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-independent identity of a row set: count, xor and sum of two row hashes.

    All three combine on the map side; nothing is collected.
    """
    cols = [F.col(c) for c in sorted(c for c in df.columns if c not in keys)]
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    sha = F.sha2(text, 256)
    low = F.conv(F.substring(sha, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(text)).alias("hash_xor"), F.sum(low).alias("hash_sum")
    )


def ordered_digest(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Hash of the sorted row hashes of each *bounded* group (e.g. one update)."""
    text = F.to_json(F.struct(*sorted(c for c in df.columns if c not in group)), {"ignoreNullFields": "false"})
    return df.groupBy(*group).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.sha2(text, 256)))), 256).alias("digest"))


def held_out_split(items: DataFrame) -> DataFrame:
    """Whole families to calibration or test, greedily by item count in family order.

    Family = name without its last _suffix, in order of first appearance.  Each choice depends
    on all before it, so the driver walks one small row per family as they arrive.
    """
    fam = items.withColumn("family", F.regexp_replace("name", r"_[^_]*$", ""))
    sizes = fam.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    sides, count = [], {"calibration": 0, "test": 0}
    for r in sizes.orderBy("first", "family").toLocalIterator():
        side = "calibration" if count["calibration"] <= count["test"] else "test"
        count[side] += r["n"]
        sides.append((r["family"], side))
    table = items.sparkSession.createDataFrame(sides, "family string, split string")
    return fam.join(maybe_broadcast(table), "family")


def batch_preflight(payloads: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Violations of admitted payloads against the first one in canonical order.

    ``payloads``: payload_id, position, source_stop, frame_count, height, width, dtype,
    optional_fields (array).
    """
    kept = payloads if cutoff is None else payloads.where(F.col("source_stop") <= cutoff)
    ref = kept.agg(F.min_by(F.struct("payload_id", "frame_count", "height", "width", "dtype", "optional_fields"), F.struct("position", "payload_id")).alias("ref"))
    j = kept.crossJoin(F.broadcast(ref)).where("payload_id <> ref.payload_id")  # ref is one row

    def bad(cond, code: str, exp, got):  # noqa: ANN001, ANN202
        return F.when(cond, F.struct(F.lit(code).alias("code"), exp.cast("string").alias("expected"), got.cast("string").alias("observed")))

    shape = F.concat_ws("x", "height", "width")
    rshape = F.concat_ws("x", "ref.height", "ref.width")
    opt, ropt = F.array_join(F.array_sort("optional_fields"), ","), F.array_join(F.array_sort("ref.optional_fields"), ",")
    found = F.array(
        bad(F.col("frame_count") != F.col("ref.frame_count"), "frame-count-mismatch", F.col("ref.frame_count"), F.col("frame_count")),
        bad(shape != rshape, "spatial-shape-mismatch", rshape, shape),
        bad(F.col("dtype") != F.col("ref.dtype"), "point-dtype-mismatch", F.col("ref.dtype"), F.col("dtype")),
        bad(opt != ropt, "optional-field-mismatch", ropt, opt),
    )
    rows = j.select(F.col("ref.payload_id").alias("reference_payload_id"), "payload_id", F.explode(found).alias("v"))
    rows = rows.where("v IS NOT NULL").select("reference_payload_id", "payload_id", "v.code", "v.expected", "v.observed")
    empty = kept.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(None).cast("string").alias("reference_payload_id"), F.lit(None).cast("string").alias("payload_id"),
        F.lit("no-causally-admitted-payloads").alias("code"), F.lit("at least one").alias("expected"), F.lit("0").alias("observed"),
    )
    return rows.unionByName(empty)


def canonical_windows(windows: DataFrame) -> DataFrame:
    """Windows in (start, stop, id) order with their position, groups by id."""
    return with_row_number(windows, ["case_id"], ["start_frame", "stop_frame", "window_id"], "position").drop("position_total")
