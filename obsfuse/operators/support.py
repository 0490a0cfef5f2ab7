"""Frame support of streams, candidate designs and camera panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.operators.joins import interval_admission
from obsfuse.operators.ranking import with_row_number


def stream_support(
    streams: DataFrame, permitted: Sequence[str] = (), maximum_exclusions: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """Per stream reason codes, geometry fraction, supported and excluded flags.

    The exclusion budget is counted per ``keys`` (e.g. candidate design).
    """
    permitted_list = F.array(*[F.lit(p) for p in permitted]).cast("array<string>")
    a = interval_admission(streams)
    code = F.col("technical_failure_code")
    allowed = code.isNotNull() & F.array_contains(permitted_list, F.coalesce(code, F.lit("")))
    used = a.groupBy(*keys).agg(F.sum(F.when(allowed, 1).otherwise(0)).alias("technical_exclusions"))
    j = a.join(used, list(keys)) if keys else a.crossJoin(F.broadcast(used))
    within = F.col("technical_exclusions") <= maximum_exclusions
    excluded = allowed & within
    fraction = F.col("supported_count") / F.col("required_count")
    reasons = F.array_sort(
        F.filter(
            F.array(
                F.when(excluded, F.lit("permitted-technical-exclusion")),
                F.when(allowed & ~within, F.lit("technical-exclusion-budget-exceeded")),
                F.when(code.isNotNull() & ~allowed, F.lit("unpermitted-technical-failure")),
                F.when(F.col("available_count") != F.col("required_count"), F.lit("missing-required-frames")),
                F.when(fraction < F.col("min_fraction"), F.lit("insufficient-geometry-support")),
                F.when(F.col("intrinsics_required") & F.col("intrinsics_id").isNull(), F.lit("missing-intrinsics")),
                F.when(F.col("extrinsics_required") & F.col("extrinsics_id").isNull(), F.lit("missing-extrinsics")),
                F.when(F.col("anchor_required") & F.col("anchor_id").isNull(), F.lit("missing-metric-anchor")),
            ),
            lambda r: r.isNotNull(),
        )
    )
    return j.select(
        *streams.columns, "required_count", "available_count", "supported_count", "technical_exclusions",
        fraction.alias("geometry_fraction"), reasons.alias("reasons"), excluded.alias("excluded"),
    ).withColumn("supported", F.size("reasons") == 0)


def support_feasibility(
    evaluated: DataFrame, minimum_fraction: float, maximum_exclusions: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """Supported fraction over evaluable streams and the ordered decision reason."""
    a = evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("streams"),
        F.sum(F.when(F.col("supported"), 1).otherwise(0)).alias("supported_streams"),
        F.sum(F.when(F.col("excluded"), 1).otherwise(0)).alias("excluded_streams"),
        F.max("technical_exclusions").alias("technical_exclusions"),
    ).withColumn("evaluable", F.col("streams") - F.col("excluded_streams"))
    a = a.withColumn("support_fraction", F.when(F.col("evaluable") > 0, F.col("supported_streams") / F.col("evaluable")).otherwise(0.0))
    reason = (
        F.when(F.col("technical_exclusions") > maximum_exclusions, "technical-exclusion-budget-exceeded")
        .when(F.col("evaluable") == 0, "no-evaluable-streams")
        .when(F.col("support_fraction") < minimum_fraction, "support-threshold-not-met")
        .otherwise("support-feasible")
    )
    return a.withColumn("decision", reason).withColumn("feasible", F.col("decision") == "support-feasible")


def rank_designs(evaluated: DataFrame, minimum_fraction: float, maximum_exclusions: int = 0) -> DataFrame:
    """Candidate designs in eight-key lexicographic order (``position`` 1 is best)."""
    feas = support_feasibility(evaluated, minimum_fraction, maximum_exclusions, ["candidate_id"])
    live = ~F.col("excluded")
    per_group = evaluated.groupBy("candidate_id", "group_id").agg(
        F.sum(F.when(F.col("supported"), 1).otherwise(0)).alias("s"), F.sum(F.when(live, 1).otherwise(0)).alias("e")
    )
    g = per_group.groupBy("candidate_id").agg(
        F.min(F.when(F.col("e") > 0, F.col("s") / F.col("e")).otherwise(0.0)).alias("minimum_group_fraction"),
        F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("supported_groups"),
    )
    span = F.col("causal_stop") - F.col("causal_start")
    f = evaluated.groupBy("candidate_id").agg(
        F.sum(F.when(F.col("supported"), F.col("required_count")).otherwise(0)).alias("supported_frames"),
        F.sum(F.when(live, F.col("supported_count")).otherwise(0)).alias("geometry_frames"),
        F.max(span).alias("maximum_span"),
        F.sum(span).alias("total_span"),
    )
    j = feas.join(g, "candidate_id").join(f, "candidate_id")
    order = [
        F.when(F.col("feasible"), 0).otherwise(1), -F.col("minimum_group_fraction"), -F.col("supported_groups"),
        -F.col("supported_frames"), -F.col("geometry_frames"), -F.col("supported_streams"), F.col("maximum_span"),
        F.col("total_span"), F.col("candidate_id"),
    ]
    return with_row_number(j, [], order, "position").drop("position_total")


def panel_support(
    cells: DataFrame,
    required: DataFrame,
    views: int,
    minimum_cells: int = 1,
    minimum_views: int = 2,
    require_all: bool = False,
    keys: Sequence[str] = ("panel_id",),
) -> DataFrame:
    """Per required frame: contributing and spatially supported views, reasons, flag.

    ``cells`` has one row per (panel, view, frame, seed cell) sighting.
    """
    keys = list(keys)
    distinct = cells.select(*keys, "frame", "view_id", "cell_id").distinct()
    per_view = distinct.groupBy(*keys, "frame", "view_id").agg(F.count(F.lit(1)).alias("cells"))
    per = per_view.groupBy(*keys, "frame").agg(
        F.count(F.lit(1)).alias("contributing"), F.sum(F.when(F.col("cells") >= minimum_cells, 1).otherwise(0)).alias("spatial")
    )
    j = required.join(per, [*keys, "frame"], "left").fillna({"contributing": 0, "spatial": 0})
    reasons = F.filter(
        F.array(
            F.when(F.col("spatial") < minimum_views, F.lit("insufficient-spatially-supported-views")),
            F.when(F.lit(require_all) & (F.col("contributing") != views), F.lit("missing-declared-view")),
        ),
        lambda r: r.isNotNull(),
    )
    return j.withColumn("reasons", reasons).withColumn("supported", F.size("reasons") == 0)


def panel_summary(frames: DataFrame, minimum_fraction: float, keys: Sequence[str] = ("panel_id",)) -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.when(F.col("supported"), 1.0).otherwise(0.0)).alias("supported_fraction")
    ).withColumn("feasible", F.col("supported_fraction") >= minimum_fraction)
