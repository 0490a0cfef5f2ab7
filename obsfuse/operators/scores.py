"""Uncertainty diagnostics, sequence scorecards and evaluation modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3
from obsfuse.operators import ranking as rk
from obsfuse.runtime import attach, durable, maybe_broadcast, null_safe_on, placed, within_limit

KEY = ["case_id", "frame", "row", "col"]
EPS = 2.220446049250313e-16


def scored_residuals(df: DataFrame) -> DataFrame:
    """Add m2, log_det, nll, trace, relative error (``risk``) and ``score``.

    Rows whose error or target norm is not finite are dropped, as inactive samples.
    """
    e, c = v3.vec("e"), v3.sym()
    out = df.where(v3.finite(*e, F.col("target_norm")))
    floor = F.greatest(F.col("target_norm"), F.lit(0.01))
    return out.select(
        "*",
        v3.mahalanobis2(c, e).alias("m2"),
        v3.log_det(c).alias("log_det"),
        v3.trace(c).alias("trace"),
        (v3.norm(e) / floor).alias("risk"),
        (v3.trace(c) / (floor * floor)).alias("score"),
    ).withColumn("nll", F.lit(0.5) * (F.lit(3 * v3.LOG_2PI) + F.col("log_det") + F.col("m2")))


def calibration_aggregates() -> list[Column]:
    """Mergeable aggregates over scored rows (also used by the streaming form)."""
    cover = [
        F.avg(F.when(F.col("m2") <= q, 1.0).otherwise(0.0)).alias(f"coverage_{int(round(p * 100))}")
        for p, q in v3.CHI2_3.items()
    ]
    return [
        F.count(F.lit(1)).alias("n"),
        *cover,
        F.avg("m2").alias("mean_m2"),
        F.avg("nll").alias("gaussian_nll"),
        F.avg("trace").alias("mean_trace"),
        F.avg("log_det").alias("mean_log_det"),
        F.avg("risk").alias("mean_relative_error"),
    ]


def finish_calibration(df: DataFrame) -> DataFrame:
    gap = sum(
        (F.abs(F.col(f"coverage_{int(round(p * 100))}") - F.lit(p)) for p in v3.CHI2_3), F.lit(0.0)
    )
    return df.select(
        "*",
        F.greatest(F.lit(0.0), F.lit(0.95) - F.col("coverage_95")).alias("shortfall_95"),
        (gap / F.lit(4.0)).alias("calibration_error"),
    )


def uncertainty_diagnostics(df: DataFrame, keys: Sequence[str], ranks: bool = True) -> DataFrame:
    """Per-group calibration, likelihood and ranking diagnostics of 3-D residuals.

    ``ranks=False`` skips the median and rank metrics and is then one aggregation.
    """
    keys = list(keys)
    scored = scored_residuals(df)
    base = finish_calibration(scored.groupBy(*keys).agg(*calibration_aggregates()))
    if not ranks:
        return base
    parts = [
        rk.exact_quantiles(scored, keys, "m2", {"median_m2": 0.5}).drop("n"),
        rk.spearman(scored, keys, "score", "risk", "spearman"),
        rk.expected_risk(scored, keys, "risk", "score", 0.5, "retained_50"),
        rk.expected_risk(scored, keys, "risk", "score", 0.8, "retained_80"),
        rk.expected_risk(scored, keys, "risk", "risk", 0.8, "oracle_80"),
        rk.risk_coverage_auc(scored, keys, "risk", "score", "risk_coverage_auc"),
    ]
    for part in parts:
        cond = null_safe_on(base, part, keys) if keys else None
        base = (
            base.join(part, cond).select(base["*"], *[part[c] for c in part.columns if c not in keys])
            if keys
            else base.crossJoin(part)
        )
    gain = F.col("mean_relative_error") - F.col("retained_80")
    best = F.col("mean_relative_error") - F.col("oracle_80")
    return base.select(
        "*",
        gain.alias("selective_gain_80"),
        F.when(best > 1e-12, gain / best).otherwise(F.lit(0.0)).alias("selective_oracle_fraction_80"),
    )


def equal_group_means(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), *[F.avg(m).alias(m) for m in metrics]
    )


# --- sequence scorecard -----------------------------------------------------------


def matched(prediction: DataFrame, truth: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Prediction-truth rows valid on both sides (and in ``support`` when given)."""
    t = truth.where("valid").select(*KEY, *[F.col(c).alias(f"t{c}") for c in "xyz"])
    p = prediction.where("valid")
    out = p.join(t, KEY)
    return out.join(support.select(*KEY).distinct(), KEY, "left_semi") if support is not None else out


def scale_translation_fit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-squares y = s x + t per key from sums; degenerate spread gives s = 1."""
    p, t = v3.vec(), v3.vec("t")
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(c).alias(f"p{i}") for i, c in enumerate(p)],
        *[F.avg(c).alias(f"q{i}") for i, c in enumerate(t)],
        F.sum(v3.dot(p, p)).alias("pp"),
        F.sum(v3.dot(p, t)).alias("pt"),
    )
    pm = tuple(F.col(f"p{i}") for i in range(3))
    qm = tuple(F.col(f"q{i}") for i in range(3))
    den = F.col("pp") - F.col("n") * v3.dot(pm, pm)
    num = F.col("pt") - F.col("n") * v3.dot(pm, qm)
    s = F.when(den <= EPS, F.lit(1.0)).otherwise(F.greatest(num / den, F.lit(EPS)))
    return sums.select(*keys, "n", s.alias("scale"), *[qm[i].alias(f"q{i}") for i in range(3)], *[pm[i].alias(f"p{i}") for i in range(3)]).select(
        *keys,
        F.col("n").cast("bigint").alias("fit_points"),
        "scale",
        *[(F.col(f"q{i}") - F.col("scale") * F.col(f"p{i}")).alias(n) for i, n in enumerate(("tx", "ty", "tz"))],
    )


def apply_scale_translation(df: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    fit = durable(fit)  # one row for each key: few beside the rows
    if within_limit(fit):
        joined = df.join(F.broadcast(fit), list(keys))
    else:
        joined = attach(df, fit, keys, how="inner", salt_by=[c for c in KEY if c in df.columns])
    s = F.col("scale")
    out = joined.withColumns(
        {"x": s * F.col("x") + F.col("fit_tx"), "y": s * F.col("y") + F.col("fit_ty"), "z": s * F.col("z") + F.col("fit_tz")}
    )
    if "c_xx" in df.columns:
        out = out.withColumns({f"c_{n}": s * s * F.col(f"c_{n}") for n in v3.SYM})
    return out.select(*df.columns)


def frame_rmse(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    e = v3.sub(v3.vec(), v3.vec("t"))
    return df.groupBy(*keys, "frame").agg(
        F.sum(v3.dot(e, e)).alias("sq"), F.count(F.lit(1)).alias("points")
    ).withColumn("rmse", F.sqrt(F.col("sq") / F.col("points")))


def seam_rmse(df: DataFrame, boundaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMS of error(b) - error(b - 1) on pixels valid in both, b a boundary frame.

    ``boundaries`` has (case_id, frame) and is a small table.  Both frames of a seam are aggregated by (boundary,
    pixel), so a row is moved once for each seam that it touches and frames away from all seams not at all.
    """
    e = v3.sub(v3.vec(), v3.vec("t"))
    at = boundaries.select("case_id", F.col("frame").alias("__at")).distinct()
    sides = at.select("case_id", "__at", F.explode(F.array(F.lit(0), F.lit(1))).alias("__back")).withColumn("frame", F.col("__at") - F.col("__back"))
    base = df.select(*keys, "frame", "row", "col", *v3.named(e, ["ex", "ey", "ez"])).join(maybe_broadcast(durable(sides)), ["case_id", "frame"])
    near = F.col("__back") == 0
    jump = base.groupBy(*keys, "__at", "row", "col").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(near, F.col(f"e{c}")).otherwise(-F.col(f"e{c}"))).alias(f"g{c}") for c in "xyz"]
    ).where("n = 2")
    g = v3.vec("g")
    return jump.groupBy(*keys).agg(
        F.sqrt(F.avg(v3.dot(g, g))).alias("seam_rmse"), F.count(F.lit(1)).alias("seam_points")
    )


def sequence_scorecard(
    df: DataFrame, keys: Sequence[str], boundaries: DataFrame | None = None
) -> DataFrame:
    """Metric RMSE, frame-balanced RMSE, endpoint RMSE, drift slope and counts.

    With predicted and true flow (f*, tf*) also their mean end-point error.
    """
    keys = list(keys)
    out = _frames_together(frame_rmse(df, keys), keys)
    if boundaries is not None:
        out = out.join(seam_rmse(df, boundaries, keys), keys, "left")
    if {"fx", "tfx"} <= set(df.columns):
        out = out.join(flow_epe(df, keys), keys, "left")
    return out


def _frames_together(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.sqrt(F.sum("sq") / F.sum("points")).alias("rmse"),
        F.avg("rmse").alias("frame_balanced_rmse"),
        F.max_by("rmse", "frame").alias("endpoint_rmse"),
        F.coalesce(F.regr_slope("rmse", "frame"), F.lit(0.0)).alias("drift_slope"),
        F.sum("points").alias("points"),
        F.count(F.lit(1)).alias("frames"),
    )


def frame_cards(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`sequence_scorecard` next to :func:`uncertainty_diagnostics` without ranks, from one reading of the rows.

    The sums of each frame are written, the rows are not; a key without an active row has no card.
    """
    keys = list(keys)
    e, c = v3.vec("e"), v3.sym()
    floor = F.greatest(F.col("target_norm"), F.lit(0.01))
    miss = v3.sub(v3.vec(), v3.vec("t"))
    active = v3.finite(*e, F.col("target_norm"))
    values = {"mean_m2": v3.mahalanobis2(c, e), "mean_log_det": v3.log_det(c), "mean_trace": v3.trace(c), "mean_relative_error": v3.norm(e) / floor}
    rows = df.select(*keys, "frame", v3.dot(miss, miss).alias("sq"), active.alias("on"), *[F.when(active, v).alias(n) for n, v in values.items()])
    rows = rows.withColumn("gaussian_nll", F.lit(0.5) * (F.lit(3 * v3.LOG_2PI) + F.col("mean_log_det") + F.col("mean_m2")))
    means = [*values, "gaussian_nll"]
    for p, q in v3.CHI2_3.items():
        name = f"coverage_{int(round(p * 100))}"
        means.append(name)
        rows = rows.withColumn(name, F.when(F.col("on"), F.when(F.col("mean_m2") <= q, 1.0).otherwise(0.0)))
    sums = [f(n).alias(f"{n}_{f.__name__}") for n in means for f in (F.sum, F.count)]
    frames = rows.groupBy(*keys, "frame").agg(F.sum("sq").alias("sq"), F.count(F.lit(1)).alias("points"), F.count_if("on").alias("n"), *sums)
    frames = placed(frames.withColumn("rmse", F.sqrt(F.col("sq") / F.col("points"))))
    whole = frames.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_count")).alias(n) for n in means])
    return _frames_together(frames, keys).join(finish_calibration(whole.where("n > 0")), keys)


def flow_epe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean end-point error of flow where both sides carry flow."""
    e = v3.sub(v3.vec("f"), v3.vec("tf"))
    return df.where(v3.finite(*v3.vec("f"), *v3.vec("tf"))).groupBy(*keys).agg(
        F.avg(v3.norm(e)).alias("flow_epe"), F.count(F.lit(1)).alias("flow_points")
    )


def evaluation_modes(
    df: DataFrame,
    keys: Sequence[str],
    prefix_stop: Column,
    boundaries: DataFrame | None = None,
) -> DataFrame:
    """Scorecard three times: metric, prefix-aligned and oracle-aligned.

    The rows are read twice, once for the sums of both fits and once for the scorecards of all modes.
    """
    keys = list(keys)
    whole, early = "oracle_aligned", "prefix_aligned"
    sides = F.explode(F.when(F.col("frame") < prefix_stop, F.array(F.lit(whole), F.lit(early))).otherwise(F.array(F.lit(whole))))
    fits = scale_translation_fit(df.withColumn("mode", sides), [*keys, "mode"]).drop("fit_points")
    # one row for each key and mode: few beside the rows
    moves = durable(fits.groupBy(*keys).agg(F.collect_list(F.struct("mode", "scale", "tx", "ty", "tz")).alias("__fits")))
    same = F.array(F.struct(F.lit("metric").alias("mode"), F.lit(None).cast("double").alias("scale"), *[F.lit(0.0).alias(f"t{c}") for c in "xyz"]))
    if within_limit(moves):
        joined = df.join(F.broadcast(moves), keys, "left")
    else:
        joined = attach(df, moves, keys, salt_by=[c for c in KEY if c in df.columns])
    rows = joined.select(*df.columns, F.explode(F.concat(same, F.coalesce("__fits", F.array().cast(moves.schema["__fits"].dataType)))).alias("__f"))
    moved = {c: F.when(F.col("__f.scale").isNull(), F.col(c)).otherwise(F.col("__f.scale") * F.col(c) + F.col(f"__f.t{c}")) for c in "xyz"}
    rows = rows.withColumns({**moved, "mode": F.col("__f.mode")}).drop("__f")
    cards = sequence_scorecard(rows, [*keys, "mode"], boundaries)
    return cards.select(*keys, *[c for c in cards.columns if c not in {*keys, "mode"}], "mode")


def error_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, RMSE, median, p90, p95 of a non-negative error."""
    sums = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.sqrt(F.avg(F.col(value) ** 2)).alias("rmse")
    )
    q = rk.exact_quantiles(df, keys, value, {"median": 0.5, "p90": 0.9, "p95": 0.95})
    return sums.join(q, list(keys)) if keys else sums.crossJoin(q)


def common_mode_quadrants(
    df: DataFrame, disagreement: str, error: str, low: float, high: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Low/high disagreement against low/high error; the silent quadrant is low/high."""
    hi_d, hi_e = F.col(disagreement) > low, F.col(error) > high
    silent = ~hi_d & hi_e

    def count(c: Column, name: str) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).alias(name)

    return df.groupBy(*keys).agg(
        count(~hi_d & ~hi_e, "low_low"),
        count(silent, "low_high"),
        count(hi_d & ~hi_e, "high_low"),
        count(hi_d & hi_e, "high_high"),
        F.avg(F.when(silent, F.col(error))).alias("silent_mean_error"),
        F.max(F.when(silent, F.col(error))).alias("silent_max_error"),
    )
