"""Composite pipelines: export, method evaluation, provider fusion, studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators import align, calibrate, fusion, gauges, groups, joins, project, scores
from obsfuse.operators import disagreement as dis
from obsfuse.operators.bootstrap import group_bootstrap
from obsfuse.operators.ranking import exact_quantiles
from obsfuse.runtime import attach, attach_few, durable, placed, violations
from obsfuse.sources import tables

SEQUENCE_METRICS = ["rmse", "frame_balanced_rmse", "endpoint_rmse", "drift_slope"]


@dataclass(frozen=True)
class ExportConfig:
    causal_stop: int
    pixel_stride: int = 8
    fixed_grid: bool = False
    gauge_mode: str = "sequential"
    fixed_lag: int = 4
    allow_block_diagonal: bool = False
    rank: int | None = None
    minimum_trace: float = 0.999
    minimum_reliability: float = 0.05
    effective_samples: float = 64.0
    cluster_size: int = 32
    model: dis.VarianceModel = dis.VarianceModel()


def export_observations(
    samples: DataFrame,
    config: ExportConfig,
    inflation: calibrate.VarianceInflation | None = None,
    anchors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Causal prefix -> edges -> gauges -> variances -> sampled observation rows and groups.

    Edges are materialised once; everything after the gauge step is row-local plus a join
    with per-window coefficients.
    """
    order = durable(joins.window_order(samples))
    admitted = project.causal_windows(order.withColumn("stop_frame", F.col("stop_frame") + 1), config.causal_stop)
    live = attach_few(samples, durable(admitted.select("case_id", "window_id")), ["case_id", "window_id"], "left_semi")
    spans = order.select("case_id", "window_id", F.explode(F.array("start_frame", "stop_frame")).alias("frame"))
    pairs = joins.overlap_correspondences(live, config.cluster_size, windows=spans)
    edges = align.fit_whole_edges(pairs, ["case_id", "reference_id", "moving_id"])
    edges = durable(gauges.with_positions(edges, order))
    if inflation is not None:
        edges = inflation.apply(edges)
    if config.gauge_mode == "sequential":
        joint = durable(gauges.joint_tree(edges))
        roots = durable(gauges.covariance_root(joint, config.rank, config.minimum_trace))
        factor = True
    else:
        if not config.allow_block_diagonal:
            raise ValueError("fixed-lag export loses cross-window covariance; acknowledge it explicitly")
        roots = durable(gauges.fixed_lag_gauges(edges, config.fixed_lag, True, anchors))
        factor = False
    evidence = dis.accumulate_disagreement(pairs, edges.where("status = 'ok'"))
    rows = dis.prior_reliability(dis.point_variances(live, evidence, config.model), config.minimum_reliability)
    picked = placed(project.tile_argmax(rows, config.pixel_stride, config.fixed_grid))  # where the samples lie together, only this is written
    rays = dis.with_rays(picked)
    cov = v3.structured(F.col("var_par"), F.col("var_lat"), v3.vec("r"))
    local = rays.withColumns({f"c_{s}": c for s, c in zip(v3.SYM, cov, strict=True)})
    stacked = project.stack_factors(local, roots, ["case_id", "window_id"], factor)
    pos = order.select("case_id", "window_id", F.col("position").alias("window_index"))
    stacked = attach(stacked, pos, ["case_id", "window_id"], salt_by=["frame", "row", "col"])
    width = F.lit(1 << 20)
    out = stacked.select(
        "case_id", "frame", (F.col("row") * width + F.col("col")).cast("bigint").alias("entity_id"), F.lit(0).alias("view_index"),
        F.col("window_index").cast("int").alias("window_index"),
        *[F.col(f"w{c}").alias(c) for c in "xyz"], *[F.col(f"k_{s}").alias(f"c_{s}") for s in v3.SYM],
        (F.col("factor") if factor else F.array().cast("array<double>")).alias("factor"),
        "prior_reliability", F.lit(1.0).alias("association_probability"),
        F.col("frame").alias("correlation_group_id"), F.lit(0).cast("bigint").alias("factor_group_id"),
    )
    counts = out.groupBy("case_id", F.col("correlation_group_id").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))
    group_rows = counts.select(
        "case_id", "group_id", F.lit(1.0).alias("prior_nominal_probability"),
        F.least(F.lit(1.0), F.lit(config.effective_samples) / F.col("n")).alias("composite_weight"),
    )
    return out, group_rows


def evaluate_methods(
    fused: DataFrame,
    truth: DataFrame,
    cases: DataFrame,
    reference: str,
    rules: Sequence[Mapping[str, object]] = (),
    minimum_groups: int = 1,
    primary_mode: str = "metric",
    resamples: int = 2000,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Common support -> three modes -> equal-group aggregates -> paired decision.

    ``cases``: case_id, group_id, boundary_frames, prefix_frame_stop (one row per case).
    """
    case = cases.select("case_id", "group_id", "boundary_frames", "prefix_frame_stop").distinct()
    violations(case.groupBy("case_id").count().where("count > 1"), "case changed its group or boundaries")
    support = joins.common_support(truth, fused)
    values = [c for c in fused.columns if c not in {*scores.KEY, "method_id"}]
    rows = joins.common_rows(truth, fused, values, known="xyz").select(*fused.columns, *[f"t{c}" for c in "xyz"])
    rows = durable(attach(rows, case.select("case_id", "prefix_frame_stop"), ["case_id"], how="inner", salt_by=["frame", "row", "col"]))
    boundaries = case.select("case_id", F.explode("boundary_frames").alias("frame"))
    key = ["case_id", "method_id"]
    cards = scores.evaluation_modes(rows, key, F.col("prefix_frame_stop"), boundaries)
    long = groups.unpivot_metrics(cards.drop("seam_points", "points", "frames"), [*key, "mode"], [*SEQUENCE_METRICS, "seam_rmse"])
    long = long.withColumn("metric", F.concat_ws(".", "mode", "metric")).drop("mode")
    if "c_xx" in fused.columns:
        e = v3.sub(v3.vec(), v3.vec("t"))
        res = rows.withColumns({**dict(zip(("ex", "ey", "ez"), e, strict=True)), "target_norm": v3.norm(v3.vec("t"))})
        diag = scores.uncertainty_diagnostics(res, key)
        names = [c for c in diag.columns if c not in {*key, "n"}]
        long = long.unionByName(
            groups.unpivot_metrics(diag, key, names).withColumn("metric", F.concat(F.lit("metric.uncertainty."), F.col("metric")))
        )
    long = durable(long.join(case.select("case_id", "group_id"), "case_id"))
    shared = groups.shared_metrics(long, ["group_id", "method_id"])
    aggregate = groups.aggregate_methods(shared, resamples, seed)
    paired = groups.paired_comparison(shared, reference, resamples, seed)
    out = {
        "records": long,
        "retention": joins.support_retention(truth, fused, support),
        "aggregate": aggregate,
        "comparisons": paired,
    }
    if rules:
        named = [{**r, "metric": f"{primary_mode}.{r['metric']}"} for r in rules]
        out["rules"], out["decision"] = groups.decision_rules(paired, groups.rules_table(fused.sparkSession, named), minimum_groups)
    return out


# What a payload's coordinates may come with: a transform per window, one for all, and whether that must be rigid.
_COORDINATES = {
    "window-local-sim3": {"per_window": True, "shared": False},
    "sequence-local-sim3": {"per_window": False, "shared": True},
    "metric-world": {"per_window": False, "shared": False},
    "camera-local-metric": {"per_window": False, "shared": True, "rigid": True, "one_view": True},
}


def resolve_gauges(payloads: DataFrame, semantics: str, per_window: DataFrame | None = None, shared: Mapping[str, float] | None = None) -> DataFrame:
    """Coordinate semantics -> one transform per window; other combinations are refused."""
    if semantics not in _COORDINATES:
        raise ValueError(f"{semantics!r} is none of {sorted(_COORDINATES)}")
    rule = _COORDINATES[semantics]
    given = {"per_window": per_window is not None, "shared": shared is not None}
    wrong = [name for name, has in given.items() if has != rule[name]]
    if wrong:
        raise ValueError(f"{semantics}: " + ", ".join(f"{name} is {'needed' if rule[name] else 'not allowed'}" for name in wrong))
    if rule.get("rigid") and abs(float(shared["scale"]) - 1.0) > 1e-12:
        raise ValueError(f"{semantics}: the shared transform must have scale 1")
    if rule.get("one_view") and "view_id" in payloads.columns and payloads.select("view_id").distinct().limit(2).count() > 1:
        raise ValueError(f"{semantics}: the payloads must share one view")
    windows = payloads.select("case_id", "window_id").distinct()
    if rule["per_window"]:
        violations(joins.missing_extra(windows, per_window, ["case_id", "window_id"]), "windows and gauges differ")
        return windows.join(per_window, ["case_id", "window_id"])
    fixed = shared or sim3.pack(sim3.IDENTITY)
    return windows.select("case_id", "window_id", *[F.lit(float(v)).alias(k) for k, v in fixed.items()])


def fuse_provider(
    samples: DataFrame, payloads: DataFrame, lineage: DataFrame, cutoff: int, semantics: str,
    method: str = "covariance_intersection", per_window: DataFrame | None = None, shared: Mapping[str, float] | None = None,
    model: dis.VarianceModel = dis.VarianceModel(),  # noqa: B008
) -> DataFrame:
    """Causally admitted payloads -> resolved gauges -> fused windows.

    Dependent alternatives (two payloads of one dependence group for the same window) are
    refused, not averaged.
    """
    ok = project.admitted_payloads(lineage, cutoff).select("payload_id")
    kept = payloads.join(ok, "payload_id", "left_semi")
    violations(
        kept.select("case_id", "window_id", F.explode("dependence_group_ids").alias("g")).groupBy("case_id", "window_id", "g").count().where("count > 1"),
        "dependent alternatives selected",
    )
    g = resolve_gauges(kept, semantics, per_window, shared)
    if "cov" not in g.columns:
        g = g.withColumn("cov", F.array_repeat(F.lit(0.0), 49))
    live = samples.join(kept.select("case_id", "window_id").distinct(), ["case_id", "window_id"], "left_semi")
    return fusion.fuse_windows(dis.with_rays(dis.point_variances(live, None, model)), g, method)


def held_out_study(
    samples: DataFrame, truth: DataFrame, items: DataFrame, methods: Sequence[str] = ("uniform", "precision", "covariance_intersection"),
    model: dis.VarianceModel = dis.VarianceModel(), reference: str = "uniform", resamples: int = 20_000,  # noqa: B008
) -> dict[str, DataFrame]:
    """Family split -> calibrate variances on one side -> fuse and score the other.

    ``items``: name (= case_id) and position.
    """
    split = durable(tables.held_out_split(items).select(F.col("name").alias("case_id"), "split"))
    tagged = samples.join(split, "case_id")
    cal, test = tagged.where("split = 'calibration'").drop("split"), tagged.where("split = 'test'").drop("split")

    def prepare(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        order = joins.window_order(part)
        pairs = joins.overlap_correspondences(part)
        edges = durable(gauges.with_positions(align.fit_whole_edges(pairs, ["case_id", "reference_id", "moving_id"]), order))
        ev = dis.accumulate_disagreement(pairs, edges.where("status = 'ok'"))
        return durable(dis.with_rays(dis.point_variances(part, ev, model))), gauges.sequential_gauges(edges)

    rows, _ = prepare(cal)
    key = ["case_id", "frame", "row", "col"]
    fit_in = scores.matched(rows, truth)
    # metric scale per window before residuals, so calibration sees uncertainty, not gauge
    fit = scores.scale_translation_fit(fit_in, ["case_id", "window_id"])
    fitted = attach(fit_in, fit.withColumnsRenamed({"tx": "ax", "ty": "ay", "tz": "az"}).drop("fit_points"), ["case_id", "window_id"], how="inner", salt_by=key[1:])
    s = F.col("scale")
    res = fitted.withColumns({f"e{c}": s * F.col(c) + F.col(f"a{c}") - F.col(f"t{c}") for c in "xyz"})
    res = res.withColumns({"var_par": s * s * F.col("var_par"), "var_lat": s * s * F.col("var_lat")})
    update = durable(calibrate.pooled_calibration(calibrate.structured_ratios(res)))
    trows, tg = prepare(test)
    scaled = trows.crossJoin(F.broadcast(update.select("par_update", "lat_update"))).withColumns(
        {"var_par": F.col("var_par") * F.col("par_update"), "var_lat": F.col("var_lat") * F.col("lat_update")}
    )
    tg = durable(tg)
    fused = None
    for m in methods:
        part = fusion.fuse_windows(scaled.select(*trows.columns), tg, m).withColumn("method_id", F.lit(m)).withColumn("valid", F.lit(True))
        fused = part if fused is None else fused.unionByName(part)
    assert fused is not None
    return {"calibration": update, **scoped_comparison(durable(fused), truth, reference, resamples)}


def scoped_comparison(fused: DataFrame, truth: DataFrame, reference: str, resamples: int = 20_000, seed: int = 0) -> dict[str, DataFrame]:
    """Scale + translation fit, then diagnostics on all points and on multi-contributor cells.

    Equal-sequence means, minimum coverage and a paired sequence bootstrap per scope.
    """
    key = ["case_id", "method_id"]
    m = scores.matched(fused, truth)
    fit = scores.scale_translation_fit(m, key).withColumnsRenamed({"tx": "fit_tx", "ty": "fit_ty", "tz": "fit_tz"})
    rows = scores.apply_scale_translation(m, fit, key)
    e = v3.sub(v3.vec(), v3.vec("t"))
    scope = F.explode(F.when(F.col("contributors") > 1, F.array(F.lit("all"), F.lit("overlap"))).otherwise(F.array(F.lit("all"))))
    rows = rows.withColumns({**dict(zip(("ex", "ey", "ez"), e, strict=True)), "target_norm": v3.norm(v3.vec("t"))}).withColumn("scope", scope)
    per = durable(scores.uncertainty_diagnostics(rows, [*key, "scope"], ranks=False))
    metrics = ["coverage_90", "gaussian_nll", "calibration_error", "mean_m2"]
    means = per.groupBy("method_id", "scope").agg(
        F.count(F.lit(1)).alias("sequences"), *[F.avg(c).alias(c) for c in metrics], F.min("coverage_90").alias("minimum_coverage_90")
    )
    long = groups.unpivot_metrics(per, ["case_id", "method_id", "scope"], metrics)
    ref = long.where(F.col("method_id") == reference).select("case_id", "scope", "metric", F.col("value").alias("r"))
    diff = long.where(F.col("method_id") != reference).join(ref, ["case_id", "scope", "metric"]).withColumn("value", F.col("value") - F.col("r"))
    return {"sequences": per, "summary": means, "paired": group_bootstrap(diff, ["method_id", "scope", "metric"], "case_id", "value", resamples, seed)}


def source_competence(
    records: DataFrame, candidate: str, baseline: str, policy: groups.CompetencePolicy, feature: str | None = None, edges: Sequence[float] = ()
) -> dict[str, DataFrame]:
    """Roster and pairing checks, group metrics, gates, endpoint ratios and strata."""
    keys = ["group_id", "case_id", "frame_index", "random_seed"]
    two = records.where(F.col("arm_id").isin(candidate, baseline))
    violations(joins.roster_completeness(two, [keys, ["arm_id"]]), "incomplete or repeated records")
    _, bad = joins.paired_arms(
        two, keys, candidate, baseline, ["point_error"], ["association_predicted", "identity_reference", "support_reference"], ["seam_error"]
    )
    violations(bad, "paired records disagree")
    g = durable(groups.group_competence(two))
    paired = groups.pair_groups(g, candidate, baseline)
    ratios = groups.paired_endpoint_ratios(
        paired, ["seam_rmse", "absolute_drift_slope"], ["association_precision", "identity_retention", "support_retention"], 1.1, -0.02
    )
    out = {"groups": g, "gates": groups.competence_gates(paired, policy), "ratios": ratios}
    if feature is not None:
        r = records.withColumnRenamed("random_seed", "seed")
        out["strata"], out["contrasts"] = groups.strata_report(r, feature, edges, "point_error", [(candidate, baseline)], 2)
    return out


VARIANTS = {
    "uniform": ("uniform", "full"),
    "precision": ("precision", "full"),
    "intersection": ("covariance_intersection", "full"),
    "intersection_no_gauge": ("covariance_intersection", "no_gauge"),
    "intersection_no_disagreement": ("covariance_intersection", "no_disagreement"),
    "precision_no_gauge": ("precision", "no_gauge"),
    "precision_no_disagreement": ("precision", "no_disagreement"),
}


def variance_ablation(
    samples: DataFrame, truth: DataFrame, evidence: DataFrame, gauge_table: DataFrame, model: dis.VarianceModel = dis.VarianceModel()  # noqa: B008
) -> DataFrame:
    """The same windows under seven fusion variants, scored and stacked by method.

    Variants share what their estimates are made of, and all of them are scored together.
    """
    depth = ["depth_par", "depth_lat"]
    alone = dis.point_variances(samples, None, model).drop("par_mean", "lat_mean", "overlaps")
    rows = dis.with_rays(dis.point_variances(alone.withColumnsRenamed(dict(zip(("var_par", "var_lat"), depth, strict=True))), evidence, model))
    # the conditions differ in the variances that they take and in the gauge's covariance: what they add up is written once
    parts = placed(fusion.world_parts(rows.where("valid"), gauge_table, more=depth))
    worlds = {
        "full": fusion.estimates_of(parts),
        "no_gauge": fusion.estimates_of(parts, gauge=False),
        "no_disagreement": fusion.estimates_of(parts, *depth),
    }
    out = None
    for name, (method, mode) in VARIANTS.items():
        options = {"frame_keys": ["case_id", "frame"], "written": True} if method == "covariance_intersection" else {}
        fused = fusion.fuse(worlds[mode], dis.CELL, method, **options).drop("weights").withColumn("variant", F.lit(name))
        out = fused if out is None else out.unionByName(fused)
    assert out is not None
    m = scores.matched(out.withColumn("valid", F.lit(True)), truth)
    e = v3.sub(v3.vec(), v3.vec("t"))
    rows = m.withColumns({**dict(zip(("ex", "ey", "ez"), e, strict=True)), "target_norm": v3.norm(v3.vec("t"))})
    return scores.frame_cards(rows, ["case_id", "variant"])


def gauge_ablation(edges: DataFrame, truth_gauges: DataFrame, threshold: float, lag: int = 4) -> DataFrame:
    """Gauge errors of the estimator variants against known gauges, one row per variant."""
    variants = {
        "sequential": gauges.sequential_gauges(edges),
        "tree": gauges.joint_tree(edges),
        "graph": gauges.joint_graph(edges),
        "guarded": gauges.guarded_gauges(edges, threshold),
        "fixed_lag": gauges.fixed_lag_gauges(edges, lag),
    }
    out = None
    for name, table in variants.items():
        row = gauges.gauge_error_summary(gauges.gauge_errors(table, truth_gauges)).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    assert out is not None
    return out


def transform_calibration(samples: DataFrame, truth: DataFrame, edges: DataFrame, q: float = 0.99) -> dict[str, DataFrame]:
    """Edge transforms against truth-implied relatives: block ratios and inflation fit."""
    fits = durable(align.metric_anchor(samples, truth, 1 << 62))
    errors = durable(gauges.edge_errors(edges, fits))
    ratios = durable(calibrate.block_ratios(errors))
    return {"errors": errors, "quantiles": calibrate.ratio_quantiles(ratios), "inflation": calibrate.fit_inflation(errors, q)}


def frame_errors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median error per frame, exact for any frame size."""
    e = rows.withColumn("err", v3.norm(v3.sub(v3.vec(), v3.vec("t"))))  # type: ignore[arg-type]
    return exact_quantiles(e, [*keys, "frame"], "err", {"median": 0.5})
