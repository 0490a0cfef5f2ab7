"""Hierarchical means, paired comparisons, gates, selection and decision rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.operators.bootstrap import group_bootstrap
from obsfuse.operators.ranking import with_row_number
from obsfuse.runtime import durable, maybe_broadcast


def _reasons(*checks: tuple[Column, str]) -> Column:
    """Sorted array of the names whose condition holds (null conditions do not count)."""
    return F.array_sort(
        F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda r: r.isNotNull())
    )


def hierarchical_means(
    df: DataFrame, levels: Sequence[str], fixed: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Mean over the last level, then the next, ...; rows are never pooled.

    ``levels`` run from outermost to innermost, e.g. group, case, seed, frame.
    """
    out = df
    for depth in range(len(levels), 0, -1):
        out = out.groupBy(*fixed, *levels[:depth]).agg(*[F.avg(m).alias(m) for m in metrics])
    return out


def case_seed_metrics(records: DataFrame, keys: Sequence[str], frame: str = "frame_index") -> DataFrame:
    """Mean squared errors, mean proper score, absolute drift and ratio-of-sums metrics."""
    def mse(c: str) -> Column:
        return F.avg(F.col(c) * F.col(c))

    def ratio(num: str, den: str) -> Column:
        return F.sum(num) / F.sum(den)

    return records.groupBy(*keys).agg(
        mse("point_error").alias("point_mse"),
        mse("endpoint_error").alias("endpoint_mse"),
        F.avg("proper_score").alias("proper_score"),
        mse("seam_error").alias("seam_mse"),
        F.abs(F.regr_slope("point_error", frame)).alias("absolute_drift_slope"),
        ratio("association_correct", "association_predicted").alias("association_precision"),
        ratio("identity_retained", "identity_reference").alias("identity_retention"),
        ratio("support_retained", "support_reference").alias("support_retention"),
    )


GROUP_METRICS = [
    "point_mse", "endpoint_mse", "proper_score", "seam_mse", "absolute_drift_slope",
    "association_precision", "identity_retention", "support_retention",
]


def group_competence(records: DataFrame, frame: str = "frame_index") -> DataFrame:
    """Case-seed metrics averaged over seeds, then cases; roots of MSEs at group level."""
    seeds = case_seed_metrics(records, ["arm_id", "group_id", "case_id", "random_seed"], frame)
    cases = seeds.groupBy("arm_id", "group_id", "case_id").agg(*[F.avg(m).alias(m) for m in GROUP_METRICS])
    g = cases.groupBy("arm_id", "group_id").agg(*[F.avg(m).alias(m) for m in GROUP_METRICS])
    return g.select(
        "arm_id", "group_id", "proper_score",
        F.sqrt("point_mse").alias("point_rmse"),
        F.sqrt("endpoint_mse").alias("endpoint_rmse"),
        F.sqrt("seam_mse").alias("seam_rmse"),
        "absolute_drift_slope", "association_precision", "identity_retention", "support_retention",
    )


@dataclass(frozen=True)
class CompetencePolicy:
    maximum_mean_proper_score_delta: float = 0.0
    maximum_mean_point_rmse_ratio: float = 1.0
    maximum_mean_endpoint_rmse_ratio: float = 1.0
    maximum_worst_group_point_rmse_ratio: float = 1.1
    maximum_mean_absolute_drift_slope: float = 0.01
    maximum_mean_seam_rmse: float = 0.05
    minimum_mean_quality_group_pass_fraction: float = 0.8
    minimum_mean_association_precision: float = 0.9
    minimum_mean_identity_retention: float = 0.9
    minimum_mean_support_retention: float = 0.9
    minimum_identity_group_pass_fraction: float = 0.8


def pair_groups(groups: DataFrame, candidate: str, baseline: str) -> DataFrame:
    metrics = [c for c in groups.columns if c not in {"arm_id", "group_id"}]
    c = groups.where(F.col("arm_id") == candidate).select("group_id", *[F.col(m).alias(f"candidate_{m}") for m in metrics])
    b = groups.where(F.col("arm_id") == baseline).select("group_id", *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    return c.join(b, "group_id")


def competence_gates(paired: DataFrame, policy: CompetencePolicy = CompetencePolicy()) -> DataFrame:  # noqa: B008
    """Equal-group candidate-versus-baseline gates with reasons and statuses (one row)."""
    p = policy
    delta = F.col("candidate_proper_score") - F.col("baseline_proper_score")
    point = F.col("candidate_point_rmse") / F.col("baseline_point_rmse")
    endpoint = F.col("candidate_endpoint_rmse") / F.col("baseline_endpoint_rmse")
    drift, seam = F.col("candidate_absolute_drift_slope"), F.col("candidate_seam_rmse")
    quality = (
        (delta <= p.maximum_mean_proper_score_delta)
        & (point <= p.maximum_worst_group_point_rmse_ratio)
        & (endpoint <= p.maximum_mean_endpoint_rmse_ratio)
        & (drift <= p.maximum_mean_absolute_drift_slope)
        & (seam <= p.maximum_mean_seam_rmse)
    )
    identity = (
        (F.col("candidate_association_precision") >= p.minimum_mean_association_precision)
        & (F.col("candidate_identity_retention") >= p.minimum_mean_identity_retention)
        & (F.col("candidate_support_retention") >= p.minimum_mean_support_retention)
    )

    def share(c: Column) -> Column:
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    agg = paired.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg(delta).alias("mean_proper_score_delta"),
        F.avg(point).alias("mean_point_rmse_ratio"),
        F.avg(endpoint).alias("mean_endpoint_rmse_ratio"),
        F.max(point).alias("worst_group_point_rmse_ratio"),
        F.avg(drift).alias("mean_absolute_drift_slope"),
        F.avg(seam).alias("mean_seam_rmse"),
        F.avg("candidate_association_precision").alias("mean_association_precision"),
        F.avg("candidate_identity_retention").alias("mean_identity_retention"),
        F.avg("candidate_support_retention").alias("mean_support_retention"),
        share(quality).alias("quality_pass_fraction"),
        share(identity).alias("identity_pass_fraction"),
    )
    c = F.col
    quality_reasons = _reasons(
        (c("mean_proper_score_delta") > p.maximum_mean_proper_score_delta, "proper-score-regression"),
        (c("mean_point_rmse_ratio") > p.maximum_mean_point_rmse_ratio, "point-rmse-regression"),
        (c("mean_endpoint_rmse_ratio") > p.maximum_mean_endpoint_rmse_ratio, "endpoint-rmse-regression"),
        (c("worst_group_point_rmse_ratio") > p.maximum_worst_group_point_rmse_ratio, "worst-group-point-rmse-regression"),
        (c("mean_absolute_drift_slope") > p.maximum_mean_absolute_drift_slope, "drift-slope-exceeded"),
        (c("mean_seam_rmse") > p.maximum_mean_seam_rmse, "seam-error-exceeded"),
        (c("quality_pass_fraction") < p.minimum_mean_quality_group_pass_fraction, "quality-pass-fraction-below-minimum"),
    )
    identity_reasons = _reasons(
        (c("mean_association_precision") < p.minimum_mean_association_precision, "association-precision-below-minimum"),
        (c("mean_identity_retention") < p.minimum_mean_identity_retention, "identity-retention-below-minimum"),
        (c("mean_support_retention") < p.minimum_mean_support_retention, "support-retention-below-minimum"),
        (c("identity_pass_fraction") < p.minimum_identity_group_pass_fraction, "identity-pass-fraction-below-minimum"),
    )
    out = agg.withColumns({"quality_reasons": quality_reasons, "identity_reasons": identity_reasons})
    return out.withColumns(
        {
            "quality_status": F.when(F.size("quality_reasons") == 0, "pass").otherwise("fail"),
            "identity_status": F.when(F.size("identity_reasons") == 0, "pass").otherwise("fail"),
            "passed": (F.size("quality_reasons") == 0) & (F.size("identity_reasons") == 0),
        }
    )


def safe_ratio(candidate: Column, baseline: Column) -> tuple[Column, Column]:
    """Ratio with 0/0 = 1 and x/0 = null plus a reason."""
    ratio = F.when(baseline > 0, candidate / baseline).when(candidate == 0, F.lit(1.0))
    reason = F.when((baseline <= 0) & (candidate != 0), F.lit("baseline-zero-with-positive-candidate"))
    return ratio, reason


def paired_endpoint_ratios(
    paired: DataFrame, ratios: Sequence[str], deltas: Sequence[str], max_ratio: float, min_delta: float
) -> DataFrame:
    """Per group: candidate/baseline ratios, deltas, pass flags and reasons."""
    cols: dict[str, Column] = {}
    checks = []
    for m in ratios:
        r, why = safe_ratio(F.col(f"candidate_{m}"), F.col(f"baseline_{m}"))
        cols[f"{m}_ratio"] = r
        checks += [(why.isNotNull(), f"{m}-baseline-zero-with-positive-candidate"), (r > max_ratio, f"{m}-ratio-exceeded")]
    low = []
    for m in deltas:
        d = F.col(f"candidate_{m}") - F.col(f"baseline_{m}")
        cols[f"{m}_delta"] = d
        low.append((d < min_delta, f"{m}-delta-below-minimum"))
    out = paired.withColumns({**cols, "quality_reasons": _reasons(*checks), "identity_reasons": _reasons(*low)})
    return out.withColumns(
        {"quality_pass": F.size("quality_reasons") == 0, "identity_pass": F.size("identity_reasons") == 0}
    )


def endpoint_aggregate(rows: DataFrame, ratios: Sequence[str], deltas: Sequence[str]) -> DataFrame:
    """Means and worst values; a mean of ratios is null when any group ratio is null."""
    aggs = [F.count(F.lit(1)).alias("groups")]
    for m in ratios:
        whole = F.count(f"{m}_ratio") == F.count(F.lit(1))
        aggs += [F.when(whole, F.avg(f"{m}_ratio")).alias(f"mean_{m}_ratio"), F.when(whole, F.max(f"{m}_ratio")).alias(f"worst_{m}_ratio")]
    for m in deltas:
        aggs += [F.avg(f"{m}_delta").alias(f"mean_{m}_delta"), F.min(f"{m}_delta").alias(f"worst_{m}_delta")]
    for f in ("quality", "identity"):
        aggs.append(F.avg(F.when(F.col(f"{f}_pass"), 1.0).otherwise(0.0)).alias(f"{f}_pass_fraction"))
    return rows.agg(*aggs)


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Frozen-edge bin: number of edges <= value, minus one; below the first is an error."""
    n = sum((F.when(value >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(n >= 1, n - 1).otherwise(F.raise_error(F.lit("value below the first bin edge")).cast("int"))


def strata_report(
    records: DataFrame,
    feature: str,
    edges: Sequence[float],
    metric: str,
    contrasts: Sequence[tuple[str, str]],
    minimum_groups: int,
    levels: Sequence[str] = ("group_id", "case_id", "seed"),
) -> tuple[DataFrame, DataFrame]:
    """Per (bin, arm) equal-group means, and per (bin, contrast) paired group deltas."""
    binned = records.withColumn("bin", bin_index(F.col(feature), edges))
    group, *inner = levels
    means = binned.groupBy("bin", "arm_id", *levels).agg(F.avg(metric).alias(metric))
    for depth in range(len(inner), 0, -1):
        means = means.groupBy("bin", "arm_id", group, *inner[: depth - 1]).agg(F.avg(metric).alias(metric))
    arms = means.groupBy("bin", "arm_id").agg(F.count(F.lit(1)).alias("groups"), F.avg(metric).alias(metric))
    arms = arms.withColumn("meets_minimum", F.col("groups") >= minimum_groups)
    out = None
    for treatment, control in contrasts:
        t = means.where(F.col("arm_id") == treatment).select("bin", group, F.col(metric).alias("t"))
        c = means.where(F.col("arm_id") == control).select("bin", group, F.col(metric).alias("c"))
        d = t.join(c, ["bin", group]).groupBy("bin").agg(
            F.count(F.lit(1)).alias("groups"), F.avg(F.col("t") - F.col("c")).alias("delta")
        ).select("bin", F.lit(treatment).alias("treatment"), F.lit(control).alias("control"), "groups", "delta")
        out = d if out is None else out.unionByName(d)
    assert out is not None
    return arms, out


def shared_metrics(long_metrics: DataFrame, roster: Sequence[str]) -> DataFrame:
    """Keep only metrics present for every ``roster`` key (e.g. every group)."""
    total = long_metrics.select(*roster).distinct().agg(F.count(F.lit(1)).alias("__all"))
    have = long_metrics.select("metric", *roster).distinct().groupBy("metric").agg(F.count(F.lit(1)).alias("__have"))
    keep = have.crossJoin(F.broadcast(total)).where("__have = __all").select("metric")
    return long_metrics.join(keep, "metric", "left_semi")


def aggregate_methods(metrics: DataFrame, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Long rows (method_id, group_id, case_id, metric, value) -> equal-group summary.

    Adds the worst group for coverage shortfall metrics.
    """
    groups = metrics.groupBy("method_id", "metric", "group_id").agg(F.avg("value").alias("value"))
    boot = group_bootstrap(groups, ["method_id", "metric"], "group_id", "value", resamples, seed)
    worst = groups.where(F.col("metric").endswith("shortfall_95")).groupBy("method_id", "metric").agg(
        F.max("value").alias("worst_group_mean"),
        F.max_by("group_id", F.struct(F.col("value"), F.col("group_id"))).alias("worst_group_id"),
    )
    return boot.join(worst, ["method_id", "metric"], "left")


def paired_comparison(metrics: DataFrame, reference: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Candidate - reference within case, mean per group, then bootstrap over groups."""
    ref = metrics.where(F.col("method_id") == reference).select("group_id", "case_id", "metric", F.col("value").alias("r"))
    cand = metrics.where(F.col("method_id") != reference)
    diff = cand.join(ref, ["group_id", "case_id", "metric"]).withColumn("value", F.col("value") - F.col("r"))
    groups = diff.groupBy("method_id", "metric", "group_id").agg(F.avg("value").alias("value"))
    return group_bootstrap(groups, ["method_id", "metric"], "group_id", "value", resamples, seed)


def decision_rules(comparisons: DataFrame, rules: DataFrame, minimum_groups: int) -> tuple[DataFrame, DataFrame]:
    """Apply frozen rules (method_id, metric, direction, test, margin).

    Lower-is-better tests use the upper bound against -margin (superiority) or +margin
    (non-inferiority); higher-is-better mirrors it.  A rule without comparison fails.
    """
    j = rules.join(comparisons, ["method_id", "metric"], "left")
    sup = F.col("test") == "superiority"
    m = F.col("margin")
    lower = F.when(sup, F.col("ci_upper") <= -m).otherwise(F.col("ci_upper") <= m)
    higher = F.when(sup, F.col("ci_lower") >= m).otherwise(F.col("ci_lower") >= -m)
    ok = F.coalesce(F.when(F.col("direction") == "lower", lower).otherwise(higher), F.lit(False))
    results = j.withColumn("passed", ok)
    overall = results.agg(
        F.count(F.lit(1)).alias("rules"),
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("passed_rules"),
        F.min("groups").alias("groups"),
    )
    overall = overall.withColumn("group_count_passed", F.coalesce(F.col("groups") >= minimum_groups, F.lit(False)))
    return results, overall.withColumn(
        "overall_passed", F.col("group_count_passed") & (F.col("passed_rules") == F.col("rules"))
    )


@dataclass(frozen=True)
class QueryGuardPolicy:
    superiority_margin: float = 0.0
    harmful_margin: float = 0.0
    maximum_harmful: int = 0
    maximum_worst_regression: float = 0.0
    maximum_technical_failures: int = 0
    minimum_accepted_coverage: float | None = None
    minimum_groups: int = 1


def guarded_query(
    rows: DataFrame, fallback_arm: str, primary_arm: str, policy: QueryGuardPolicy, resamples: int = 2000, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Per-arm guarded-query summary and the seven conjunctive gates of the primary arm.

    Rows: group_id, arm_id, query_rmse, accepted, accepted_coverage, accepted_width,
    exact_fallback, technical_failure.  The rows are written once: a sum of fractions may come out different when it
    is computed again, and a rejected arm must equal its fallback bit by bit.
    """
    rows = durable(rows)
    fb = rows.where(F.col("arm_id") == fallback_arm).select("group_id", F.col("query_rmse").alias("fallback_rmse"))
    j = rows.join(fb, "group_id").withColumn("delta", F.col("query_rmse") - F.col("fallback_rmse"))
    live = F.col("arm_id") != fallback_arm
    acc = live & F.coalesce(F.col("accepted"), F.lit(False))
    rej = live & ~F.coalesce(F.col("accepted"), F.lit(True))
    exact = F.coalesce(F.col("exact_fallback"), F.lit(False)) & (F.col("query_rmse") == F.col("fallback_rmse"))

    def count(c: Column, name: str) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).alias(name)

    arms = j.groupBy("arm_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("query_rmse").alias("mean_rmse"),
        F.avg("delta").alias("mean_delta"),
        F.max("delta").alias("worst_regression"),
        count(acc, "accepted_count"),
        count(rej, "rejected_count"),
        count(acc & (F.col("delta") > policy.harmful_margin), "harmful_count"),
        count(live & F.col("technical_failure"), "technical_failures"),
        count(rej & exact, "exact_fallback_count"),
        count(rej & ~exact, "exact_fallback_failures"),
        F.avg(F.when(acc, F.col("accepted_coverage"))).alias("mean_accepted_coverage"),
        F.avg(F.when(acc, F.col("accepted_width"))).alias("mean_accepted_width"),
    )
    total_failures = arms.agg(F.sum("exact_fallback_failures").alias("all_exact_failures"))
    boot = group_bootstrap(
        j.where(F.col("arm_id") == primary_arm).select("group_id", "delta"), [], "group_id", "delta", resamples, seed
    ).select("ci_lower", "ci_upper")
    d = arms.where(F.col("arm_id") == primary_arm).crossJoin(boot).crossJoin(total_failures)
    cov = F.lit(True) if policy.minimum_accepted_coverage is None else F.coalesce(
        F.col("mean_accepted_coverage") >= policy.minimum_accepted_coverage, F.lit(False)
    )
    gates = {
        "group_count_passed": F.col("groups") >= policy.minimum_groups,
        "superiority_passed": F.col("ci_upper") <= -policy.superiority_margin,
        "harmful_passed": F.col("harmful_count") <= policy.maximum_harmful,
        "worst_regression_passed": F.col("worst_regression") <= policy.maximum_worst_regression,
        "technical_passed": F.col("technical_failures") <= policy.maximum_technical_failures,
        "coverage_passed": cov,
        "exact_fallback_passed": F.col("all_exact_failures") == 0,
    }
    overall = F.lit(True)
    for g in gates.values():
        overall = overall & g
    return arms, d.withColumns({**gates, "overall_passed": overall})


@dataclass(frozen=True)
class MetricOrder:
    metric: str
    aggregation: str = "mean"
    direction: str = "min"


@dataclass(frozen=True)
class Constraint:
    metric: str
    aggregation: str
    relation: str
    threshold: float


@dataclass(frozen=True)
class SelectionRule:
    primary: MetricOrder
    tie_breaks: tuple[MetricOrder, ...] = ()
    constraints: tuple[Constraint, ...] = field(default_factory=tuple)


_AGG = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def candidate_order(rows: DataFrame, rule: SelectionRule) -> DataFrame:
    """Rank candidates: feasible first by primary, tie-breaks, complexity, id.

    ``rows``: candidate_id, complexity_rank, group_id and one column per metric; the
    matrix must be rectangular (checked by ``roster_completeness``).
    """
    orders = [rule.primary, *rule.tie_breaks]
    wanted = {(o.metric, o.aggregation) for o in [*orders, *rule.constraints]}
    agg = rows.groupBy("candidate_id").agg(
        F.max("complexity_rank").alias("complexity_rank"),
        F.count(F.lit(1)).alias("groups"),
        *[_AGG[a](m).alias(f"{m}_{a}") for m, a in sorted(wanted)],
    )
    failed = F.lit(0)
    for c in rule.constraints:
        v = F.col(f"{c.metric}_{c.aggregation}")
        ok = v <= c.threshold if c.relation == "<=" else v >= c.threshold
        failed = failed + F.when(ok, 0).otherwise(1)
    agg = agg.withColumn("failed_constraints", failed)
    feasible = F.col("failed_constraints") == 0
    agg = agg.withColumn("feasible", feasible)
    zero = F.lit(0.0)
    keys: list[Column] = [F.when(feasible, 0).otherwise(1).alias("f")]
    keys.append(F.when(feasible, 0).otherwise(F.col("failed_constraints")))
    for o in orders:
        v = F.col(f"{o.metric}_{o.aggregation}")
        keys.append(F.when(feasible, v if o.direction == "min" else -v).otherwise(zero))
    keys += [F.col("complexity_rank"), F.col("candidate_id")]
    return with_row_number(agg, [], keys, "position").drop("position_total")


def selected_candidate(order: DataFrame) -> DataFrame:
    """The first candidate; raises when no candidate is feasible."""
    first = order.where("position = 1")
    ok = F.when(F.col("feasible"), F.col("candidate_id")).otherwise(
        F.raise_error(F.lit("no feasible candidate")).cast(order.schema["candidate_id"].dataType)
    )
    return first.withColumn("candidate_id", ok)


@dataclass(frozen=True)
class SelectiveThresholds:
    nominal_coverage: float = 0.9
    harmful_score_margin: float = 0.0
    maximum_accepted_coverage_shortfall: float = 0.05
    maximum_complete_policy_coverage_shortfall: float = 0.05
    maximum_harmful_accepted_fraction: float = 0.1
    minimum_mean_score_advantage: float = 0.0
    maximum_mean_width_ratio: float = 1.0
    minimum_accepted_group_count: int = 1
    maximum_selection_coverage_drop: float = 0.05
    maximum_worst_group_coverage_shortfall: float = 0.2


def selective_update_report(rows: DataFrame, t: SelectiveThresholds = SelectiveThresholds(), keys: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """Candidate / accepted / fallback / deployed means and eight criteria, one aggregation."""
    acc = F.col("accepted")

    def when_acc(c: str) -> Column:
        return F.avg(F.when(acc, F.col(c)))

    shortfall = F.greatest(F.lit(0.0), F.lit(t.nominal_coverage) - F.col("deployed_coverage"))
    harmful = acc & (F.col("candidate_score") > F.col("fallback_score") + t.harmful_score_margin)
    a = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.when(acc, 1).otherwise(0)).alias("accepted_groups"),
        *[F.avg(f"{who}_{what}").alias(f"{who}_{what}") for who in ("candidate", "fallback", "deployed") for what in ("coverage", "width", "score")],
        when_acc("candidate_coverage").alias("accepted_coverage"),
        when_acc("candidate_width").alias("accepted_width"),
        when_acc("fallback_width").alias("accepted_fallback_width"),
        when_acc("candidate_score").alias("accepted_score"),
        when_acc("fallback_score").alias("accepted_fallback_score"),
        F.sum(F.when(harmful, 1).otherwise(0)).alias("harmful_count"),
        F.max(shortfall).alias("worst_shortfall"),
    )
    c = F.col
    a = a.withColumns(
        {
            "selection_drop": c("candidate_coverage") - c("accepted_coverage"),
            "accepted_width_ratio": c("accepted_width") / c("accepted_fallback_width"),
            "deployed_width_ratio": c("deployed_width") / c("fallback_width"),
            "accepted_advantage": c("accepted_fallback_score") - c("accepted_score"),
            "deployed_advantage": c("fallback_score") - c("deployed_score"),
            "harmful_fraction": F.when(c("accepted_groups") > 0, c("harmful_count") / c("accepted_groups")).otherwise(0.0),
            "accepted_shortfall": F.when(c("accepted_coverage").isNotNull(), F.greatest(F.lit(0.0), F.lit(t.nominal_coverage) - c("accepted_coverage"))),
            "deployed_shortfall": F.greatest(F.lit(0.0), F.lit(t.nominal_coverage) - c("deployed_coverage")),
        }
    )

    def ok(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    criteria = {
        "ok_accepted_coverage": ok(c("accepted_shortfall") <= t.maximum_accepted_coverage_shortfall),
        "ok_policy_coverage": ok(c("deployed_shortfall") <= t.maximum_complete_policy_coverage_shortfall),
        "ok_harmful": ok(c("harmful_fraction") <= t.maximum_harmful_accepted_fraction),
        "ok_advantage": ok(c("accepted_advantage") >= t.minimum_mean_score_advantage),
        "ok_width": ok(c("accepted_width_ratio") <= t.maximum_mean_width_ratio),
        "ok_accepted_count": ok(c("accepted_groups") >= t.minimum_accepted_group_count),
        "ok_selection_drop": ok(c("selection_drop") <= t.maximum_selection_coverage_drop),
        "ok_worst_group": ok(c("worst_shortfall") <= t.maximum_worst_group_coverage_shortfall),
    }
    passed = F.lit(True)
    for v in criteria.values():
        passed = passed & v
    return a.withColumns({**criteria, "passed": passed})


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns -> (ids, metric, value); null values are absent metrics."""
    return df.unpivot(list(ids), list(metrics), "metric", "value").where("value IS NOT NULL")


def rules_table(spark, rules: Sequence[Mapping[str, object]]) -> DataFrame:  # noqa: ANN001
    return maybe_broadcast(
        spark.createDataFrame(
            [(r["method_id"], r["metric"], r["direction"], r["test"], float(r["margin"])) for r in rules],  # type: ignore[arg-type]
            "method_id string, metric string, direction string, test string, margin double",
        )
    )
