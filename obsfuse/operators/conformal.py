"""Finite-sample thresholds, pathwise calibration and case corroboration."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3
from obsfuse.operators import ranking as rk
from obsfuse.operators.joins import assert_disjoint
from obsfuse.runtime import durable


def upper_threshold(
    scores: DataFrame, value: str, miscoverage: float, keys: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """k-th smallest score with k = ceil((n + 1)(1 - alpha)), and its guarantee.

    With ``strict`` a key whose rank exceeds n raises; otherwise its threshold is null.
    """
    k = rk.conformal_rank(F.col("cum_total"), miscoverage)
    out = rk.order_statistic(scores, keys, value, k, "threshold")
    rank = rk.conformal_rank(F.col("n"), miscoverage)
    bound = (F.col("n") + 1 - rank) / (F.col("n") + 1)
    threshold = F.col("threshold")
    if strict:
        need = rk.minimum_conformal_count(miscoverage)
        threshold = F.when(rank <= F.col("n"), threshold).otherwise(
            F.raise_error(F.lit(f"fewer than {need} independent groups for miscoverage {miscoverage}"))
        )
    return out.select(
        *keys, "n", rank.alias("rank"), threshold.alias("threshold"),
        F.when(rank <= F.col("n"), bound).alias("miscoverage_bound"),
    )


def availability(groups: DataFrame, count: str, coverages: Sequence[str]) -> DataFrame:
    """Rank, finiteness, guarantee and minimum group count per coverage, in decimals.

    ``coverages`` are decimal strings such as "0.95"; exact arithmetic decides ranks.
    """
    levels = []
    for text in coverages:
        q = Decimal(text)
        need = int((q / (1 - q)).to_integral_value(rounding=ROUND_CEILING))
        levels.append(F.struct(F.lit(q).cast("decimal(12,10)").alias("coverage"), F.lit(need).alias("minimum_count")))
    g = groups.withColumn("level", F.explode(F.array(*levels)))
    rank = F.ceil((F.col(count) + 1).cast("decimal(19,0)") * F.col("level.coverage")).cast("bigint")
    finite = rank <= F.col(count)
    return g.select(
        *groups.columns,
        F.col("level.coverage").cast("double").alias("coverage"),
        rank.alias("rank"),
        finite.alias("finite"),
        F.when(finite, rank / (F.col(count) + 1)).alias("coverage_bound"),
        F.col("level.minimum_count").alias("minimum_count"),
    )


def group_maxima(scored: DataFrame, group: str = "group_id") -> DataFrame:
    """Per independent group the maximum m2 over all tracks and valid steps."""
    return scored.groupBy(group).agg(F.max("m2").alias("max_m2"), F.count(F.lit(1)).alias("steps"))


def pathwise_threshold(scored: DataFrame, miscoverage: float = 0.05, group: str = "group_id") -> DataFrame:
    return upper_threshold(group_maxima(scored, group), "max_m2", miscoverage)


def at_most(value: Column, limit: Column | float) -> Column:
    """value <= limit with a relative tolerance of 1e-12."""
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    return value <= lim + F.lit(1e-12) * F.greatest(F.abs(lim), F.lit(1.0))


def pathwise_diagnostics(
    scored: DataFrame,
    support: DataFrame | None = None,
    calibration: DataFrame | None = None,
    group: str = "group_id",
    trajectory: str = "trajectory_id",
    step: str = "step",
) -> DataFrame:
    """Equal-group pathwise summary (one row).

    ``scored`` holds the valid rows (m2, nll); ``support`` all rows with a ``valid``
    flag.  ``calibration`` is the one-row output of :func:`pathwise_threshold` fitted on
    disjoint groups.
    """
    levels = [(int(round(p * 100)), p, q) for p, q in v3.CHI2_3.items()]
    per = scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("steps"),
        F.max("m2").alias("max_m2"),
        (F.sum("nll") / (3 * F.count(F.lit(1)))).alias("nll"),
        *[F.avg(F.when(at_most(F.col("m2"), q), 1.0).otherwise(0.0)).alias(f"c{n}") for n, _, q in levels],
    )
    if calibration is not None:
        per = per.crossJoin(F.broadcast(calibration.select(F.col("threshold").alias("__t"))))
        simultaneous = F.avg(F.when(at_most(F.col("max_m2"), F.col("__t")), 1.0).otherwise(0.0))
    else:
        simultaneous = F.lit(None).cast("double")
    out = per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("steps").alias("steps"),
        *[F.avg(f"c{n}").alias(f"coverage_{n}") for n, _, _ in levels],
        *[F.avg(F.when(F.col(f"c{n}") >= 1.0, 1.0).otherwise(0.0)).alias(f"all_inside_{n}") for n, _, _ in levels],
        *[F.avg(F.pow(F.lit(p), F.col("steps"))).alias(f"independence_{n}") for n, p, _ in levels],
        F.avg("max_m2").alias("mean_max_m2"),
        F.avg("nll").alias("nll_per_dimension"),
        simultaneous.alias("simultaneous_coverage"),
    )
    q = rk.exact_quantiles(per, [], "max_m2", {"median_max_m2": 0.5, "p90_max_m2": 0.9, "p95_max_m2": 0.95}).drop("n")
    out = out.crossJoin(q)
    flagged = scored.select(group, trajectory, step, (~at_most(F.col("m2"), v3.CHI2_3[0.95])).alias("__fail"))
    if support is not None:
        rows = support.select(group, trajectory, step, "valid").join(flagged, [group, trajectory, step], "left")
        rows = rows.withColumn("__fail", F.coalesce("__fail", F.lit(False)))
        holes = rk.longest_run(rows.withColumn("__hole", ~F.col("valid")), [group, trajectory], [step], "__hole", "hole")
        share = support.groupBy(group).agg(F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)).alias("f"))
        out = out.crossJoin(share.agg(F.avg("f").alias("mean_valid_fraction"), F.min("f").alias("minimum_valid_fraction")))
        out = out.crossJoin(holes.agg(F.avg("hole").alias("mean_unsupported_run"), F.max("hole").alias("maximum_unsupported_run")))
    else:
        rows = flagged
    runs = rk.longest_run(rows, [group, trajectory], [step], "__fail", "run")
    out = out.crossJoin(
        runs.agg(F.count(F.lit(1)).alias("trajectories"), F.avg("run").alias("mean_failure_run"), F.max("run").alias("maximum_failure_run"))
    )
    return out.crossJoin(rk.exact_quantiles(runs, [], "run", {"p90_failure_run": 0.9}).drop("n"))


# --- corroboration of two methods -------------------------------------------------------


def unknown_dependence_covariance(a: v3.Sym, b: v3.Sym) -> v3.Sym:
    """(1 + beta) A + (1 + 1/beta) B with beta = sqrt(tr B / tr A)."""
    beta = F.sqrt(v3.trace(b) / v3.trace(a))
    return tuple((1 + beta) * p + (1 + 1 / beta) * q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def difference_covariance(a: v3.Sym, b: v3.Sym, cross_sum: v3.Sym | None = None) -> v3.Sym:
    """A + B - (C + C^T) when the cross term is known, else the dependence-free bound."""
    if cross_sum is None:
        return unknown_dependence_covariance(a, b)
    return tuple(p + q - c for p, q, c in zip(a, b, cross_sum, strict=True))  # type: ignore[return-value]


def row_scores(pairs: DataFrame) -> DataFrame:
    """sqrt(m2 / 3) of a - b for pairs with columns a_*, b_*, a_c_*, b_c_*."""
    # Staged in columns: each later expression reads every entry several times.
    a, b = v3.sym("a_c_"), v3.sym("b_c_")
    staged = pairs.where("valid").withColumns(
        {
            "__beta": F.sqrt(v3.trace(b) / v3.trace(a)),
            **dict(zip(("__ex", "__ey", "__ez"), v3.sub(v3.vec("a_"), v3.vec("b_")), strict=True)),
        }
    )
    beta = F.col("__beta")
    staged = staged.withColumns(
        {f"__s_{n}": (1 + beta) * p + (1 + 1 / beta) * q for n, p, q in zip(v3.SYM, a, b, strict=True)}
    )
    score = F.sqrt(v3.mahalanobis2(v3.sym("__s_"), v3.vec("__e")) / 3.0)
    return staged.select(*pairs.columns, score.alias("row_score"))


def case_scores(pairs: DataFrame, q: float = 0.9, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Per case: 'higher' quantile of row scores, mean, median, max, support fraction."""
    keys = list(keys)
    rows = durable(row_scores(pairs).select(*keys, "row_score"))  # scored once, ranked twice
    sums = rows.groupBy(*keys).agg(
        F.avg("row_score").alias("mean_score"), F.max("row_score").alias("max_score"), F.count(F.lit(1)).alias("supported")
    )
    all_rows = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    hi = rk.higher_quantile(rows, keys, "row_score", q, "case_score").drop("n")
    med = rk.exact_quantiles(rows, keys, "row_score", {"median_score": 0.5}).drop("n")
    return (
        all_rows.join(sums, keys, "left").join(hi, keys, "left").join(med, keys, "left")
        .fillna({"supported": 0})
        .withColumn("support_fraction", F.col("supported") / F.col("rows"))
    )


def fit_corroboration(cases: DataFrame, miscoverage: float, minimum_support: float) -> DataFrame:
    """Threshold over calibration case scores; a case below the support gate raises."""
    ok = cases.withColumn(
        "case_score",
        F.when(F.col("support_fraction") >= minimum_support, F.col("case_score")).otherwise(
            F.raise_error(F.lit("calibration case below minimum support"))
        ),
    )
    return upper_threshold(ok, "case_score", miscoverage)


def apply_corroboration(
    targets: DataFrame, calibration: DataFrame, calibration_cases: DataFrame, minimum_support: float
) -> DataFrame:
    """Accept or reject target cases with reasons; calibration and target are disjoint."""
    assert_disjoint(targets, calibration_cases, "case_id")
    j = targets.crossJoin(F.broadcast(calibration.select("threshold")))
    reasons = F.filter(
        F.array(
            F.when(F.col("support_fraction") < minimum_support, F.lit("support-below-minimum")),
            F.when(F.col("case_score").isNull(), F.lit("no-supported-rows")),
            F.when(F.col("case_score") > F.col("threshold"), F.lit("score-above-threshold")),
        ),
        lambda r: r.isNotNull(),
    )
    return j.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
