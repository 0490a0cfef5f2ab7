"""Queries over paired arms and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3
from obsfuse.operators import bootstrap, calibrate, conformal, groups, joins, scores
from obsfuse.plans import adapters as ad
from obsfuse.plans.adapters import ARMS_SQL, RESID_SQL
from obsfuse.plans.registry import query
from obsfuse.runtime import durable

# --- calibration ------------------------------------------------------------------------

_RATIO = f"""{RESID_SQL}, rt AS (
  SELECT *, (ex * rx + ey * ry + ez * rz) ** 2 / a AS par_ratio,
         greatest(sq - (ex * rx + ey * ry + ez * rz) ** 2, 0) / (2 * c) AS lat_ratio
  FROM (SELECT *, 0.6 AS rx, 0.0 AS ry, 0.8 AS rz FROM v_score))"""


def _ratios(spark, sf):
    r = ad.residuals(spark, sf).withColumns(
        {"rx": F.lit(0.6), "ry": F.lit(0.0), "rz": F.lit(0.8), "var_par": F.col("c_xx"), "var_lat": F.col("c_yy")}
    )
    return calibrate.structured_ratios(r)


_WIN = """qq AS (SELECT {g} quantile_cont(par_ratio, 0.99) AS qp, quantile_cont(lat_ratio, 0.99) AS ql FROM rt {by}),
u AS (SELECT {g} count(*) AS n, greatest(avg(least(par_ratio, qp)), 1e-6) AS par_update, avg(par_ratio) AS par_mse,
             greatest(avg(least(lat_ratio, ql)), 1e-6) AS lat_update, avg(lat_ratio) AS lat_mse FROM rt {join} {by})"""


@query(
    "winsorized_scale",
    "A11 A12",
    "n:long par_update:d lat_update:d par_mse:d lat_mse:d",
    f"WITH {_RATIO}, {_WIN.format(g='', by='', join=', qq')} SELECT * FROM u",
)
def _(spark, sf):
    return calibrate.pooled_calibration(_ratios(spark, sf))


@query(
    "group_scale",
    "A13",
    "group_id:long n:long par_update:d lat_update:d par_mse:d lat_mse:d",
    f"WITH {_RATIO}, {_WIN.format(g='group_id,', by='GROUP BY group_id', join='JOIN qq USING (group_id)')} SELECT * FROM u",
)
def _(spark, sf):
    return calibrate.group_calibration(_ratios(spark, sf))


@query(
    "group_balanced_scale",
    "A13",
    "groups:long n:long par_update:d lat_update:d par_mse:d lat_mse:d",
    f"WITH {_RATIO}, {_WIN.format(g='group_id,', by='GROUP BY group_id', join='JOIN qq USING (group_id)')} "
    "SELECT count(*) AS groups, sum(n) AS n, avg(par_update) AS par_update, avg(lat_update) AS lat_update, avg(par_mse) AS par_mse, avg(lat_mse) AS lat_mse FROM u",
)
def _(spark, sf):
    return calibrate.group_balanced_calibration(_ratios(spark, sf))


# --- conformal ----------------------------------------------------------------------------

_MAX = f"{RESID_SQL}, mx AS (SELECT group_id, max(m2) AS max_m2, count(*) AS steps FROM v_score WHERE valid GROUP BY 1)"


def _valid_scores(spark, sf):
    return scores.scored_residuals(ad.residuals(spark, sf).where("valid"))


@query(
    "conformal_threshold",
    "A32 T3",
    "n:long rank:long threshold:d miscoverage_bound:d",
    f"""WITH {RESID_SQL}, r AS (SELECT m2, row_number() OVER (ORDER BY m2) AS k, count(*) OVER () AS n FROM v_score WHERE valid)
SELECT n, k AS rank, m2 AS threshold, (n + 1 - k) / (n + 1) AS miscoverage_bound FROM r
WHERE k = ceil((n + 1) * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE)))""",
)
def _(spark, sf):
    return conformal.upper_threshold(_valid_scores(spark, sf), "m2", 0.1)


@query(
    "pathwise_max",
    "A34",
    "n:long rank:long threshold:d",
    f"""WITH {_MAX}, r AS (SELECT max_m2, row_number() OVER (ORDER BY max_m2) AS k, count(*) OVER () AS n FROM mx)
SELECT n, k AS rank, max_m2 AS threshold FROM r WHERE k = ceil((n + 1) * (CAST(1 AS DOUBLE) - CAST(0.05 AS DOUBLE)))""",
)
def _(spark, sf):
    return conformal.pathwise_threshold(_valid_scores(spark, sf), 0.05)


_LV = [(50, 0.5), (80, 0.8), (90, 0.9), (95, 0.95)]
_PATH_SQL = f"""WITH {RESID_SQL}, g AS (
  SELECT group_id, count(*) AS steps, max(m2) AS max_m2, sum(0.5 * (3 * {v3.LOG_2PI} + ln(det) + m2)) / (3 * count(*)) AS nll,
   {', '.join(f'avg(CASE WHEN m2 <= {v3.CHI2_3[p]} + 1e-12 * {v3.CHI2_3[p]} THEN 1.0 ELSE 0.0 END) AS c{n}' for n, p in _LV)}
  FROM v_score WHERE valid GROUP BY 1),
f AS (SELECT group_id, trajectory_id, step, valid, valid AND m2 > 7.8147279 * (1 + 1e-12) AS fail FROM v_score),
i AS (SELECT *, sum(CASE WHEN fail THEN 0 ELSE 1 END) OVER w AS fi, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER w AS vi
      FROM f WINDOW w AS (PARTITION BY group_id, trajectory_id ORDER BY step)),
fr AS (SELECT group_id, trajectory_id, max(l) AS run FROM (SELECT group_id, trajectory_id, fi, sum(CASE WHEN fail THEN 1 ELSE 0 END) AS l FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2),
vr AS (SELECT group_id, trajectory_id, max(l) AS run FROM (SELECT group_id, trajectory_id, vi, sum(CASE WHEN valid THEN 0 ELSE 1 END) AS l FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2),
sh AS (SELECT group_id, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS s FROM f GROUP BY 1)
SELECT a.*, b.*, c.*, d.* FROM (SELECT count(*) AS groups, sum(steps) AS steps,
  {', '.join(f'avg(c{n}) AS coverage_{n}, avg(CASE WHEN c{n} >= 1 THEN 1.0 ELSE 0.0 END) AS all_inside_{n}, avg(pow({p}, steps)) AS independence_{n}' for n, p in _LV)},
  avg(max_m2) AS mean_max_m2, avg(nll) AS nll_per_dimension, quantile_cont(max_m2, 0.5) AS median_max_m2,
  quantile_cont(max_m2, 0.9) AS p90_max_m2, quantile_cont(max_m2, 0.95) AS p95_max_m2 FROM g) a,
 (SELECT avg(s) AS mean_valid_fraction, min(s) AS minimum_valid_fraction FROM sh) b,
 (SELECT avg(run) AS mean_unsupported_run, max(run) AS maximum_unsupported_run FROM vr) c,
 (SELECT count(*) AS trajectories, avg(run) AS mean_failure_run, max(run) AS maximum_failure_run, quantile_cont(run, 0.9) AS p90_failure_run FROM fr) d"""


@query(
    "pathwise_diagnostics",
    "A35 W8",
    "groups:long steps:long "
    + " ".join(f"coverage_{n}:d all_inside_{n}:d independence_{n}:d" for n, _ in _LV)
    + " mean_max_m2:d nll_per_dimension:d median_max_m2:d p90_max_m2:d p95_max_m2:d mean_valid_fraction:d"
    " minimum_valid_fraction:d mean_unsupported_run:d maximum_unsupported_run:long trajectories:long"
    " mean_failure_run:d maximum_failure_run:long p90_failure_run:d",
    _PATH_SQL,
)
def _(spark, sf):
    res = ad.residuals(spark, sf)
    return conformal.pathwise_diagnostics(scores.scored_residuals(res.where("valid")), res)


@query(
    "conformal_availability",
    "A33",
    "group_id:long units:long coverage:d rank:long finite:bool coverage_bound:d minimum_count:long",
    f"""WITH {ARMS_SQL}, g AS (SELECT group_id, count(DISTINCT case_id) AS units FROM v_arms GROUP BY 1),
l AS (SELECT * FROM (VALUES (CAST(0.5 AS DECIMAL(12, 10)), 1), (0.8, 4), (0.9, 9), (0.95, 19), (0.99, 99)) t(q, need))
SELECT group_id, units, q AS coverage, ceil((units + 1) * q) AS rank, ceil((units + 1) * q) <= units AS finite,
  CASE WHEN ceil((units + 1) * q) <= units THEN ceil((units + 1) * q) / (units + 1) END AS coverage_bound, need AS minimum_count FROM g, l""",
)
def _(spark, sf):
    g = ad.arms(spark, sf).groupBy("group_id").agg(F.countDistinct("case_id").alias("units"))
    return conformal.availability(g, "units", ["0.5", "0.8", "0.9", "0.95", "0.99"])


# --- paired arms -----------------------------------------------------------------------------


def _case_arm(spark, sf):
    return ad.arms(spark, sf).groupBy("group_id", "case_id", "arm_id").agg(
        F.avg("metric").alias("metric"), F.sum("correct").alias("correct"), F.sum("predicted").alias("predicted")
    )


_CA = f"""{ARMS_SQL}, ca AS (SELECT group_id, case_id, arm_id, avg(metric) AS metric, sum(correct) AS correct, sum(predicted) AS predicted
  FROM v_arms GROUP BY 1, 2, 3)"""


@query(
    "roster_completeness",
    "J6 U2",
    "group_id:long case_id:long arm_id:str problem:str",
    f"""WITH {_CA}, e AS (SELECT * FROM (SELECT DISTINCT group_id, case_id FROM ca), (SELECT DISTINCT arm_id FROM ca))
SELECT e.*, 'missing' AS problem FROM e ANTI JOIN ca USING (group_id, case_id, arm_id)""",
)
def _(spark, sf):
    return joins.roster_completeness(_case_arm(spark, sf), [["group_id", "case_id"], ["arm_id"]])


@query(
    "paired_contrast",
    "J5",
    "group_id:long case_id:long candidate_metric:d baseline_metric:d",
    f"""WITH {_CA} SELECT f.group_id, f.case_id, f.metric AS candidate_metric, o.metric AS baseline_metric
FROM ca f JOIN ca o ON f.group_id = o.group_id AND f.case_id = o.case_id WHERE f.arm_id = 'F' AND o.arm_id = 'O'""",
)
def _(spark, sf):
    return joins.paired_arms(_case_arm(spark, sf), ["group_id", "case_id"], "F", "O", ["metric"])[0]


@query(
    "pairing_violations",
    "J5 U2",
    "group_id:long case_id:long reason:str",
    f"""WITH {_CA}, f AS (SELECT * FROM ca WHERE arm_id = 'F'), o AS (SELECT * FROM ca WHERE arm_id = 'O'),
j AS (SELECT coalesce(f.group_id, o.group_id) AS group_id, coalesce(f.case_id, o.case_id) AS case_id, f.predicted AS fp, o.predicted AS op
      FROM f FULL JOIN o ON f.group_id = o.group_id AND f.case_id = o.case_id)
SELECT group_id, case_id, CASE WHEN fp IS NULL THEN 'missing_candidate' WHEN op IS NULL THEN 'missing_baseline' ELSE 'denominator_mismatch:predicted' END AS reason
FROM j WHERE fp IS NULL OR op IS NULL OR fp <> op""",
)
def _(spark, sf):
    _, bad = joins.paired_arms(_case_arm(spark, sf), ["group_id", "case_id"], "F", "O", ["metric"], ["predicted"])
    return bad.select("group_id", "case_id", F.explode("reasons").alias("reason"))


@query(
    "hierarchical_means",
    "A19 A20",
    "group_id:long arm_id:str metric:d",
    f"""WITH {ARMS_SQL}, a AS (SELECT arm_id, group_id, case_id, seed, frame, avg(metric) AS m FROM v_arms GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT arm_id, group_id, case_id, seed, avg(m) AS m FROM a GROUP BY 1, 2, 3, 4),
c AS (SELECT arm_id, group_id, case_id, avg(m) AS m FROM b GROUP BY 1, 2, 3)
SELECT arm_id, group_id, avg(m) AS metric FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return groups.hierarchical_means(ad.arms(spark, sf), ["group_id", "case_id", "seed", "frame"], ["arm_id"], ["metric"])


def _competence_records(spark, sf):
    a = ad.arms(spark, sf)
    return a.select(
        "group_id", "case_id", "arm_id", F.col("seed").alias("random_seed"), F.col("frame").alias("frame_index"),
        (F.col("metric") / 100.0).alias("point_error"),
        ((F.col("record_id") % 17 + 1) / 9.0).alias("endpoint_error"),
        (F.col("metric") / 70.0).alias("proper_score"),
        F.when(F.col("record_id") % 3 == 0, (F.col("record_id") % 13 + 1) / 7.0).alias("seam_error"),
        F.col("correct").alias("association_correct"), F.col("predicted").alias("association_predicted"),
        (F.col("correct") % 7).alias("identity_retained"), F.lit(7).alias("identity_reference"),
        (F.col("correct") % 5).alias("support_retained"), F.lit(5).alias("support_reference"),
    )


_COMP = f"""{ARMS_SQL}, cs AS (SELECT arm_id, group_id, case_id, seed, avg((metric / 100.0) ** 2) AS point_mse, avg(((record_id % 17 + 1) / 9.0) ** 2) AS endpoint_mse,
  avg(metric / 70.0) AS proper_score, avg(CASE WHEN record_id % 3 = 0 THEN ((record_id % 13 + 1) / 7.0) ** 2 END) AS seam_mse,
  CASE WHEN count(DISTINCT frame) > 1 THEN abs(regr_slope(metric / 100.0, frame)) END AS absolute_drift_slope,
  sum(correct) / sum(predicted) AS association_precision, sum(correct % 7) / sum(7) AS identity_retention, sum(correct % 5) / sum(5) AS support_retention
  FROM v_arms GROUP BY 1, 2, 3, 4),
cc AS (SELECT arm_id, group_id, case_id, {', '.join(f'avg({m}) AS {m}' for m in groups.GROUP_METRICS)} FROM cs GROUP BY 1, 2, 3),
cg AS (SELECT arm_id, group_id, {', '.join(f'avg({m}) AS {m}' for m in groups.GROUP_METRICS)} FROM cc GROUP BY 1, 2),
gr AS (SELECT arm_id, group_id, proper_score, sqrt(point_mse) AS point_rmse, sqrt(endpoint_mse) AS endpoint_rmse, sqrt(seam_mse) AS seam_rmse,
  absolute_drift_slope, association_precision, identity_retention, support_retention FROM cg)"""


@query(
    "group_competence",
    "A20 A19 C5",
    "arm_id:str group_id:long proper_score:d point_rmse:d endpoint_rmse:d seam_rmse:d absolute_drift_slope:d association_precision:d identity_retention:d support_retention:d",
    f"WITH {_COMP} SELECT * FROM gr",
)
def _(spark, sf):
    return groups.group_competence(_competence_records(spark, sf))


@query(
    "competence_gates",
    "A21 C5",
    "groups:long mean_proper_score_delta:d mean_point_rmse_ratio:d mean_endpoint_rmse_ratio:d worst_group_point_rmse_ratio:d mean_absolute_drift_slope:d"
    " mean_seam_rmse:d mean_association_precision:d mean_identity_retention:d mean_support_retention:d quality_pass_fraction:d identity_pass_fraction:d"
    " quality_status:str identity_status:str passed:bool",
    f"""WITH {_COMP}, p AS (SELECT c.*, b.proper_score AS bp, b.point_rmse AS br, b.endpoint_rmse AS be FROM gr c JOIN gr b USING (group_id) WHERE c.arm_id = 'F' AND b.arm_id = 'O'),
a AS (SELECT count(*) AS groups, avg(proper_score - bp) AS mean_proper_score_delta, avg(point_rmse / br) AS mean_point_rmse_ratio,
  avg(endpoint_rmse / be) AS mean_endpoint_rmse_ratio, max(point_rmse / br) AS worst_group_point_rmse_ratio, avg(absolute_drift_slope) AS mean_absolute_drift_slope,
  avg(seam_rmse) AS mean_seam_rmse, avg(association_precision) AS mean_association_precision, avg(identity_retention) AS mean_identity_retention,
  avg(support_retention) AS mean_support_retention,
  avg(CASE WHEN proper_score - bp <= 0.05 AND point_rmse / br <= 1.1 AND endpoint_rmse / be <= 1.05 AND absolute_drift_slope <= 1 AND seam_rmse <= 1.2 THEN 1.0 ELSE 0.0 END) AS quality_pass_fraction,
  avg(CASE WHEN association_precision >= 0.4 AND identity_retention >= 0.3 AND support_retention >= 0.3 THEN 1.0 ELSE 0.0 END) AS identity_pass_fraction FROM p)
SELECT *, CASE WHEN q THEN 'pass' ELSE 'fail' END AS quality_status, CASE WHEN i THEN 'pass' ELSE 'fail' END AS identity_status, q AND i AS passed FROM (
SELECT *, mean_proper_score_delta <= 0.05 AND mean_point_rmse_ratio <= 1.05 AND mean_endpoint_rmse_ratio <= 1.05 AND worst_group_point_rmse_ratio <= 1.1
  AND mean_absolute_drift_slope <= 1 AND mean_seam_rmse <= 1.2 AND quality_pass_fraction >= 0.5 AS q,
  mean_association_precision >= 0.4 AND mean_identity_retention >= 0.3 AND mean_support_retention >= 0.3 AND identity_pass_fraction >= 0.5 AS i FROM a)""",
)
def _(spark, sf):
    policy = groups.CompetencePolicy(
        maximum_mean_proper_score_delta=0.05, maximum_mean_point_rmse_ratio=1.05, maximum_mean_endpoint_rmse_ratio=1.05,
        maximum_mean_absolute_drift_slope=1.0, maximum_mean_seam_rmse=1.2, minimum_mean_quality_group_pass_fraction=0.5,
        minimum_mean_association_precision=0.4, minimum_mean_identity_retention=0.3, minimum_mean_support_retention=0.3,
        minimum_identity_group_pass_fraction=0.5,
    )
    g = groups.group_competence(_competence_records(spark, sf))
    return groups.competence_gates(groups.pair_groups(g, "F", "O"), policy)


@query(
    "paired_endpoint_ratios",
    "A22",
    "group_id:long seam_rmse_ratio:d absolute_drift_slope_ratio:d association_precision_delta:d quality_pass:bool identity_pass:bool",
    f"""WITH {_COMP} SELECT c.group_id, c.seam_rmse / b.seam_rmse AS seam_rmse_ratio, c.absolute_drift_slope / b.absolute_drift_slope AS absolute_drift_slope_ratio,
  c.association_precision - b.association_precision AS association_precision_delta,
  c.seam_rmse / b.seam_rmse <= 1.1 AND c.absolute_drift_slope / b.absolute_drift_slope <= 1.1 AS quality_pass,
  c.association_precision - b.association_precision >= -0.02 AS identity_pass
FROM gr c JOIN gr b USING (group_id) WHERE c.arm_id = 'F' AND b.arm_id = 'O'""",
)
def _(spark, sf):
    g = groups.pair_groups(groups.group_competence(_competence_records(spark, sf)), "F", "O")
    return groups.paired_endpoint_ratios(g, ["seam_rmse", "absolute_drift_slope"], ["association_precision"], 1.1, -0.02)


_EDGES = [0.0, 100.0, 200.0, 300.0, 400.0]
_STRATA = f"""{ARMS_SQL}, b AS (SELECT *, CASE WHEN metric >= 400 THEN 4 WHEN metric >= 300 THEN 3 WHEN metric >= 200 THEN 2 WHEN metric >= 100 THEN 1 ELSE 0 END AS bin FROM v_arms),
s AS (SELECT bin, arm_id, group_id, case_id, seed, avg(correct) AS m FROM b GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT bin, arm_id, group_id, case_id, avg(m) AS m FROM s GROUP BY 1, 2, 3, 4),
g AS (SELECT bin, arm_id, group_id, avg(m) AS m FROM c GROUP BY 1, 2, 3)"""


@query(
    "strata_report",
    "A23",
    "bin:long arm_id:str groups:long correct:d meets_minimum:bool",
    f"WITH {_STRATA} SELECT bin, arm_id, count(*) AS groups, avg(m) AS correct, count(*) >= 20 AS meets_minimum FROM g GROUP BY 1, 2",
)
def _(spark, sf):
    return groups.strata_report(ad.arms(spark, sf), "metric", _EDGES, "correct", [("F", "O")], 20)[0]


@query(
    "strata_contrast",
    "A23",
    "bin:long treatment:str control:str groups:long delta:d",
    f"WITH {_STRATA} SELECT t.bin, t.arm_id AS treatment, c.arm_id AS control, count(*) AS groups, avg(t.m - c.m) AS delta FROM g t JOIN g c ON t.bin = c.bin AND t.group_id = c.group_id WHERE c.arm_id = 'O' AND t.arm_id IN ('F', 'P') GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return groups.strata_report(ad.arms(spark, sf), "metric", _EDGES, "correct", [("F", "O"), ("P", "O")], 20)[1]


# --- bootstrap and decisions ---------------------------------------------------------------

_P = 2147483647


def _draw_sql(slots: str, seed: int, b: str = "b", i: str = "i", n: str = "n") -> str:
    """Nested selects that repeat the arithmetic of ``draw_index``."""
    q = f"SELECT *, ({b} * 1000003 + {i} * 7919 + {seed * 104729 + 12345}) % {_P} AS x FROM ({slots})"
    for k in (48271, 69621, 16807):
        q = f"SELECT * EXCLUDE (x), (x * x + x * {k} + 7) % {_P} AS x FROM ({q})"
    return f"SELECT *, x % {n} AS pick FROM ({q})"


def _boot_sql(values: str, seed: int, reps: int, key: str = "method_id, metric") -> str:
    part = f"PARTITION BY {key}"
    keys = f"{key},"
    return f"""nv AS (SELECT {keys} group_id, value, row_number() OVER ({part} ORDER BY group_id) - 1 AS i, count(*) OVER ({part}) AS n FROM ({values})),
dr AS ({_draw_sql(f'SELECT nv.*, b FROM nv, range({reps}) t(b)', seed)}),
ms AS (SELECT {', '.join('d.' + k.strip() for k in key.split(','))}, d.b, avg(v.value) AS m FROM dr d JOIN nv v ON {' AND '.join(f'd.{k.strip()} = v.{k.strip()}' for k in key.split(','))} AND d.pick = v.i GROUP BY ALL),
ci AS (SELECT {keys} quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper FROM ms GROUP BY {key}),
bs AS (SELECT {keys} avg(value) AS mean, count(*) AS groups FROM nv GROUP BY {key})"""


def _long(spark, sf):
    return ad.arms(spark, sf).groupBy("group_id", "case_id", F.col("arm_id").alias("method_id")).agg(
        F.avg("metric").alias("price"), F.avg("correct").alias("coverage_shortfall_95")
    ).transform(lambda d: groups.unpivot_metrics(d, ["group_id", "case_id", "method_id"], ["price", "coverage_shortfall_95"]))


_LONG = f"""{ARMS_SQL}, lm AS (SELECT group_id, case_id, arm_id AS method_id, 'price' AS metric, avg(metric) AS value FROM v_arms GROUP BY 1, 2, 3
  UNION ALL SELECT group_id, case_id, arm_id, 'coverage_shortfall_95', avg(correct) FROM v_arms GROUP BY 1, 2, 3)"""
_GM = "SELECT method_id, metric, group_id, avg(value) AS value FROM lm GROUP BY 1, 2, 3"


@query(
    "group_bootstrap",
    "A24 A25 U3",
    "method_id:str metric:str mean:d groups:long ci_lower:d ci_upper:d worst_group_mean:d worst_group_id:long",
    f"""WITH {_LONG}, {_boot_sql(_GM, 3, 500)},
w AS (SELECT method_id, metric, max(value) AS worst_group_mean, arg_max(group_id, value) AS worst_group_id FROM ({_GM}) WHERE metric = 'coverage_shortfall_95' GROUP BY 1, 2)
SELECT * FROM bs JOIN ci USING (method_id, metric) LEFT JOIN w USING (method_id, metric)""",
)
def _(spark, sf):
    return groups.aggregate_methods(groups.shared_metrics(_long(spark, sf), ["group_id"]), 500, 3)


_PAIRED = """SELECT c.method_id, c.metric, c.group_id, avg(c.value - r.value) AS value FROM lm c JOIN lm r
  ON c.group_id = r.group_id AND c.case_id = r.case_id AND c.metric = r.metric WHERE r.method_id = 'O' AND c.method_id <> 'O' GROUP BY 1, 2, 3"""


@query(
    "paired_comparison",
    "A24 A25",
    "method_id:str metric:str mean:d groups:long ci_lower:d ci_upper:d",
    f"WITH {_LONG}, {_boot_sql(_PAIRED, 5, 500)} SELECT * FROM bs JOIN ci USING (method_id, metric)",
)
def _(spark, sf):
    return groups.paired_comparison(_long(spark, sf), "O", 500, 5)


_RULES = [
    {"method_id": "F", "metric": "price", "direction": "lower", "test": "noninferiority", "margin": 40.0},
    {"method_id": "P", "metric": "price", "direction": "lower", "test": "superiority", "margin": 0.0},
    {"method_id": "F", "metric": "coverage_shortfall_95", "direction": "higher", "test": "noninferiority", "margin": 1.0},
]
_RULES_SQL = ", ".join(f"('{r['method_id']}', '{r['metric']}', '{r['direction']}', '{r['test']}', CAST({r['margin']} AS DOUBLE))" for r in _RULES)


@query(
    "decision_rules",
    "A27",
    "method_id:str metric:str direction:str test:str passed:bool",
    f"""WITH {_LONG}, {_boot_sql(_PAIRED, 5, 500)}, rules AS (SELECT * FROM (VALUES {_RULES_SQL}) t(method_id, metric, direction, test, margin))
SELECT method_id, metric, direction, test, CASE WHEN direction = 'lower' THEN CASE WHEN test = 'superiority' THEN ci_upper <= -margin ELSE ci_upper <= margin END
  ELSE CASE WHEN test = 'superiority' THEN ci_lower >= margin ELSE ci_lower >= -margin END END AS passed FROM rules JOIN ci USING (method_id, metric)""",
)
def _(spark, sf):
    comparison = groups.paired_comparison(_long(spark, sf), "O", 500, 5)
    return groups.decision_rules(comparison, groups.rules_table(spark, _RULES), 10)[0]


@query(
    "block_bootstrap",
    "A26",
    "trajectory_id:str difference:d frames:long ci_lower:d ci_upper:d probability_better:d",
    f"""WITH {RESID_SQL}, fr AS (SELECT trajectory_id, frame, sum(ex * ex) AS cs, sum(ey * ey) AS bs, count(*) AS k FROM v_resid GROUP BY 1, 2),
nf AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY trajectory_id) AS n FROM fr),
dr AS ({_draw_sql('SELECT trajectory_id, n, p, p // 5 AS i, b FROM nf, range(400) t(b)', 11)}),
st AS (SELECT d.trajectory_id, d.b, (sum(f.cs) - sum(f.bs)) / sum(f.k) AS s FROM dr d JOIN nf f ON d.trajectory_id = f.trajectory_id AND f.p = (d.pick + d.p % 5) % d.n GROUP BY 1, 2),
ci AS (SELECT trajectory_id, quantile_cont(s, 0.025) AS ci_lower, quantile_cont(s, 0.975) AS ci_upper, avg(CASE WHEN s < 0 THEN 1.0 ELSE 0.0 END) AS probability_better FROM st GROUP BY 1)
SELECT trajectory_id, (sum(cs) - sum(bs)) / sum(k) AS difference, count(*) AS frames, max(ci_lower) AS ci_lower, max(ci_upper) AS ci_upper, max(probability_better) AS probability_better
FROM nf JOIN ci USING (trajectory_id) GROUP BY 1""",
)
def _(spark, sf):
    r = ad.residuals(spark, sf)
    fr = r.groupBy("trajectory_id", "frame").agg(
        F.sum(F.col("ex") ** 2).alias("cs"), F.sum(F.col("ey") ** 2).alias("bs"), F.count(F.lit(1)).alias("k")
    )
    return bootstrap.block_bootstrap(fr, ["trajectory_id"], "frame", "cs", "bs", "k", block=5, resamples=400, seed=11)


# --- selection -----------------------------------------------------------------------------


@query(
    "candidate_order",
    "A30",
    "candidate_id:str groups:long price_mean:d correct_min:d failed_constraints:long feasible:bool position:long",
    f"""WITH {ARMS_SQL}, m AS (SELECT arm_id || CAST(seed AS VARCHAR) AS candidate_id, max(seed) AS complexity_rank, group_id, avg(metric) AS price, avg(correct) AS correct FROM v_arms GROUP BY 1, 3),
a AS (SELECT candidate_id, max(complexity_rank) AS c, count(*) AS groups, avg(price) AS price_mean, min(correct) AS correct_min FROM m GROUP BY 1),
f AS (SELECT *, CASE WHEN correct_min >= 3.6 THEN 0 ELSE 1 END AS failed_constraints FROM a)
SELECT candidate_id, groups, price_mean, correct_min, failed_constraints, failed_constraints = 0 AS feasible,
  row_number() OVER (ORDER BY failed_constraints > 0, failed_constraints, CASE WHEN failed_constraints = 0 THEN price_mean ELSE 0 END, c, candidate_id) AS position FROM f""",
)
def _(spark, sf):
    rows = ad.arms(spark, sf).groupBy(
        F.concat("arm_id", F.col("seed").cast("string")).alias("candidate_id"), "group_id"
    ).agg(F.max("seed").alias("complexity_rank"), F.avg("metric").alias("price"), F.avg("correct").alias("correct"))
    rule = groups.SelectionRule(
        groups.MetricOrder("price"), constraints=(groups.Constraint("correct", "min", ">=", 3.6),)
    )
    return groups.candidate_order(rows, rule)


_SEL = f"""{ARMS_SQL}, s AS (SELECT case_id AS group_id, sum(correct) % 3 <> 0 AS accepted,
  avg(CASE WHEN correct > 1 THEN 1.0 ELSE 0.0 END) AS candidate_coverage, avg(CASE WHEN correct > 2 THEN 1.0 ELSE 0.0 END) AS fallback_coverage,
  avg(metric) / 70.0 AS candidate_width, avg(metric) / 63.0 AS fallback_width, avg(correct) / 7.0 AS candidate_score, avg(9 - correct) / 7.0 AS fallback_score
  FROM v_arms GROUP BY 1),
d AS (SELECT *, CASE WHEN accepted THEN candidate_coverage ELSE fallback_coverage END AS deployed_coverage,
  CASE WHEN accepted THEN candidate_width ELSE fallback_width END AS deployed_width, CASE WHEN accepted THEN candidate_score ELSE fallback_score END AS deployed_score FROM s)"""


def _selective(spark, sf):
    s = ad.arms(spark, sf).groupBy(F.col("case_id").alias("group_id")).agg(
        (F.sum("correct") % 3 != 0).alias("accepted"),
        F.avg(F.when(F.col("correct") > 1, 1.0).otherwise(0.0)).alias("candidate_coverage"),
        F.avg(F.when(F.col("correct") > 2, 1.0).otherwise(0.0)).alias("fallback_coverage"),
        (F.avg("metric") / 70.0).alias("candidate_width"),
        (F.avg("metric") / 63.0).alias("fallback_width"),
        (F.avg("correct") / 7.0).alias("candidate_score"),
        (F.avg(9 - F.col("correct")) / 7.0).alias("fallback_score"),
    )
    return s.withColumns(
        {
            f"deployed_{c}": F.when(F.col("accepted"), F.col(f"candidate_{c}")).otherwise(F.col(f"fallback_{c}"))
            for c in ("coverage", "width", "score")
        }
    )


@query(
    "selective_update",
    "A31",
    "groups:long accepted_groups:long candidate_coverage:d accepted_coverage:d deployed_coverage:d selection_drop:d accepted_width_ratio:d deployed_width_ratio:d"
    " accepted_advantage:d deployed_advantage:d harmful_count:long harmful_fraction:d worst_shortfall:d ok_width:bool ok_advantage:bool passed:bool",
    f"""WITH {_SEL}, a AS (SELECT count(*) AS groups, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS accepted_groups, avg(candidate_coverage) AS candidate_coverage,
  avg(candidate_coverage) FILTER (accepted) AS accepted_coverage, avg(deployed_coverage) AS deployed_coverage,
  avg(candidate_width) FILTER (accepted) / avg(fallback_width) FILTER (accepted) AS accepted_width_ratio, avg(deployed_width) / avg(fallback_width) AS deployed_width_ratio,
  avg(fallback_score) FILTER (accepted) - avg(candidate_score) FILTER (accepted) AS accepted_advantage, avg(fallback_score) - avg(deployed_score) AS deployed_advantage,
  sum(CASE WHEN accepted AND candidate_score > fallback_score THEN 1 ELSE 0 END) AS harmful_count, max(greatest(0, 0.9 - deployed_coverage)) AS worst_shortfall FROM d),
b AS (SELECT *, candidate_coverage - accepted_coverage AS selection_drop, harmful_count / accepted_groups AS harmful_fraction, accepted_width_ratio <= 1 AS ok_width, accepted_advantage >= 0 AS ok_advantage FROM a)
SELECT *, ok_width AND ok_advantage AND greatest(0, 0.9 - accepted_coverage) <= 0.05 AND greatest(0, 0.9 - deployed_coverage) <= 0.05 AND harmful_fraction <= 0.1
  AND selection_drop <= 0.05 AND worst_shortfall <= 0.2 AS passed FROM b""",
)
def _(spark, sf):
    return groups.selective_update_report(_selective(spark, sf))


def _query_rows(spark, sf):
    a = durable(ad.arms(spark, sf).groupBy("group_id", "arm_id").agg(
        (F.avg("metric") / 9.0).alias("rmse"), F.sum("correct").alias("k"), F.avg("correct").alias("cov")
    ))
    fb = a.where("arm_id = 'O'").select("group_id", F.col("rmse").alias("fr"))
    j = a.join(fb, "group_id")
    acc = (F.col("k") % 4 != 0) & (F.col("arm_id") != "O")
    return j.select(
        "group_id", "arm_id",
        F.when(acc | (F.col("arm_id") == "O"), F.col("rmse")).otherwise(F.col("fr")).alias("query_rmse"),
        F.when(F.col("arm_id") != "O", acc).alias("accepted"),
        (F.col("cov") / 9.0).alias("accepted_coverage"), (F.col("cov") / 3.0).alias("accepted_width"),
        F.when((F.col("arm_id") != "O") & ~acc, F.lit(True)).alias("exact_fallback"),
        (F.col("k") % 11 == 0).alias("technical_failure"),
    )


_QR = f"""{ARMS_SQL}, a AS (SELECT group_id, arm_id, avg(metric) / 9.0 AS rmse, sum(correct) AS k, avg(correct) AS cov FROM v_arms GROUP BY 1, 2),
q AS (SELECT a.*, f.rmse AS fr, a.arm_id <> 'O' AND a.k % 4 <> 0 AS acc FROM a JOIN a f ON a.group_id = f.group_id AND f.arm_id = 'O'),
z AS (SELECT *, CASE WHEN acc OR arm_id = 'O' THEN rmse ELSE fr END AS r, arm_id <> 'O' AND NOT acc AS rej FROM q)"""


@query(
    "guarded_query_arms",
    "A28",
    "arm_id:str groups:long mean_rmse:d mean_delta:d worst_regression:d accepted_count:long rejected_count:long harmful_count:long technical_failures:long exact_fallback_count:long mean_accepted_coverage:d mean_accepted_width:d",
    f"""WITH {_QR} SELECT arm_id, count(*) AS groups, avg(r) AS mean_rmse, avg(r - fr) AS mean_delta, max(r - fr) AS worst_regression,
  sum(CASE WHEN acc THEN 1 ELSE 0 END) AS accepted_count, sum(CASE WHEN rej THEN 1 ELSE 0 END) AS rejected_count, sum(CASE WHEN acc AND r - fr > 1 THEN 1 ELSE 0 END) AS harmful_count,
  sum(CASE WHEN arm_id <> 'O' AND k % 11 = 0 THEN 1 ELSE 0 END) AS technical_failures, sum(CASE WHEN rej AND r = fr THEN 1 ELSE 0 END) AS exact_fallback_count,
  avg(cov / 9.0) FILTER (acc) AS mean_accepted_coverage, avg(cov / 3.0) FILTER (acc) AS mean_accepted_width FROM z GROUP BY 1""",
)
def _(spark, sf):
    return groups.guarded_query(_query_rows(spark, sf), "O", "F", groups.QueryGuardPolicy(harmful_margin=1.0), 400, 9)[0]


@query(
    "guarded_query",
    "A28 A25",
    "arm_id:str ci_lower:d ci_upper:d superiority_passed:bool harmful_passed:bool exact_fallback_passed:bool overall_passed:bool",
    f"""WITH {_QR}, {_boot_sql("SELECT 1 AS one, group_id, r - fr AS value FROM z WHERE arm_id = 'F'", 9, 400, 'one')},
h AS (SELECT sum(CASE WHEN acc AND r - fr > 1 THEN 1 ELSE 0 END) AS harmful, max(r - fr) AS worst, sum(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) AS tech FROM z WHERE arm_id = 'F'),
x AS (SELECT sum(CASE WHEN rej AND r <> fr THEN 1 ELSE 0 END) AS bad FROM z)
SELECT 'F' AS arm_id, ci_lower, ci_upper, ci_upper <= 0 AS superiority_passed, harmful <= 0 AS harmful_passed, bad = 0 AS exact_fallback_passed,
  ci_upper <= 0 AND harmful <= 0 AND bad = 0 AND worst <= 0 AND tech <= 0 AS overall_passed FROM ci, h, x""",
)
def _(spark, sf):
    return groups.guarded_query(_query_rows(spark, sf), "O", "F", groups.QueryGuardPolicy(harmful_margin=1.0), 400, 9)[1]


# --- corroboration --------------------------------------------------------------------------


def _pair_points(spark, sf):
    r = ad.residuals(spark, sf)
    return r.select(
        F.col("group_id").alias("case_id"), F.col("step").alias("row_id"), "valid",
        *[F.col(f"e{c}").alias(f"a_{c}") for c in "xyz"],
        (F.col("ex") * 0.7).alias("b_x"), (F.col("ey") * 0.9 + 0.1).alias("b_y"), (F.col("ez") * 0.8).alias("b_z"),
        *[F.col(f"c_{s}").alias(f"a_c_{s}") for s in v3.SYM],
        *[(F.col(f"c_{s}") * 1.5).alias(f"b_c_{s}") for s in v3.SYM],
    )


_COR = f"""{RESID_SQL}, k AS (SELECT *, 1 + sqrt(1.5) + 1.5 * (1 + 1 / sqrt(1.5)) AS f, ex * 0.3 AS dx, ey * 0.1 - 0.1 AS dy, ez * 0.2 AS dz FROM v_score),
s AS (SELECT group_id AS case_id, valid, sqrt(((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / d2 + dz * dz / e) / f / 3) AS row_score FROM k),
n AS (SELECT case_id, count(*) AS n, count(*) FILTER (valid) AS supported FROM s GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY row_score) - 1 AS i FROM s WHERE valid)"""


@query(
    "case_corroboration",
    "A59 P23",
    "case_id:long rows:long supported:long case_score:d mean_score:d median_score:d max_score:d support_fraction:d",
    f"""WITH {_COR} SELECT n.case_id, max(n.n) AS rows, max(supported) AS supported, max(CASE WHEN i = ceil((supported - 1) * 0.9) THEN row_score END) AS case_score,
  avg(row_score) AS mean_score, quantile_cont(row_score, 0.5) AS median_score, max(row_score) AS max_score, max(supported / n.n) AS support_fraction
FROM n JOIN rk ON n.case_id = rk.case_id GROUP BY 1""",
)
def _(spark, sf):
    return conformal.case_scores(_pair_points(spark, sf))


@query(
    "corroboration_decision",
    "A60 J16",
    "case_id:long case_score:d threshold:d accepted:bool",
    f"""WITH {_COR}, cs AS (SELECT n.case_id, max(CASE WHEN i = ceil((supported - 1) * 0.9) THEN row_score END) AS case_score, max(supported / n.n) AS sup FROM n JOIN rk ON n.case_id = rk.case_id GROUP BY 1),
cal AS (SELECT case_score, row_number() OVER (ORDER BY case_score) AS k, count(*) OVER () AS m FROM cs WHERE case_id % 2 = 0),
t AS (SELECT case_score AS threshold FROM cal WHERE k = ceil((m + 1) * (CAST(1 AS DOUBLE) - CAST(0.2 AS DOUBLE))))
SELECT case_id, case_score, threshold, case_score <= threshold AND sup >= 0.5 AS accepted FROM cs, t WHERE case_id % 2 = 1""",
)
def _(spark, sf):
    cases = conformal.case_scores(_pair_points(spark, sf))
    even, odd = cases.where("case_id % 2 = 0"), cases.where("case_id % 2 = 1")
    fit = conformal.fit_corroboration(even, 0.2, 0.5)
    return conformal.apply_corroboration(odd, fit, even, 0.5)
