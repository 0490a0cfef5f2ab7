"""Queries over residual rows: diagnostics, ranks, runs, alignment modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3
from obsfuse.operators import ranking as rk
from obsfuse.operators import scores
from obsfuse.plans import adapters as ad
from obsfuse.plans.adapters import RESID_SQL
from obsfuse.plans.registry import query

_COVER = ", ".join(
    f"avg(CASE WHEN m2 <= {q} THEN 1.0 ELSE 0.0 END) AS coverage_{int(round(p * 100))}"
    for p, q in v3.CHI2_3.items()
)
_DIAG_SQL = f"""WITH {RESID_SQL}, d AS (
  SELECT group_id, count(*) AS n, {_COVER}, avg(m2) AS mean_m2,
         avg(0.5 * (3 * {v3.LOG_2PI} + ln(det) + m2)) AS gaussian_nll,
         avg(a + c + e) AS mean_trace, avg(ln(det)) AS mean_log_det, avg(risk) AS mean_relative_error
  FROM v_score GROUP BY 1)
SELECT *, greatest(0.0, 0.95 - coverage_95) AS shortfall_95,
       (abs(coverage_50 - 0.5) + abs(coverage_80 - 0.8) + abs(coverage_90 - 0.9) + abs(coverage_95 - 0.95)) / 4 AS calibration_error
FROM d"""
_DIAG = (
    "n:long coverage_50:d coverage_80:d coverage_90:d coverage_95:d mean_m2:d gaussian_nll:d "
    "mean_trace:d mean_log_det:d mean_relative_error:d shortfall_95:d calibration_error:d"
)
_MEANS = [c.split(":")[0] for c in _DIAG.split() if c != "n:long"]


@query("uncertainty_by_group", "A18 F2 F5", "group_id:long " + _DIAG, _DIAG_SQL)
def _(spark, sf):
    return scores.uncertainty_diagnostics(ad.residuals(spark, sf), ["group_id"], ranks=False)


@query(
    "residual_scorecard",
    "A18 A19",
    "groups:long " + " ".join(f"{m}:d" for m in _MEANS),
    f"SELECT count(*) AS groups, {', '.join(f'avg({m}) AS {m}' for m in _MEANS)} FROM ({_DIAG_SQL})",
)
def _(spark, sf):
    per = scores.uncertainty_diagnostics(ad.residuals(spark, sf), ["group_id"], ranks=False)
    return scores.equal_group_means(per, _MEANS)


@query(
    "spearman_uncertainty",
    "W5",
    "group_id:long spearman:d",
    f"""WITH {RESID_SQL}, r AS (
  SELECT group_id, rank() OVER (PARTITION BY group_id ORDER BY score)
                 + (count(*) OVER (PARTITION BY group_id, score) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY group_id ORDER BY risk)
                 + (count(*) OVER (PARTITION BY group_id, risk) - 1) / 2.0 AS b
  FROM v_score)
SELECT group_id, coalesce(corr(a, b), 0) AS spearman FROM r GROUP BY 1""",
)
def _(spark, sf):
    return rk.spearman(scores.scored_residuals(ad.residuals(spark, sf)), ["group_id"], "score", "risk")


_RISK_SQL = f"""WITH {RESID_SQL}, r AS (
  SELECT group_id, score, risk, count(*) OVER (PARTITION BY group_id) AS n,
         rank() OVER (PARTITION BY group_id ORDER BY score) - 1 AS below,
         count(*) OVER (PARTITION BY group_id, score) AS tied
  FROM v_score)
SELECT group_id,
       sum(risk * greatest(0.0, least(tied, greatest(1, floor(n * 0.8)) - below)) / tied)
         / max(greatest(1, floor(n * 0.8))) AS retained_80
FROM r GROUP BY 1"""


@query("risk_at_80", "W6", "group_id:long retained_80:d", _RISK_SQL)
def _(spark, sf):
    scored = scores.scored_residuals(ad.residuals(spark, sf))
    return rk.expected_risk(scored, ["group_id"], "risk", "score", 0.8, "retained_80")


_AUC_SQL = f"""WITH {RESID_SQL}, g AS (
  SELECT group_id, score, count(*) AS m, avg(risk) AS mean_risk, sum(risk) AS s
  FROM v_score GROUP BY 1, 2),
p AS (SELECT *, coalesce(sum(m) OVER w, 0) AS n0, coalesce(sum(s) OVER w, 0) AS s0,
             sum(m) OVER (PARTITION BY group_id) AS total
      FROM g WINDOW w AS (PARTITION BY group_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT group_id, total, (s0 + j * mean_risk) / (n0 + j) AS v
      FROM (SELECT *, unnest(range(1, CAST(m AS BIGINT) + 1)) AS j FROM p))
SELECT group_id, sum(v) / max(total) AS auc FROM x GROUP BY 1"""


@query("risk_coverage_auc", "W7", "group_id:long auc:d", _AUC_SQL)
def _(spark, sf):
    scored = scores.scored_residuals(ad.residuals(spark, sf))
    return rk.risk_coverage_auc(scored, ["group_id"], "risk", "score")


@query(
    "longest_failure_run",
    "W8",
    "group_id:long longest:long",
    f"""WITH {RESID_SQL}, f AS (
  SELECT group_id, step, m2 > 6.25138863 AS fail,
         sum(CASE WHEN m2 > 6.25138863 THEN 0 ELSE 1 END) OVER (PARTITION BY group_id ORDER BY step) AS island
  FROM v_score), r AS (
  SELECT group_id, island, sum(CASE WHEN fail THEN 1 ELSE 0 END) AS len FROM f GROUP BY 1, 2)
SELECT group_id, max(len) AS longest FROM r GROUP BY 1""",
)
def _(spark, sf):
    scored = scores.scored_residuals(ad.residuals(spark, sf))
    flagged = scored.select("group_id", "step", (F.col("m2") > v3.CHI2_3[0.90]).alias("fail"))
    return rk.longest_run(flagged, ["group_id"], ["step"], "fail")


@query(
    "support_intervals",
    "W9",
    "group_id:long start:long stop:long length:long",
    f"""WITH {RESID_SQL}, f AS (SELECT DISTINCT group_id, frame FROM v_resid WHERE valid),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY group_id ORDER BY frame) AS island FROM f)
SELECT group_id, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS length FROM r GROUP BY group_id, island""",
)
def _(spark, sf):
    return rk.contiguous_intervals(ad.residuals(spark, sf).where("valid"), ["group_id"], "frame")


@query(
    "turn_intervals",
    "W9",
    "conv_id:long earliest:long latest:long longest:long intervals:long",
    """WITH f AS (SELECT DISTINCT conv_id, turn FROM conversations),
r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f),
i AS (SELECT conv_id, min(turn) AS start, max(turn) + 1 AS stop, count(*) AS length FROM r GROUP BY conv_id, island)
SELECT conv_id, min(start) AS earliest, max(stop) AS latest, max(length) AS longest, count(*) AS intervals FROM i GROUP BY 1""",
)
def _(spark, sf):
    turns = ad.read(spark, sf, "conversations")
    return rk.interval_summary(rk.contiguous_intervals(turns, ["conv_id"], "turn"), ["conv_id"])


@query(
    "error_summary",
    "A65",
    "trajectory_id:str n:long mean:d rmse:d median:d p90:d p95:d",
    f"""WITH {RESID_SQL} SELECT trajectory_id, count(*) AS n, avg(sqrt(sq)) AS mean, sqrt(avg(sq)) AS rmse,
  quantile_cont(sqrt(sq), 0.5) AS median, quantile_cont(sqrt(sq), 0.9) AS p90, quantile_cont(sqrt(sq), 0.95) AS p95
FROM v_score GROUP BY 1""",
)
def _(spark, sf):
    e = ad.residuals(spark, sf).select("trajectory_id", v3.norm(v3.vec("e")).alias("err"))
    return scores.error_summary(e, ["trajectory_id"], "err")


@query(
    "common_mode_quadrants",
    "A63",
    "group_id:long low_low:long low_high:long high_low:long high_high:long silent_mean_error:d silent_max_error:d",
    f"""WITH {RESID_SQL} SELECT group_id,
  sum(CASE WHEN score <= 1 AND risk <= 1 THEN 1 ELSE 0 END) AS low_low,
  sum(CASE WHEN score <= 1 AND risk > 1 THEN 1 ELSE 0 END) AS low_high,
  sum(CASE WHEN score > 1 AND risk <= 1 THEN 1 ELSE 0 END) AS high_low,
  sum(CASE WHEN score > 1 AND risk > 1 THEN 1 ELSE 0 END) AS high_high,
  avg(CASE WHEN score <= 1 AND risk > 1 THEN risk END) AS silent_mean_error,
  max(CASE WHEN score <= 1 AND risk > 1 THEN risk END) AS silent_max_error
FROM v_score GROUP BY 1""",
)
def _(spark, sf):
    scored = scores.scored_residuals(ad.residuals(spark, sf))
    return scores.common_mode_quadrants(scored, "score", "risk", 1.0, 1.0, ["group_id"])
