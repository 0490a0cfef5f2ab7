"""Queries over structured Gaussians, graphs, tracks, units, supports and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators import align, fusion, gauge_trees, gauges, gaussian, identity, joins, regress, support, tracks, transport, update_logs
from obsfuse.operators import disagreement as dis
from obsfuse.operators import project as pr
from obsfuse.plans import adapters as ad
from obsfuse.plans import pipelines
from obsfuse.plans.adapters import ARMS_SQL, EDGES_SQL, RESID_SQL, SAMPLES_SQL, TRACKS_SQL
from obsfuse.plans.registry import query
from obsfuse.runtime import durable, fresh_folder
from obsfuse.sources import tables
from obsfuse.streaming import admission, incremental

# --- structured Gaussians (rank one has a closed form) ----------------------------------


def _joint_rows(spark, sf):
    r = ad.residuals(spark, sf)
    return r.withColumn("factor", F.array(F.lit(0.5), F.col("target_norm") / 19.3, F.lit(-0.3)))


_STAT = f"""{RESID_SQL}, w AS (SELECT *, c / d2 AS ia, -b / d2 AS ib, a / d2 AS ic, 1.0 / e AS ie, 0.5 AS u1, target_norm / 19.3 AS u2, -0.3 AS u3 FROM v_score),
st AS (SELECT group_id, count(*) AS n, sum(m2) AS zz, sum(ln(det)) AS ld,
  sum((ia * u1 + ib * u2) * ex + (ib * u1 + ic * u2) * ey + ie * u3 * ez) AS wz,
  sum(ia * u1 * u1 + 2 * ib * u1 * u2 + ic * u2 * u2 + ie * u3 * u3) AS ww FROM w GROUP BY 1),
js AS (SELECT group_id, 3 * n AS dimension, zz - wz * wz / (1 + ww) AS m2, ld + ln(1 + ww) AS log_det, wz * wz / ww / (1 + ww) AS shared_energy,
  (zz - wz * wz / ww) / (3 * n - 1) AS conditional_energy FROM st),
jn AS (SELECT *, 0.5 * (dimension * {v3.LOG_2PI} + log_det + m2) AS nll FROM js)"""


@query(
    "joint_gaussian_groups",
    "A36",
    "group_id:long dimension:long m2:d log_det:d nll:d nees:d shared_energy:d conditional_energy:d",
    f"WITH {_STAT} SELECT *, m2 / dimension AS nees FROM jn",
)
def _(spark, sf):
    return gaussian.joint_scores(_joint_rows(spark, sf), ["group_id"], 1)


@query(
    "dependence_ablation",
    "A37",
    "group_id:long ablation:str nll_advantage:d nees_advantage:d",
    f"""WITH {_STAT}, mg AS (SELECT *, a + u1 * u1 AS a2, b + u1 * u2 AS b2, c + u2 * u2 AS c2, e + u3 * u3 AS e2, u1 * u3 AS g2, u2 * u3 AS h2 FROM w),
md AS (SELECT *, a2 * (c2 * e2 - h2 * h2) - b2 * (b2 * e2 - h2 * g2) + g2 * (b2 * h2 - c2 * g2) AS dt FROM mg),
mm AS (SELECT group_id, 3 * count(*) AS dim, sum(((c2 * e2 - h2 * h2) * ex * ex + (a2 * e2 - g2 * g2) * ey * ey + (a2 * c2 - b2 * b2) * ez * ez
   + 2 * ((g2 * h2 - b2 * e2) * ex * ey + (b2 * h2 - g2 * c2) * ex * ez + (b2 * g2 - a2 * h2) * ey * ez)) / dt) AS m2, sum(ln(dt)) AS ld FROM md GROUP BY 1),
ab AS (SELECT group_id, 'marginal' AS ablation, dim, m2, ld FROM mm UNION ALL SELECT group_id, 'conditional', 3 * n, zz, ld FROM st)
SELECT ab.group_id, ablation, (0.5 * (dim * {v3.LOG_2PI} + ab.ld + ab.m2) - nll) / dim AS nll_advantage, abs(ab.m2 / dim - 1) - abs(jn.m2 / dim - 1) AS nees_advantage
FROM ab JOIN jn ON ab.group_id = jn.group_id""",
)
def _(spark, sf):
    return gaussian.dependence_ablation(_joint_rows(spark, sf), "group_id", 1)


_SPECS = [("gaussian", 0.0, 1.0), ("mild", 0.05, 4.0), ("strong", 0.2, 9.0)]
_MIX = f"""{_STAT}, sp AS (SELECT * FROM (VALUES {', '.join(f"('{i}', CAST({p} AS DOUBLE), CAST({k} AS DOUBLE))" for i, p, k in _SPECS)}) t(spec_id, p, k)),
mx AS (SELECT group_id, dimension, spec_id, p, k, nll, 0.5 * (dimension * {v3.LOG_2PI} + log_det + dimension * ln(k) + m2 / k) AS inf FROM jn, sp),
my AS (SELECT *, CASE WHEN p = 0 THEN nll ELSE -(greatest(ln(1 - p) - nll, ln(p) - inf) + ln(1 + exp(-abs((ln(1 - p) - nll) - (ln(p) - inf))))) END AS mixture_nll FROM mx)"""
_MIX = _MIX.replace("ln(p) - inf", "ln(CASE WHEN p = 0 THEN 1 ELSE p END) - inf")


@query(
    "contaminated_mixture",
    "A38",
    "group_id:long spec_id:str mixture_nll:d posterior_contamination:d expected_precision:d",
    f"""WITH {_MIX}, pz AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE exp(ln(CASE WHEN p = 0 THEN 1 ELSE p END) - inf + mixture_nll) END AS posterior_contamination FROM my)
SELECT *, 1 - posterior_contamination + posterior_contamination / k AS expected_precision FROM pz""",
)
def _(spark, sf):
    return gaussian.mixture_scores(gaussian.joint_scores(_joint_rows(spark, sf), ["group_id"], 1), _SPECS)


_UNITS = f"{_MIX}, un AS (SELECT group_id % 10 AS unit_id, spec_id, max(p) AS contamination, max(k) AS inflation, sum(mixture_nll) / sum(dimension) AS value FROM my GROUP BY 1, 2)"


def _mixture_units(spark, sf):
    m = gaussian.mixture_scores(gaussian.joint_scores(_joint_rows(spark, sf), ["group_id"], 1), _SPECS)
    return m.groupBy((F.col("group_id") % 10).alias("unit_id"), "spec_id", "contamination", "inflation").agg(
        (F.sum("mixture_nll") / F.sum("dimension")).alias("value")
    )


@query(
    "mixture_folds",
    "A39",
    "unit_id:long spec_id:str selected:d advantage:d",
    f"""WITH {_UNITS}, r AS (SELECT *, (sum(value) OVER (PARTITION BY spec_id) - value) / (count(*) OVER (PARTITION BY spec_id) - 1) AS rest FROM un),
k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY rest > mn + 1e-12, contamination > 0, contamination, inflation, spec_id) AS i
      FROM (SELECT *, min(rest) OVER (PARTITION BY unit_id) AS mn FROM r))
SELECT k.unit_id, k.spec_id, k.value AS selected, g.value - k.value AS advantage FROM k JOIN un g ON g.unit_id = k.unit_id AND g.contamination = 0 WHERE i = 1""",
)
def _(spark, sf):
    return gaussian.select_mixture(_mixture_units(spark, sf))[0]


@query("mixture_decision", "A39", "units:long mean_advantage:d harmful_fraction:d agreement:d candidate:str accepted:bool selected:str")
def _(spark, sf):
    return gaussian.select_mixture(_mixture_units(spark, sf))[1]


@query(
    "covariance_localization",
    "A51",
    "groups:long nees_fraction:d shared_energy_fraction:d conditional_energy_fraction:d classification:str",
    f"""WITH {_STAT}, f AS (SELECT count(*) AS groups, avg(CASE WHEN m2 / dimension BETWEEN 0.5 AND 2 THEN 1.0 ELSE 0.0 END) AS nees_fraction,
  avg(CASE WHEN shared_energy BETWEEN 0 AND 5 THEN 1.0 ELSE 0.0 END) AS shared_energy_fraction, avg(CASE WHEN conditional_energy BETWEEN 0.5 AND 2 THEN 1.0 ELSE 0.0 END) AS conditional_energy_fraction FROM jn)
SELECT *, CASE WHEN groups < 2 THEN 'technical-failure' WHEN shared_energy_fraction < 0.8 THEN 'gauge-or-dependence-negative' WHEN conditional_energy_fraction < 0.8 THEN 'point-covariance-localized'
  WHEN nees_fraction < 0.8 THEN 'gauge-or-dependence-negative' ELSE 'covariance-adequate' END AS classification FROM f""",
)
def _(spark, sf):
    s = gaussian.joint_scores(_joint_rows(spark, sf), ["group_id"], 1)
    return gaussian.localize_failure(s, {"nees": (0.5, 2.0), "shared_energy": (0.0, 5.0), "conditional_energy": (0.5, 2.0)})


def _query_rows(spark, sf):
    return _joint_rows(spark, sf).withColumn(
        "jac", F.array(F.lit(1.0), F.lit(0.2), F.lit(0.0), F.lit(0.0), F.col("ex"), F.lit(1.0))
    )


_QC = f"""WITH {RESID_SQL}, q AS (SELECT group_id, count(*) AS n, sum(a + 0.4 * b + 0.04 * c) AS k00, sum(b * ex + 0.2 * c * ex) AS k01, sum(c * ex * ex + e) AS k11,
  sum(0.5 + 0.2 * target_norm / 19.3) AS s0, sum(ex * target_norm / 19.3 - 0.3) AS s1 FROM v_score GROUP BY 1)
SELECT group_id, n, k00 + s0 * s0 AS v00, k01 + s0 * s1 AS v01, k11 + s1 * s1 AS v11, (s0 * s0 + s1 * s1) / (k00 + k11 + s0 * s0 + s1 * s1) AS shared_fraction FROM q"""


@query("query_covariance", "A40 R8 X4", "group_id:long n:long v00:d5 v01:d5 v11:d5 shared_fraction:d", _QC)
def _(spark, sf):
    st = gaussian.query_statistics(_query_rows(spark, sf), ["group_id"], 2, 1)
    c = F.col("covariance")
    return gaussian.query_covariance(st, ["group_id"], 2, 1).withColumns({"v00": c[0], "v01": c[1], "v11": c[3]})


@query("query_distortion", "A43", "group_id:long trace_distortion:d frobenius_distortion:d min_ratio:d max_ratio:d preserved:bool")
def _(spark, sf):
    st = gaussian.query_statistics(_query_rows(spark, sf), ["group_id"], 2, 1)
    ref = gaussian.query_covariance(st, ["group_id"], 2, 1).select("group_id", F.col("covariance").alias("reference"))
    cand = st.select("group_id", F.col("conditional").alias("candidate"))
    limits = {"trace": 0.2, "frobenius": 0.2, "min_ratio": 0.8, "max_ratio": 1.25, "unsupported": 0.05}
    return gaussian.query_distortion(ref.join(cand, "group_id"), ["group_id"], 2, limits)


@query("condition_query", "A42", "group_id:long mean0:d cov0:d")
def _(spark, sf):
    rows = _joint_rows(spark, sf).withColumn("cross", F.array(F.lit(0.01), F.lit(0.0), F.lit(0.005)))
    prior = rows.select("group_id").distinct().withColumns({"mean": F.array(F.lit(0.0)), "cov": F.array(F.lit(100.0))})
    out = gaussian.condition_query(rows, ["group_id"], 1, 1, prior)
    return out.select("group_id", F.col("mean")[0].alias("mean0"), F.col("cov")[0].alias("cov0"))


@query("compress_factor", "A44", "group_id:long rank:long energy:d")
def _(spark, sf):
    rows = _joint_rows(spark, sf).withColumns(
        {
            "factor": F.array(F.lit(0.5), F.lit(0.25), F.col("target_norm") / 19.3, F.col("target_norm") / 40.0, F.lit(-0.3), F.lit(-0.15)),
            "jac": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)),
        }
    )
    out, info = gaussian.compress_factor(rows, 2, {"probe": ("jac", 1)}, {"probe": 1.0})
    e = F.aggregate("factor", F.lit(0.0), lambda acc, v: acc + v * v)
    return out.groupBy("group_id").agg(F.lit(info["rank"]).alias("rank"), F.sum(e).alias("energy"))


@query("bias_rank", "A52", "rank:long mean_nll:d groups:long")
def _(spark, sf):
    r = ad.residuals(spark, sf).withColumn("factor", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return gaussian.select_bias_rank(gaussian.bias_statistics(r, "group_id", 2), "group_id", 2)[0]


@query("bias_covariance", "A52", "baseline_nll:d best_nll:d selected_rank:long")
def _(spark, sf):
    r = ad.residuals(spark, sf).withColumn("factor", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return gaussian.select_bias_rank(gaussian.bias_statistics(r, "group_id", 2), "group_id", 2)[1]


@query("orthogonal_basis", "A53", "group_id:long before:d after:d")
def _(spark, sf):
    r = ad.residuals(spark, sf).withColumns(
        {"row_id": F.col("step"), "gauge": F.array(F.lit(1.0), F.col("ex"), F.col("ey")), "factor": F.array(F.lit(1.0), F.lit(0.2), F.col("target_norm") / 10.0)}
    )
    o = gaussian.orthogonalize_basis(r, ["group_id"], 1, 1)
    again = gaussian.sufficient_statistics(
        o.withColumn("factor", F.array(*[c for i in range(3) for c in (F.col("gauge")[i], F.col("factor")[i])])), ["group_id"], 2
    )
    before = o.groupBy("group_id").agg(F.max("projection_before").alias("before"))
    return again.join(before, "group_id").select("group_id", "before", F.abs(F.col("ww")[1] / F.sqrt(F.col("ww")[0] * F.col("ww")[3])).alias("after"))


# --- graphs -----------------------------------------------------------------------------------


@query(
    "triangle_cycles",
    "J8 A61",
    "a:long b:long c:long residual:d",
    f"""WITH {EDGES_SQL} SELECT d.reference AS a, f.moving AS b, d.moving AS c, f.log_scale + s.log_scale - d.log_scale AS residual
FROM v_edges d JOIN v_edges f ON f.reference = d.reference JOIN v_edges s ON s.reference = f.moving AND s.moving = d.moving WHERE f.moving <> d.moving""",
)
def _(spark, sf):
    c = joins.triangle_cycles(ad.edges(spark, sf).select("reference", "moving", "log_scale"))  # no more is read from a cycle
    return c.withColumn("residual", F.col("ab_log_scale") + F.col("bc_log_scale") - F.col("ac_log_scale"))


@query(
    "parent_edges",
    "T2",
    "moving_id:long reference_id:long n:long rms:d",
    f"""WITH {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY moving ORDER BY n DESC, rms, reference) AS k FROM v_edges)
SELECT moving AS moving_id, reference AS reference_id, n, rms FROM r WHERE k = 1""",
)
def _(spark, sf):
    e = ad.edges(spark, sf).withColumnsRenamed({"reference": "reference_id", "moving": "moving_id"})
    return gauges.parent_edges(e.withColumn("reference_position", F.col("reference_id")), [])


def _edges(spark, sf):
    s = ad.samples(spark, sf)
    windows = durable(s.select("case_id", "window_id", "frame").distinct())  # few: the samples are not read again for their windows
    pairs = joins.overlap_correspondences(s, cluster_size=4, windows=windows)
    fits = align.fit_whole_edges(pairs, ["case_id", "reference_id", "moving_id"])
    return s, pairs, durable(gauges.with_positions(fits, joins.window_order(windows)))


@query("robust_alignment", "A5 A6 F1 J1", "case_id:str reference_id:str moving_id:str scale:d tx:d ty:d tz:d rms:d inlier_fraction:d n:long clusters:long status:str")
def _(spark, sf):
    return _edges(spark, sf)[2]


@query("sequential_gauges", "G1 A10 F6", "case_id:str window_id:str position:long scale:d tx:d ty:d tz:d")
def _(spark, sf):
    return gauges.sequential_gauges(_edges(spark, sf)[2])


@query("gauge_tree", "G2 T2", "case_id:str window_id:str parent_id:str scale:d tx:d")
def _(spark, sf):
    return gauge_trees.tree_gauges(_edges(spark, sf)[2])


_TREE = f"""{EDGES_SQL}, e AS (SELECT *, exp(log_scale / 50) AS s, rms / 100.0 AS t, n * 1e-4 AS vs, (1 + n % 3) * 1e-3 AS vt FROM v_edges),
par AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY moving ORDER BY n DESC, rms, reference) AS k FROM e) WHERE k = 1),
node AS (SELECT reference AS w FROM e UNION SELECT moving FROM e),
g(w, parent, root, depth, s, t) AS (SELECT w, CAST(NULL AS BIGINT), w, 0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM node WHERE w NOT IN (SELECT moving FROM par)
  UNION ALL SELECT p.moving, p.reference, g.root, g.depth + 1, g.s * p.s, g.s * p.t + g.t FROM par p JOIN g ON p.reference = g.w),
a(w, e, up) AS (SELECT w, w, 0 FROM node UNION ALL SELECT a.w, p.reference, a.up + 1 FROM a JOIN par p ON p.moving = a.e)"""


def _number_edges(spark, sf):
    """The numbered graph as fitted edges: a scale, a shift along x, and a diagonal covariance."""
    e = ad.edges(spark, sf)
    turn = {c: F.lit(1.0 if c in {"r11", "r22", "r33"} else 0.0) for c in sim3.ROT}
    sizes = [F.col("n") * 1e-4, *[F.lit(1e-4)] * 3, *[(1 + F.col("n") % 3) * 1e-3] * 3]
    cov = F.array(*[sizes[i] if i == j else F.lit(0.0) for i in range(7) for j in range(7)])
    return e.select(
        F.lit("all").alias("case_id"), F.col("reference").alias("reference_id"), F.col("moving").alias("moving_id"), F.col("reference").alias("reference_position"),
        F.col("moving").alias("moving_position"), F.lit("ok").alias("status"), "n", "rms", F.exp(F.col("log_scale") / 50).alias("scale"),
        *[v.alias(c) for c, v in turn.items()], (F.col("rms") / 100.0).cast("double").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"), cov.alias("cov"),
    )


@query(
    "tree_composition", "G2 T2", "window_id:long parent_id:long root_id:long depth:long scale:d tx:d status:str",
    f"""WITH RECURSIVE {_TREE} SELECT w AS window_id, parent AS parent_id, root AS root_id, depth, s AS scale, t AS tx,
CASE WHEN root = (SELECT min(w) FROM node) THEN 'ok' WHEN depth = 0 THEN 'no-causal-overlap' ELSE 'detached' END AS status FROM g""",
)
def _(spark, sf):
    return gauge_trees.tree_gauges(_number_edges(spark, sf))


@query(
    "tree_covariances", "G2 F6", "window_id:long steps:long scale_variance:d8 x_variance:d8",
    f"""WITH RECURSIVE {_TREE} SELECT i.w AS window_id, max(a.up) AS steps, sum(CASE WHEN p.moving IS NULL THEN 1e-10 ELSE p.vs END) AS scale_variance,
sum(CASE WHEN p.moving IS NULL THEN 1e-10 * (1 + i.t * i.t) ELSE (i.t - o.t) * (i.t - o.t) * p.vs + u.s * u.s * p.vt END) AS x_variance
FROM a JOIN g i ON i.w = a.w JOIN g o ON o.w = a.e LEFT JOIN par p ON p.moving = a.e LEFT JOIN g u ON u.w = p.reference GROUP BY i.w""",
)
def _(spark, sf):
    tree = gauge_trees.tree_gauges(_number_edges(spark, sf))
    solved = gauge_trees.tree_covariances(tree, gauge_trees.ancestors(tree))
    return solved.select("window_id", F.col("depth").alias("steps"), F.col("cov")[0].alias("scale_variance"), F.col("cov")[32].alias("x_variance"))


@query(
    "tree_blocks", "G2 G8 A41", "window_i:long window_j:long scale_covariance:d8 x_covariance:d8",
    f"""WITH RECURSIVE {_TREE} SELECT v.reference AS window_i, v.moving AS window_j, sum(CASE WHEN p.moving IS NULL THEN 1e-10 ELSE p.vs END) AS scale_covariance,
sum(CASE WHEN p.moving IS NULL THEN 1e-10 * (1 + i.t * j.t) ELSE (i.t - o.t) * (j.t - o.t) * p.vs + u.s * u.s * p.vt END) AS x_covariance
FROM v_edges v JOIN g i ON i.w = v.reference JOIN g j ON j.w = v.moving JOIN a ON a.w = v.reference JOIN a b ON b.w = v.moving AND b.e = a.e
JOIN g o ON o.w = a.e LEFT JOIN par p ON p.moving = a.e LEFT JOIN g u ON u.w = p.reference GROUP BY v.reference, v.moving""",
)
def _(spark, sf):
    edges = _number_edges(spark, sf)
    tree = gauge_trees.tree_gauges(edges)
    paths = gauge_trees.ancestors(tree)
    solved = durable(gauge_trees.tree_covariances(tree, paths))
    pairs = edges.select("case_id", F.col("reference_id").alias("window_i"), F.col("moving_id").alias("window_j"))
    b = gauge_trees.tree_blocks(solved, paths, pairs)
    return b.select("window_i", "window_j", F.col("block")[0].alias("scale_covariance"), F.col("block")[32].alias("x_covariance"))


@query("gauge_graph", "G4", "case_id:str window_id:str scale:d tx:d")
def _(spark, sf):
    return gauges.joint_graph(_edges(spark, sf)[2])


@query("guarded_gauges", "G5 A61", "case_id:str window_id:str mode:str scale:d")
def _(spark, sf):
    return gauges.guarded_gauges(_edges(spark, sf)[2], 0.5)


@query("fixed_lag_gauges", "G3", "case_id:str window_id:str scale:d tx:d")
def _(spark, sf):
    return gauges.fixed_lag_gauges(_edges(spark, sf)[2], 4)


@query("cycle_audit", "A61 A62", "case_id:str a:str b:str c:str displacement:d rotation_error:d normalized_score:d")
def _(spark, sf):
    return gauges.cycle_audit(_edges(spark, sf)[2])


@query("gauge_errors", "A71", "windows:long log_scale_rmse:d rotation_rmse:d translation_rmse:d")
def _(spark, sf):
    _, _, e = _edges(spark, sf)
    g = gauges.sequential_gauges(e)
    truth = g.select("case_id", "window_id").withColumns(
        {**{c: F.lit(1.0 if c in {"scale", "r11", "r22", "r33"} else 0.0) for c in sim3.GAUGE_COLUMNS}}
    )
    k = F.lit(1.0) / (1 + F.substring("window_id", 2, 1).cast("double") * 0.1)
    return gauges.gauge_error_summary(gauges.gauge_errors(g, truth.withColumn("scale", k)))


@query("transform_inflation", "A74 A14 A72", "scale_inflation:d rotation_inflation:d translation_inflation:d")
def _(spark, sf):
    s, _, e = _edges(spark, sf)
    return pipelines.transform_calibration(s, ad.truth(spark, sf), e)["inflation"]


def _gauged(spark, sf):
    s, pairs, e = _edges(spark, sf)
    ev = dis.accumulate_disagreement(pairs, e.where("status = 'ok'"))
    return dis.with_rays(dis.point_variances(s, ev)), durable(gauges.sequential_gauges(e))


@query("window_fusion", "A9 P6 P10 P11", "case_id:str frame:long row:long col:long x:d5 y:d5 z:d5 c_xx:d c_zz:d contributors:long")
def _(spark, sf):
    s, g = _gauged(spark, sf)
    return fusion.fuse_windows(s, g, "covariance_intersection")


@query("cross_fitted_disagreement", "A2", "case_id:str reference_id:str moving_id:str candidate_folds:long fitted_folds:long skipped_folds:long")
def _(spark, sf):
    pairs = joins.overlap_correspondences(ad.samples(spark, sf), cluster_size=4)
    return dis.cross_fitted_disagreement(pairs)[1]


@query("observation_export", "C1 P12 P20 P2 F3 S6", "case_id:str frame:long entity_id:long window_index:long x:d4 y:d4 z:d4 prior_reliability:d")
def _(spark, sf):
    rows, _ = pipelines.export_observations(ad.samples(spark, sf), pipelines.ExportConfig(causal_stop=1_000_000, cluster_size=4))
    return rows


@query("provider_evaluation", "C2 A24 A27", "method_id:str metric:str mean:d groups:long")
def _(spark, sf):
    s = ad.samples(spark, sf).where("valid")
    key = ["case_id", "frame", "row", "col"]
    even = s.groupBy(*key).agg(*[F.avg(c).alias(c) for c in "xyz"]).withColumn("method_id", F.lit("mean"))
    low = s.groupBy(*key).agg(*[F.min(c).alias(c) for c in "xyz"]).withColumn("method_id", F.lit("low"))
    cases = s.select("case_id").distinct().select(
        "case_id", F.col("case_id").alias("group_id"), F.array(F.lit(3).cast("bigint")).alias("boundary_frames"), F.lit(4).cast("bigint").alias("prefix_frame_stop")
    )
    fused = even.unionByName(low).withColumn("valid", F.lit(True))
    return pipelines.evaluate_methods(fused, ad.truth(spark, sf), cases, "mean", resamples=200)["comparisons"]


@query("variance_ablation", "A70", "case_id:str variant:str rmse:d coverage_90:d points:long")
def _(spark, sf):
    s, pairs, e = _edges(spark, sf)
    ev = dis.accumulate_disagreement(pairs, e.where("status = 'ok'"))
    return pipelines.variance_ablation(s, ad.truth(spark, sf), ev, durable(gauges.sequential_gauges(e)))


# --- tracks and points ----------------------------------------------------------------------


def _sides(spark, sf):
    t = ad.tracks(spark, sf)
    return t.where("window_id = 'w0'"), t.where("window_id = 'w1'")


_CFG = tracks.AssociationConfig(
    distance=4.0, minimum_support=0.5, distance_scale=30.0, maximum_rms=60.0, minimum_score=0.01, minimum_margin=0.001, maximum_pairs=None
)
_PAIR_SQL = f"""{TRACKS_SQL}, g AS (SELECT DISTINCT l.track_id AS left_id, r.track_id AS right_id FROM v_tracks l JOIN v_tracks r ON l.frame = r.frame
  WHERE l.window_id = 'w0' AND r.window_id = 'w1' AND (l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2 <= 16)"""
_CAND_SQL = f"""{_PAIR_SQL}, j AS (SELECT left_id, right_id, (l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2 AS q, l.association_probability * r.association_probability AS w
  FROM g JOIN v_tracks l ON l.track_id = left_id JOIN v_tracks r ON r.track_id = right_id AND r.frame = l.frame),
cd AS (SELECT left_id, right_id, count(*) AS shared_frames, sum(w) AS support, sqrt(sum(w * q) / sum(w)) AS rms FROM j GROUP BY 1, 2),
sc AS (SELECT *, least(1, support / 0.5) * exp(-0.5 * (rms / 30.0) ** 2) AS score FROM cd)"""


@query("spatial_pairs", "J7", "left_id:long right_id:long", f"WITH {_PAIR_SQL} SELECT * FROM g")
def _(spark, sf):
    left, right = _sides(spark, sf)
    return tracks.gated_pairs(left, right, 4.0)


@query("link_candidates", "G7", "left_id:long right_id:long shared_frames:long support:d rms:d score:d", f"WITH {_CAND_SQL} SELECT * FROM sc")
def _(spark, sf):
    return tracks.candidate_scores(*_sides(spark, sf), _CFG)


@query(
    "mutual_best_links",
    "W3 G7",
    "left_id:long right_id:long score:d left_margin:d right_margin:d verdict:str",
    f"""WITH {_CAND_SQL}, u AS (SELECT * FROM sc WHERE shared_frames >= 2),
l AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, 0) AS left_margin FROM u WINDOW w AS (PARTITION BY left_id ORDER BY score DESC, rms, support DESC, right_id)),
r AS (SELECT *, row_number() OVER w AS k, score - coalesce(lead(score) OVER w, 0) AS right_margin FROM u WINDOW w AS (PARTITION BY right_id ORDER BY score DESC, rms, support DESC, left_id))
SELECT l.left_id, l.right_id, l.score, left_margin, right_margin, CASE WHEN r.left_id <> l.left_id THEN 'non-mutual' WHEN left_margin < 0.001 OR right_margin < 0.001 THEN 'ambiguous'
  WHEN l.support < 0.5 OR l.rms > 60 OR l.score < 0.01 THEN 'below-threshold' ELSE 'linked' END AS verdict
FROM l JOIN r ON r.right_id = l.right_id AND r.k = 1 WHERE l.k = 1""",
)
def _(spark, sf):
    return tracks.mutual_links(tracks.candidate_scores(*_sides(spark, sf), _CFG, best=True), _CFG)


def _points(df):
    return df.select("frame", F.col("track_id").alias("point_id"), "x", "y", "z")


_NEAR = f"""{TRACKS_SQL}, d AS (SELECT l.frame, l.track_id AS source_id, r.track_id AS target_id, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) AS distance
  FROM v_tracks l JOIN v_tracks r ON l.frame = r.frame WHERE l.window_id = '{{a}}' AND r.window_id = '{{b}}'),
n AS (SELECT frame, source_id, min(distance) AS distance, arg_min(target_id, (distance, target_id)) AS target_id FROM d GROUP BY 1, 2)"""


@query("nearest_points", "J10", "frame:long source_id:long target_id:long distance:d", f"WITH {_NEAR.format(a='w0', b='w1')} SELECT * FROM n")
def _(spark, sf):
    left, right = _sides(spark, sf)
    return tracks.nearest_points(_points(left), _points(right), ["frame"])


@query(
    "point_set_metrics",
    "A64 J10",
    "frame:long points:long forward_mean:d backward_mean:d symmetric_mean:d forward_p95:d coverage_0:d coverage_1:d",
    f"""WITH {_NEAR.format(a='w0', b='w1')},
db AS (SELECT l.frame, l.track_id AS source_id, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) AS distance
       FROM v_tracks l JOIN v_tracks r ON l.frame = r.frame WHERE l.window_id = 'w1' AND r.window_id = 'w0'),
nb AS (SELECT frame, source_id, min(distance) AS distance FROM db GROUP BY 1, 2),
f AS (SELECT frame, count(*) AS points, avg(distance) AS forward_mean, quantile_cont(distance, 0.95) AS forward_p95, avg(CASE WHEN distance <= 5 THEN 1.0 ELSE 0.0 END) AS coverage_0,
  avg(CASE WHEN distance <= 10 THEN 1.0 ELSE 0.0 END) AS coverage_1 FROM n GROUP BY 1), bk AS (SELECT frame, avg(distance) AS backward_mean FROM nb GROUP BY 1)
SELECT *, (forward_mean + backward_mean) / 2 AS symmetric_mean FROM f JOIN bk USING (frame)""",
)
def _(spark, sf):
    left, right = _sides(spark, sf)
    return tracks.point_set_metrics(_points(left), _points(right), ["frame"], (5.0, 10.0))


@query(
    "track_factors",
    "P21 P22",
    "window_id:str track_id:long frame:long frame_count:long cell_count:long composite_weight:d correlation_group_id:str",
    f"""WITH {TRACKS_SQL}, c AS (SELECT *, track_id % 40 // 10 AS cr, track_id % 30 // 10 AS cc FROM v_tracks)
SELECT window_id, track_id, frame, count(*) OVER (PARTITION BY window_id, frame) AS frame_count, count(*) OVER (PARTITION BY window_id, frame, cr, cc) AS cell_count,
  least(1, 16.0 / count(*) OVER (PARTITION BY window_id, frame)) AS composite_weight, concat_ws(':', frame, cr, cc) AS correlation_group_id FROM c""",
)
def _(spark, sf):
    t = ad.tracks(spark, sf).withColumns({"row": F.col("track_id") % 40, "col": F.col("track_id") % 30})
    return pr.track_factors(t, 16.0, (10, 10))


@query(
    "ensemble_covariance",
    "A67",
    "group_id:long frame:long members:long x:d c_xx:d c_xy:d c_zz:d",
    f"""WITH {RESID_SQL}, q AS (SELECT group_id, frame, count(*) AS members, avg(ex) AS x, var_samp(ex) AS a1, covar_samp(ex, ey) AS b1, var_samp(ey) AS c1, var_samp(ez) AS e1 FROM v_resid GROUP BY 1, 2 HAVING count(*) > 1)
SELECT group_id, frame, members, x, 0.8 * a1 + 0.2 * (a1 + c1 + e1) / 3 + 6.25e-8 AS c_xx, 0.8 * b1 AS c_xy, 0.8 * e1 + 0.2 * (a1 + c1 + e1) / 3 + 6.25e-8 AS c_zz FROM q""",
)
def _(spark, sf):
    r = ad.residuals(spark, sf).select("group_id", "frame", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"))
    return tracks.ensemble_covariance(r, ["group_id", "frame"])


_FLOW = "SELECT frame, ex AS tx, ey AS ty, ez AS tz, ex * 0.8 + 0.1 AS vx, ey * 0.9 AS vy, ez * 0.7 - 0.05 AS vz, ex * 0.5 AS px, ey * 0.6 + 0.2 AS py, ez * 0.9 AS pz FROM v_resid"


@query(
    "flow_mix",
    "A66",
    "method_id:str n:long mean_epe:d rmse:d visual_weight:d",
    f"""WITH {RESID_SQL}, s AS ({_FLOW}), k AS (SELECT avg((px - tx) ** 2 + (py - ty) ** 2 + (pz - tz) ** 2) / (avg((vx - tx) ** 2 + (vy - ty) ** 2 + (vz - tz) ** 2) + avg((px - tx) ** 2 + (py - ty) ** 2 + (pz - tz) ** 2)) AS wv FROM s WHERE frame < 19735),
e AS (SELECT s.*, wv FROM s, k WHERE frame >= 19735),
m AS (SELECT 'zero' AS method_id, wv, sqrt(tx * tx + ty * ty + tz * tz) AS e FROM e
 UNION ALL SELECT 'visual', wv, sqrt((vx - tx) ** 2 + (vy - ty) ** 2 + (vz - tz) ** 2) FROM e
 UNION ALL SELECT 'physics', wv, sqrt((px - tx) ** 2 + (py - ty) ** 2 + (pz - tz) ** 2) FROM e
 UNION ALL SELECT 'fixed_mix', wv, sqrt(((vx + px) / 2 - tx) ** 2 + ((vy + py) / 2 - ty) ** 2 + ((vz + pz) / 2 - tz) ** 2) FROM e
 UNION ALL SELECT 'calibrated_mix', wv, sqrt((wv * vx + (1 - wv) * px - tx) ** 2 + (wv * vy + (1 - wv) * py - ty) ** 2 + (wv * vz + (1 - wv) * pz - tz) ** 2) FROM e)
SELECT method_id, count(*) AS n, avg(e) AS mean_epe, sqrt(avg(e * e)) AS rmse, max(wv) AS visual_weight FROM m GROUP BY 1""",
)
def _(spark, sf):
    r = ad.residuals(spark, sf)
    s = r.select(
        "frame", *[F.col(f"e{c}").alias(f"t{c}") for c in "xyz"],
        (F.col("ex") * 0.8 + 0.1).alias("vx"), (F.col("ey") * 0.9).alias("vy"), (F.col("ez") * 0.7 - 0.05).alias("vz"),
        (F.col("ex") * 0.5).alias("px"), (F.col("ey") * 0.6 + 0.2).alias("py"), (F.col("ez") * 0.9).alias("pz"),
    )
    return tracks.flow_methods(s, 19735)


# --- identity hypotheses -----------------------------------------------------------------------

_IDH = f"""{TRACKS_SQL}, h AS (SELECT track_id AS target_id, frame AS candidate_id, (y - 50) / 30.0 AS log_weight, -x / 70.0 AS log_likelihood, x / 9.0 AS m0, y / 7.0 AS m1, 1 + z / 3.0 AS k00, 0.3 AS k01, 2 + z / 3.0 AS k11 FROM v_tracks),
z AS (SELECT *, log_weight - ln(sum(exp(log_weight)) OVER (PARTITION BY target_id)) + log_likelihood AS t FROM h),
lm AS (SELECT target_id, ln(sum(exp(t))) AS log_marginal FROM z GROUP BY 1),
po AS (SELECT z.*, log_marginal, exp(t - log_marginal) AS p FROM z JOIN lm USING (target_id))"""


def _hypotheses(spark, sf):
    return ad.tracks(spark, sf).select(
        F.col("track_id").alias("target_id"), F.col("frame").alias("candidate_id"), ((F.col("y") - 50) / 30.0).alias("log_weight"),
        (-F.col("x") / 70.0).alias("log_likelihood"), F.array(F.col("x") / 9.0, F.col("y") / 7.0).alias("mean"),
        F.array(1 + F.col("z") / 3.0, F.lit(0.3), F.lit(0.3), 2 + F.col("z") / 3.0).alias("cov"),
    )


@query(
    "identity_marginal",
    "A45 F4",
    "target_id:long candidates:long log_marginal:d entropy:d effective:d",
    f"WITH {_IDH}, s AS (SELECT target_id, count(*) AS candidates, max(log_marginal) AS log_marginal, -sum(p * ln(p)) AS entropy FROM po GROUP BY 1) SELECT *, exp(entropy) AS effective FROM s",
)
def _(spark, sf):
    return identity.identity_summary(identity.posterior(_hypotheses(spark, sf)))


@query(
    "moment_match",
    "A46",
    "target_id:long m0:d m1:d v00:d v01:d v11:d",
    f"""WITH {_IDH}, m AS (SELECT target_id, sum(p * m0) AS a0, sum(p * m1) AS a1 FROM po GROUP BY 1)
SELECT target_id, max(a0) AS m0, max(a1) AS m1, sum(p * k00) + sum(p * (m0 - a0) ** 2) AS v00, sum(p * k01) + sum(p * (m0 - a0) * (m1 - a1)) AS v01, sum(p * k11) + sum(p * (m1 - a1) ** 2) AS v11
FROM po JOIN m USING (target_id) GROUP BY 1""",
)
def _(spark, sf):
    m = identity.moment_match(identity.posterior(_hypotheses(spark, sf)), 2)
    c = F.col("covariance")
    return m.select("target_id", F.col("mean")[0].alias("m0"), F.col("mean")[1].alias("m1"), c[0].alias("v00"), c[1].alias("v01"), c[3].alias("v11"))


# --- units ---------------------------------------------------------------------------------------

_UNITS = """r AS (SELECT label AS unit_id, unnest(range(0, 64)) AS f, unnest(CAST(embedding[1:64] AS DOUBLE[])) AS v FROM embeddings),
q AS (SELECT unit_id, f, count(*) AS n, quantile_cont(v, 0.1) AS q0, quantile_cont(v, 0.5) AS q1, quantile_cont(v, 0.9) AS q2 FROM r GROUP BY 1, 2),
l AS (SELECT unit_id, 3 * f AS i, q0 AS v, n FROM q UNION ALL SELECT unit_id, 3 * f + 1, q1, n FROM q UNION ALL SELECT unit_id, 3 * f + 2, q2, n FROM q)"""
_EMB = f"""{_UNITS},
c AS (SELECT i, median(v) AS med, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, max(abs(v)) AS pk FROM l GROUP BY 1),
md AS (SELECT l.i, median(abs(v - med)) AS mad FROM l JOIN c ON l.i = c.i GROUP BY 1),
s AS (SELECT c.i, greatest(1.4826022185056018 * mad, (b - a) / 1.3489795003921634, 1e-6 + 1e-3 * greatest(abs(med), pk, 1)) AS scale FROM c JOIN md ON c.i = md.i),
d AS (SELECT t.unit_id, o.unit_id AS source_id, sqrt(avg(((t.v - o.v) / scale) ** 2)) AS distance FROM l t JOIN l o ON t.i = o.i JOIN s ON s.i = t.i WHERE t.unit_id <> o.unit_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY distance, source_id) AS rank FROM d)"""


def _embeddings(spark, sf):
    return durable(transport.unit_embeddings(ad.unit_rows(spark, sf), 64))


@query("nearest_units", "J9", "unit_id:long source_id:long distance:d rank:long", f"WITH {_EMB} SELECT * FROM k WHERE rank <= 3")
def _(spark, sf):
    e = _embeddings(spark, sf)
    return transport.nearest_units(e, e, transport.robust_scale(e), 3, exclude_self=True)


@query(
    "transport_support",
    "A54",
    "unit_id:long score:d",
    f"WITH {_EMB} SELECT unit_id, avg(distance) AS score FROM k WHERE rank <= 3 GROUP BY 1",
)
def _(spark, sf):
    return transport.fit_transport(_embeddings(spark, sf), 3)["scores"]


@query(
    "transport_evaluation", "A55", "unit_id:long score:d threshold:d p_value:d supported:bool distance_0:d outside_0:d",
    f"""WITH {_UNITS}, m AS (SELECT * FROM l WHERE unit_id % 3 <> 0),
c AS (SELECT i, median(v) AS med, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, max(abs(v)) AS pk, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1),
md AS (SELECT m.i, median(abs(v - med)) AS mad FROM m JOIN c ON m.i = c.i GROUP BY 1),
s AS (SELECT c.i, lo, hi, greatest(1.4826022185056018 * mad, (b - a) / 1.3489795003921634, 1e-6 + 1e-3 * greatest(abs(med), pk, 1)) AS scale FROM c JOIN md ON c.i = md.i),
z AS (SELECT t.unit_id, o.unit_id AS source_id, t.i, ((t.v - o.v) / scale) ** 2 AS z2 FROM l t JOIN m o ON t.i = o.i JOIN s ON s.i = t.i WHERE t.unit_id <> o.unit_id),
d AS (SELECT unit_id, source_id, sqrt(avg(z2)) AS distance, avg(z2) FILTER (i < 3) AS first_z FROM z GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY distance, source_id) AS rank FROM d),
sc AS (SELECT unit_id, avg(distance) AS score, sqrt(avg(first_z)) AS distance_0 FROM k WHERE rank <= 2 GROUP BY 1),
cal AS (SELECT score, row_number() OVER (ORDER BY score) AS o, count(*) OVER () AS n FROM sc WHERE unit_id % 3 <> 0),
th AS (SELECT score AS threshold FROM cal WHERE o = least(n, CAST(ceil((n + 1) * CAST(0.9 AS DOUBLE)) AS BIGINT))),
od AS (SELECT l.unit_id, max(greatest(lo - v, v - hi, 0) / scale) AS outside_0 FROM l JOIN s ON l.i = s.i WHERE l.i < 3 GROUP BY 1)
SELECT sc.unit_id, score, threshold, (1 + (SELECT count(*) FROM cal WHERE cal.score >= sc.score)) / CAST(1 + (SELECT count(*) FROM cal) AS DOUBLE) AS p_value,
score <= threshold AS supported, distance_0, outside_0 FROM sc JOIN od ON od.unit_id = sc.unit_id CROSS JOIN th WHERE sc.unit_id % 3 = 0""",
)
def _(spark, sf):
    e = _embeddings(spark, sf)
    model = transport.fit_transport(e.where("unit_id % 3 <> 0"), 2)
    return transport.evaluate_transport(e.where("unit_id % 3 = 0"), model, 2, 8, 3)


# --- regressions ----------------------------------------------------------------------------------


@query("logistic_reliability", "A47", "rows:long groups:long nominal_fraction:d log_loss:d brier:d converged:bool")
def _(spark, sf):
    return regress.fit_logistic(ad.labelled(spark, sf), 3)[1]


@query("choice_weights", "A48", "examples:long log_loss:d uniform_log_loss:d brier:d accuracy:d ece:d")
def _(spark, sf):
    t = ad.tracks(spark, sf)
    base = t.select(
        (F.col("track_id") % 12).alias("group_id"), F.concat_ws(":", F.col("track_id"), F.floor(F.col("frame") / 3)).alias("example_id"),
        F.col("frame").alias("candidate_id"), F.array(F.col("x") / 50.0, F.col("y") / 50.0).alias("features"), "x", "y",
    )
    best = base.groupBy("example_id").agg(F.min(F.struct("y", "candidate_id")).alias("b"), F.min("candidate_id").alias("first"))
    j = base.join(best, "example_id")
    rows = j.select(
        "group_id", "example_id", "candidate_id", "features",
        F.when(F.col("candidate_id") == F.col("first"), "null").otherwise("linked").alias("kind"),
        (F.col("candidate_id") == F.col("b.candidate_id")).alias("is_true"),
    )
    return regress.choice_report(regress.cross_fit_choice(rows, 2, 3))


def _axis_rows(spark, sf):
    r = ad.residuals(spark, sf)
    return r.select(
        "group_id", F.array(F.col("target_norm"), (F.col("step") % 13).cast("double")).alias("features"),
        F.col("ex").alias("e_ray"), F.col("ey").alias("e_tangent"), F.col("ez").alias("e_normal"),
    )


@query("variance_regression", "A49 A50", "group_id:long n:long candidate_nll:d5 baseline_nll:d candidate_coverage_90:d5 candidate_width:d5")
def _(spark, sf):
    rows = _axis_rows(spark, sf)
    model = regress.fit_variance_regression(rows.where("group_id % 2 = 0"), 2)
    return regress.variance_scores(rows.where("group_id % 2 = 1"), model.variances(), [F.lit(1.0)] * 3)


# --- supports ---------------------------------------------------------------------------------------


def _streams(spark, sf):
    t = ad.tracks(spark, sf)
    per = t.groupBy("window_id", "track_id").agg(
        F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.array_sort(F.collect_set("frame")).alias("available"),
        F.array_sort(F.collect_set(F.when(F.col("association_probability") > 0.3, F.col("frame")))).alias("geometry_supported"),
    )
    return per.select(
        (F.col("track_id") % 4).cast("string").alias("candidate_id"), (F.col("track_id") % 7).alias("group_id"), F.col("track_id").alias("stream_id"),
        F.col("lo").alias("causal_start"), (F.col("hi") + 1).alias("causal_stop"),
        F.sequence("lo", "hi", F.lit(3).cast("bigint")).alias("required"), "available", "geometry_supported", F.lit(0.4).alias("min_fraction"),
        *[F.lit(False).alias(f"{n}_required") for n in ("intrinsics", "extrinsics", "anchor")],
        *[F.lit(None).cast("string").alias(f"{n}_id") for n in ("intrinsics", "extrinsics", "anchor")],
        F.when(F.col("track_id") % 41 == 0, F.lit("camera-off")).alias("technical_failure_code"),
    )


_STR = f"""{TRACKS_SQL}, p AS (SELECT track_id, min(frame) AS lo, max(frame) AS hi, list(DISTINCT frame) AS av, list(DISTINCT frame) FILTER (association_probability > 0.3) AS ge FROM v_tracks GROUP BY 1),
rq AS (SELECT *, range(lo, hi + 1, 3) AS req FROM p),
ct AS (SELECT *, len(req) AS nr, len(list_intersect(req, av)) AS na, len(list_intersect(list_intersect(req, av), coalesce(ge, []))) AS ng, track_id % 41 = 0 AS fail FROM rq),
bu AS (SELECT track_id % 4 AS cand, sum(CASE WHEN fail THEN 1 ELSE 0 END) AS used FROM ct GROUP BY 1),
ev AS (SELECT ct.*, cand, used, fail AND used <= 2 AS excluded, NOT fail AND na = nr AND ng / nr >= 0.4 AS supported FROM ct JOIN bu ON cand = track_id % 4)"""


def _evaluated(spark, sf):
    return support.stream_support(_streams(spark, sf), ["camera-off"], 2, ["candidate_id"])


@query(
    "stream_support",
    "A56 J12",
    "stream_id:long required_count:long available_count:long supported_count:long geometry_fraction:d excluded:bool supported:bool",
    f"WITH {_STR} SELECT track_id AS stream_id, nr AS required_count, na AS available_count, ng AS supported_count, ng / nr AS geometry_fraction, excluded, supported FROM ev",
)
def _(spark, sf):
    return _evaluated(spark, sf)


@query(
    "design_ranking",
    "A57 A56",
    "candidate_id:str streams:long supported_streams:long evaluable:long support_fraction:d decision:str minimum_group_fraction:d position:long",
    f"""WITH {_STR}, gr AS (SELECT cand, track_id % 7 AS g, sum(CASE WHEN supported THEN 1 ELSE 0 END) AS s, sum(CASE WHEN excluded THEN 0 ELSE 1 END) AS e FROM ev GROUP BY 1, 2),
gm AS (SELECT cand, min(CASE WHEN e > 0 THEN s / e ELSE 0 END) AS mg, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS sg FROM gr GROUP BY 1),
f AS (SELECT cand, count(*) AS streams, sum(CASE WHEN supported THEN 1 ELSE 0 END) AS ss, sum(CASE WHEN excluded THEN 0 ELSE 1 END) AS evaluable, max(used) AS used,
  sum(CASE WHEN supported THEN nr ELSE 0 END) AS sf, sum(CASE WHEN excluded THEN 0 ELSE ng END) AS gf, max(hi + 1 - lo) AS ms, sum(hi + 1 - lo) AS ts FROM ev GROUP BY 1),
z AS (SELECT f.*, mg, sg, ss / evaluable AS frac, CASE WHEN used > 2 THEN 'technical-exclusion-budget-exceeded' WHEN evaluable = 0 THEN 'no-evaluable-streams' WHEN ss / evaluable < 0.2 THEN 'support-threshold-not-met' ELSE 'support-feasible' END AS decision FROM f JOIN gm USING (cand))
SELECT CAST(cand AS VARCHAR) AS candidate_id, streams, ss AS supported_streams, evaluable, frac AS support_fraction, decision, mg AS minimum_group_fraction,
  row_number() OVER (ORDER BY decision <> 'support-feasible', -mg, -sg, -sf, -gf, -ss, ms, ts, CAST(cand AS VARCHAR)) AS position FROM z""",
)
def _(spark, sf):
    return support.rank_designs(_evaluated(spark, sf), 0.2, 2)


@query(
    "camera_panel",
    "A58",
    "panel_id:str frame:long contributing:long spatial:long supported:bool",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT DISTINCT case_id, frame, window_id, "row" // 10 * 5 + col // 10 AS cell FROM v_samples WHERE valid),
v AS (SELECT case_id, frame, window_id, count(*) AS cells FROM c GROUP BY 1, 2, 3), f AS (SELECT case_id, frame, count(*) AS contributing, sum(CASE WHEN cells >= 18 THEN 1 ELSE 0 END) AS spatial FROM v GROUP BY 1, 2),
rq AS (SELECT DISTINCT case_id, frame FROM v_samples)
SELECT case_id AS panel_id, frame, coalesce(contributing, 0) AS contributing, coalesce(spatial, 0) AS spatial, coalesce(spatial, 0) >= 3 AS supported FROM rq LEFT JOIN f USING (case_id, frame)""",
)
def _(spark, sf):
    s = ad.samples(spark, sf)
    cells = s.where("valid").select(
        F.col("case_id").alias("panel_id"), "frame", F.col("window_id").alias("view_id"),
        (F.floor(F.col("row") / 10) * 5 + F.floor(F.col("col") / 10)).alias("cell_id"),
    )
    req = s.select(F.col("case_id").alias("panel_id"), "frame").distinct()
    return support.panel_support(cells, req, 4, 18, 3)


@query(
    "sliding_lineage",
    "P4 R10 P3",
    "sequence_id:long frame:long source_min:long source_max:long slices:long admissible:bool",
    """WITH s AS (SELECT user_id AS sequence_id, count(*) AS n FROM events GROUP BY 1),
k AS (SELECT sequence_id, n, unnest(range(0, CASE WHEN n <= 25 THEN 1 ELSE CAST(ceil((n - 25) / 17.0) AS BIGINT) + 1 END)) AS k FROM s),
w AS (SELECT sequence_id, k * 17 AS a, least(k * 17 + 25, n) AS b FROM k), f AS (SELECT *, unnest(range(a, b)) AS frame FROM w)
SELECT sequence_id, frame, min(a) AS source_min, max(b) - 1 AS source_max, count(*) AS slices, max(b) - 1 < 40 AS admissible FROM f GROUP BY 1, 2""",
)
def _(spark, sf):
    seq = ad.read(spark, sf, "events").groupBy(F.col("user_id").alias("sequence_id")).agg(F.count(F.lit(1)).alias("frames"))
    return pr.sliding_lineage(seq, 25, 8, 40)


@query(
    "held_out_split",
    "S8",
    "name:str family:str split:str",
)
def _(spark, sf):
    s = ad.read(spark, sf, "supplier").select(
        F.concat_ws("_", F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("position")
    )
    return tables.held_out_split(s)


@query(
    "content_digest",
    "S9",
    "l_returnflag:str rows:long hash_xor:long",
)
def _(spark, sf):
    return tables.content_digest(ad.read(spark, sf, "lineitem"), ["l_returnflag"])


@query(
    "batch_preflight",
    "S10",
    "reference_payload_id:str payload_id:str code:str expected:str observed:str",
    """WITH p AS (SELECT 'p' || CAST(o_custkey AS VARCHAR) AS id, o_custkey AS pos, count(*) AS frames, max(CASE WHEN o_custkey % 5 = 0 THEN 4 ELSE 3 END) AS h FROM orders GROUP BY o_custkey),
r AS (SELECT * FROM p ORDER BY pos LIMIT 1)
SELECT r.id AS reference_payload_id, p.id AS payload_id, 'frame-count-mismatch' AS code, CAST(r.frames AS VARCHAR) AS expected, CAST(p.frames AS VARCHAR) AS observed FROM p, r WHERE p.id <> r.id AND p.frames <> r.frames
UNION ALL SELECT r.id, p.id, 'spatial-shape-mismatch', r.h || 'x2', p.h || 'x2' FROM p, r WHERE p.id <> r.id AND p.h <> r.h""",
)
def _(spark, sf):
    p = ad.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("frame_count"))
    p = p.select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("payload_id"), F.col("o_custkey").alias("position"), F.lit(0).alias("source_stop"),
        "frame_count", F.when(F.col("o_custkey") % 5 == 0, 4).otherwise(3).alias("height"), F.lit(2).alias("width"), F.lit("float32").alias("dtype"),
        F.array(F.lit("flow")).alias("optional_fields"),
    )
    return tables.batch_preflight(p)


@query(
    "difference_sidecar",
    "J13 J14 U2",
    "conv_id:long turn:long reason:str",
    """WITH l AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant')
SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn) AS turn, CASE WHEN r.conv_id IS NULL THEN 'missing_right' ELSE 'missing_left' END AS reason
FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn WHERE l.conv_id IS NULL OR r.conv_id IS NULL""",
)
def _(spark, sf):
    c = ad.read(spark, sf, "conversations")
    left = c.where("role = 'user'").select("conv_id", "turn")
    right = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return joins.sidecar_mismatches(left, right, ["conv_id", "turn"])


@query(
    "persistent_identities",
    "J11",
    "case_id:str row:long col:long window_id:str frame:long",
    f"""WITH {SAMPLES_SQL}, k AS (SELECT case_id, "row", col FROM v_samples GROUP BY 1, 2, 3 HAVING count(DISTINCT window_id) = (SELECT count(DISTINCT window_id) FROM v_samples))
SELECT s.case_id, s."row", s.col, s.window_id, s.frame FROM v_samples s SEMI JOIN k USING (case_id, "row", col)""",
)
def _(spark, sf):
    return joins.persistent_identities(ad.samples(spark, sf), ["case_id", "row", "col"], "window_id", [])


# --- streams ---------------------------------------------------------------------------------------


def _stream(spark, sf, table):
    """A table as a stream, whether it is one file or a folder of files; a stream takes a single file only by a pattern."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def _event_stream(spark, sf):
    return _stream(spark, sf, "events")


def _sink(spark, name):
    return fresh_folder(spark, f"stream-{name}")


@query(
    "stream_window_counts",
    "R10",
    "start:long event_type:str n:long total:d4",
    """WITH w AS (SELECT event_type, value, unnest(range(epoch_us(ts) // 86400000000 - 2, epoch_us(ts) // 86400000000 + 1)) AS start FROM events)
SELECT start, event_type, count(*) AS n, sum(value) AS total FROM w GROUP BY 1, 2""",
)
def _(spark, sf):
    s = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = incremental.overlapping_windows(s, "3 days", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")])
    out = _sink(spark, "windows")
    incremental.run_updates(agg, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/t"), f"{out}/c", "complete")
    return spark.read.parquet(f"{out}/t").withColumn("start", F.floor(F.unix_micros("window.start") / F.lit(86_400_000_000)))


@query("stream_query_projection", "R8 A40", "group_id:long n:long v00:d5 v01:d5 v11:d5 shared_fraction:d", _QC)
def _(spark, sf):
    stream = _event_stream(spark, sf)
    rows = ad.residual_columns(stream).withColumns(
        {
            "factor": F.array(F.lit(0.5), F.col("target_norm") / 19.3, F.lit(-0.3)),
            "jac": F.array(F.lit(1.0), F.lit(0.2), F.lit(0.0), F.lit(0.0), F.col("ex"), F.lit(1.0)),
        }
    )
    out = _sink(spark, "projection")
    st = incremental.query_projection(rows, ["group_id"], 2, 1)
    incremental.run_updates(st, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/t"), f"{out}/c", "complete")
    c = F.col("covariance")
    done = gaussian.query_covariance(spark.read.parquet(f"{out}/t"), ["group_id"], 2, 1)
    return done.withColumns({"v00": c[0], "v01": c[1], "v11": c[3]})


_DIAG9 = "group_id:long n:long coverage_90:d mean_m2:d gaussian_nll:d mean_trace:d"


@query(
    "stream_scorecard",
    "R9 A18",
    _DIAG9,
    f"""WITH {RESID_SQL} SELECT group_id, count(*) AS n, avg(CASE WHEN m2 <= 6.25138863 THEN 1.0 ELSE 0.0 END) AS coverage_90, avg(m2) AS mean_m2,
 avg(0.5 * (3 * {v3.LOG_2PI} + ln(det) + m2)) AS gaussian_nll, avg(a + c + e) AS mean_trace FROM v_score GROUP BY 1""",
)
def _(spark, sf):
    out = _sink(spark, "scorecard")
    agg = incremental.incremental_scorecard(ad.residual_columns(_event_stream(spark, sf)), ["group_id"])
    incremental.run_updates(agg, lambda b, e: b.write.mode("overwrite").parquet(f"{out}/t"), f"{out}/c", "complete")
    return spark.read.parquet(f"{out}/t")


def _updates(spark, sf):
    """One update log per conversation: turns as intervals, with gaps and repeats."""
    c = ad.read(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("stream_id"), F.concat_ws(":", "conv_id", "turn").alias("update_id"),
        F.when(F.length("text") % 7 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("start"), (F.col("turn") + 1 + F.when(F.length("text") % 7 == 0, 1).otherwise(0)).alias("stop"),
        F.lit("v1").alias("identity"), F.sha2("text", 256).alias("content_hash"), F.length("text").cast("bigint").alias("rows"),
    )


_ADMIT = """WITH RECURSIVE u AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, concat_ws(':', conv_id, turn) AS update_id,
   turn + CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS start, turn + 1 + CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS stop FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start, stop, update_id) AS i FROM u),
w AS (SELECT o.*, true AS admitted, CAST(NULL AS VARCHAR) AS reason, stop AS last FROM o WHERE i = 1
  UNION ALL SELECT o.*, o.start = w.last, CASE WHEN o.start < w.last THEN 'reopened-interval' WHEN o.start > w.last THEN 'gap' END, CASE WHEN o.start = w.last THEN o.stop ELSE w.last END
  FROM w JOIN o ON o.stream_id = w.stream_id AND o.i = w.i + 1)
SELECT stream_id, update_id, start, stop, admitted, reason FROM w"""
_ADMIT_SIG = "stream_id:str update_id:str start:long stop:long admitted:bool reason:str"


@query("batch_admission", "R1", _ADMIT_SIG, _ADMIT)
def _(spark, sf):
    return update_logs.admit_log(_updates(spark, sf))


@query("stream_admission", "R1", _ADMIT_SIG, _ADMIT)
def _(spark, sf):
    stream = _stream(spark, sf, "conversations")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(
        F.col("conv_id").cast("string").alias("stream_id"), F.concat_ws(":", "conv_id", "turn").alias("update_id"),
        F.when(F.length("text") % 7 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("start"), (F.col("turn") + 1 + F.when(F.length("text") % 7 == 0, 1).otherwise(0)).alias("stop"),
        F.lit("v1").alias("identity"), F.sha2("text", 256).alias("content_hash"), F.length("text").cast("bigint").alias("rows"),
    )
    out = _sink(spark, "admission")
    incremental.run_available(admission.admit_stream(rows), f"{out}/t")
    return spark.read.parquet(f"{out}/t")


def _bindings(df, bias: bool):
    """Factor or bias updates from events; one in nine bias updates disagrees."""
    base = df.select(
        F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").cast("string").alias("eid"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("stop"), (F.col("event_id") % 50).alias("rows"), F.col("event_type").alias("identity"), "event_id",
    )
    if not bias:
        return base.select("stream_id", F.col("eid").alias("update_id"), "ts", F.col("event_id").alias("update_index"), "start", "stop", "rows", "identity")
    return base.select(
        "stream_id", F.concat(F.lit("b"), "eid").alias("update_id"), F.col("eid").alias("observation_update_id"), "ts", F.col("event_id").alias("update_index"), "start",
        F.when(F.col("event_id") % 9 == 0, F.col("stop") + 1).otherwise(F.col("stop")).alias("stop"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("rows")).alias("rows"), "identity",
    )


_BIND = """SELECT CAST(user_id AS VARCHAR) AS stream_id, CAST(event_id AS VARCHAR) AS update_id, 'b' || CAST(event_id AS VARCHAR) AS bias_update_id,
 CASE WHEN event_id % 9 = 0 THEN 'interval-differs' WHEN event_id % 11 = 0 AND event_id % 50 <> 0 THEN 'row-count-differs' END AS reason FROM events"""


@query("stream_binding", "R6 J13", "stream_id:str update_id:str bias_update_id:str reason:str", _BIND)
def _(spark, sf):
    f, b = _bindings(_event_stream(spark, sf), False), _bindings(_event_stream(spark, sf), True)
    out = _sink(spark, "binding")
    incremental.run_available(incremental.bind_streams(f, b), f"{out}/t")
    return spark.read.parquet(f"{out}/t")


@query("complete_binding", "R6 J13", "stream_id:str update_id:str bias_update_id:str reason:str", _BIND)
def _(spark, sf):
    e = ad.read(spark, sf, "events")
    return incremental.bind_complete(_bindings(e, False), _bindings(e, True))


@query(
    "bias_admission",
    "R5",
    "stream_id:str update_id:str admitted:bool reason:str row_start:long row_stop:long",
    """WITH RECURSIVE u AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, concat_ws(':', conv_id, turn) AS update_id, coalesce(length(text), 0) AS size,
   turn + CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS start, turn + 1 + CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS stop FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start, stop, update_id) AS i FROM u),
w AS (SELECT o.*, true AS admitted, stop AS last, size AS total FROM o WHERE i = 1
  UNION ALL SELECT o.*, o.start >= w.last, CASE WHEN o.start >= w.last THEN o.stop ELSE w.last END, w.total + CASE WHEN o.start >= w.last THEN o.size ELSE 0 END
  FROM w JOIN o ON o.stream_id = w.stream_id AND o.i = w.i + 1)
SELECT stream_id, update_id, admitted, CASE WHEN NOT admitted THEN 'overlaps-retained' END AS reason,
  CASE WHEN admitted THEN total - size END AS row_start, CASE WHEN admitted THEN total END AS row_stop FROM w""",
)
def _(spark, sf):
    return update_logs.admit_log(_updates(spark, sf), "bias")


@query(
    "decision_ledger",
    "R7",
    "groups:long accepted:long fallback:long exact_fallback:long",
    f"""WITH {ARMS_SQL}, d AS (SELECT group_id, sum(correct) % 3 = 0 AS accepted, true AS exact_fallback FROM v_arms GROUP BY 1)
SELECT count(*) AS groups, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS fallback, sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS exact_fallback FROM d""",
)
def _(spark, sf):
    d = ad.arms(spark, sf).groupBy("group_id").agg((F.sum("correct") % 3 == 0).alias("accepted")).withColumn("exact_fallback", F.lit(True))
    return incremental.ledger_summary(d)

