"""Queries over duplicate estimates and dense samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3
from obsfuse.operators import disagreement as dis
from obsfuse.operators import fusion, joins, scores
from obsfuse.operators import project as pr
from obsfuse.operators import ranking as rk
from obsfuse.plans import adapters as ad
from obsfuse.plans.adapters import EST_SQL, SAMPLES_SQL, TRUTH_SQL
from obsfuse.plans.registry import query
from obsfuse.runtime import durable, placed

_FUSED = "cell:long x:d y:d z:d c_xx:d c_xy:d c_yy:d c_zz:d contributors:long"


@query(
    "fuse_uniform",
    "A3",
    _FUSED,
    f"""WITH {EST_SQL} SELECT cell, avg(x) AS x, avg(y) AS y, avg(z) AS z,
  avg(a) + coalesce(var_pop(x), 0) AS c_xx, avg(b) + covar_pop(x, y) AS c_xy,
  avg(c) + coalesce(var_pop(y), 0) AS c_yy, avg(e) + coalesce(var_pop(z), 0) AS c_zz, count(*) AS contributors
FROM v_est GROUP BY 1""",
)
def _(spark, sf):
    return fusion.fuse_uniform(ad.estimates(spark, sf), ["cell"])


_PREC = """SELECT cell, contributors, 1.0 / ize AS c_zz, sz / ize AS z,
  ic / (ia * ic - ib * ib) AS c_xx, -ib / (ia * ic - ib * ib) AS c_xy, ia / (ia * ic - ib * ib) AS c_yy,
  (ic * sx - ib * sy) / (ia * ic - ib * ib) AS x, (ia * sy - ib * sx) / (ia * ic - ib * ib) AS y FROM ({0})"""


@query(
    "fuse_precision",
    "A4 F2",
    _FUSED,
    f"WITH {EST_SQL}, i AS (SELECT *, c / (a * c - b * b) AS pa, -b / (a * c - b * b) AS pb, a / (a * c - b * b) AS pc, 1.0 / e AS pe FROM v_est) "
    + _PREC.format(
        "SELECT cell, count(*) AS contributors, sum(pa) AS ia, sum(pb) AS ib, sum(pc) AS ic, sum(pe) AS ize, "
        "sum(pa * x + pb * y) AS sx, sum(pb * x + pc * y) AS sy, sum(pe * z) AS sz FROM i GROUP BY 1"
    ),
)
def _(spark, sf):
    return fusion.fuse_precision(ad.estimates(spark, sf), ["cell"])


_GRID = ", ".join(f"({i}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(fusion.ci_weight_grid()))
_I = "SELECT *, c / (a * c - b * b) AS pa, -b / (a * c - b * b) AS pb, a / (a * c - b * b) AS pc, 1.0 / e AS pe FROM v_est"
_PAIRS = f"""{EST_SQL}, i AS ({_I}),
n AS (SELECT cell FROM v_est GROUP BY 1 HAVING count(*) = 2),
p AS (SELECT f.cell, f.contributor AS c1, s.contributor AS c2,
             f.x AS x1, f.y AS y1, f.z AS z1, f.pa AS a1, f.pb AS b1, f.pc AS d1, f.pe AS e1,
             s.x AS x2, s.y AS y2, s.z AS z2, s.pa AS a2, s.pb AS b2, s.pc AS d2, s.pe AS e2
      FROM n JOIN i f ON f.cell = n.cell JOIN i s ON s.cell = n.cell AND f.contributor < s.contributor),
g AS (SELECT * FROM (VALUES {_GRID}) t(visit, w)),
sc AS (SELECT p.*, visit, w,
    -ln(((w * a1 + (1 - w) * a2) * (w * d1 + (1 - w) * d2) - (w * b1 + (1 - w) * b2) ** 2) * (w * e1 + (1 - w) * e2)) AS score
  FROM p, g)"""


def _apply(weights: str) -> str:
    mix = "SELECT cell, 2 AS contributors, w, w * a1 + (1 - w) * a2 AS ia, w * b1 + (1 - w) * b2 AS ib, w * d1 + (1 - w) * d2 AS ic, w * e1 + (1 - w) * e2 AS ize, " \
        "w * (a1 * x1 + b1 * y1) + (1 - w) * (a2 * x2 + b2 * y2) AS sx, w * (b1 * x1 + d1 * y1) + (1 - w) * (b2 * x2 + d2 * y2) AS sy, " \
        f"w * e1 * z1 + (1 - w) * e2 * z2 AS sz FROM ({weights})"
    return _PREC.format(mix).replace("SELECT cell, contributors,", "SELECT cell, contributors, w,", 1)


@query(
    "fuse_ci_pointwise",
    "A7",
    _FUSED + " w:d",
    f"WITH {_PAIRS}, best AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(score, 10), visit) AS k FROM sc) "
    + _apply("SELECT * FROM best WHERE k = 1"),
)
def _(spark, sf):
    return fusion.fuse_ci_pointwise(ad.estimates(spark, sf), ["cell"])


@query(
    "fuse_ci_pair",
    "A7 W13",
    "cell:long contributors:long w:d x:d y:d z:d c_xx:d c_xy:d c_yy:d c_zz:d",
    f"""WITH {_PAIRS},
m AS (SELECT c1, c2, visit, w, avg(score) AS s FROM sc GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY s, visit) AS k FROM m) """
    + _apply("SELECT p.*, b.w FROM p JOIN b ON p.c1 = b.c1 AND p.c2 = b.c2 AND b.k = 1"),
)
def _(spark, sf):
    est = ad.estimates(spark, sf)
    pairs = est.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("cell")
    out = fusion.fuse_covariance_intersection(est.join(pairs, "cell", "left_semi"), ["cell"], [])
    return out.withColumn("w", F.col("weights")[0])


@query("fuse_ci_all", "A8 A7", "cell:long x:d y:d z:d c_xx:d c_xy:d c_yy:d c_zz:d contributors:long")
def _(spark, sf):
    est = ad.estimates(spark, sf)
    return fusion.fuse_covariance_intersection(est, ["cell"], [])


_CORR = f"""WITH {SAMPLES_SQL}, p AS (
  SELECT a.case_id, a.frame, a."row", a.col, a.window_id AS reference_id, b.window_id AS moving_id,
         a.x AS px, a.y AS py, a.z AS pz, b.x AS sx, b.y AS sy, b.z AS sz
  FROM v_samples a JOIN v_samples b USING (case_id, frame, "row", col)
  WHERE a.valid AND b.valid AND a.window_id < b.window_id)"""


@query(
    "overlap_correspondences",
    "J1 P1",
    "case_id:str reference_id:str moving_id:str frame:long row:long col:long cluster:long px:d py:d pz:d sx:d sy:d sz:d",
    _CORR + ' SELECT *, frame * 4294967296 + ("row" // 8) * 65536 + col // 8 AS cluster FROM p',
)
def _(spark, sf):
    return joins.overlap_correspondences(ad.samples(spark, sf), cluster_size=8)


@query(
    "all_edges",
    "J2 U1",
    "case_id:str reference_id:str moving_id:str common_frames:long",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT DISTINCT case_id, window_id, frame FROM v_samples)
SELECT a.case_id, a.window_id AS reference_id, b.window_id AS moving_id, count(*) AS common_frames
FROM f a JOIN f b ON a.case_id = b.case_id AND a.frame = b.frame AND a.window_id < b.window_id GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return joins.all_edges(ad.samples(spark, sf))


_DIS = (
    _CORR
    + """, u AS (SELECT *, px - sx AS ex, py - sy AS ey, pz - sz AS ez,
    sqrt(px * px + py * py + pz * pz) AS nt, sqrt(sx * sx + sy * sy + sz * sz) AS ns FROM p),
r AS (SELECT *, px / nt + sx / ns AS qx, py / nt + sy / ns AS qy, pz / nt + sz / ns AS qz FROM u),
s AS (SELECT *, ((ex * qx + ey * qy + ez * qz) ** 2) / (qx * qx + qy * qy + qz * qz) AS par FROM r),
t AS (SELECT *, 0.5 * greatest(ex * ex + ey * ey + ez * ez - par, 0) AS lat FROM s),
b AS (SELECT case_id, reference_id AS window_id, frame, "row", col, par, lat FROM t
      UNION ALL SELECT case_id, moving_id, frame, "row", col, par, lat FROM t),
v_evidence AS (SELECT case_id, window_id, frame, "row", col, sum(par) AS par_sum, sum(lat) AS lat_sum, count(*) AS "overlaps"
               FROM b GROUP BY 1, 2, 3, 4, 5)"""
)


def _identity_edges(spark, sf):
    pairs = joins.all_edges(durable(ad.window_frames(spark, sf)))
    return pairs.select(
        "case_id", "reference_id", "moving_id", F.lit(1.0).alias("scale"),
        *[F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)],
        *[F.lit(0.0).alias(c) for c in ("tx", "ty", "tz")],
    )


@query(
    "overlap_disagreement",
    "A1 P7",
    "case_id:str window_id:str frame:long row:long col:long par_sum:d lat_sum:d overlaps:long",
    _DIS + " SELECT * FROM v_evidence",
)
def _(spark, sf):
    pairs = joins.overlap_correspondences(ad.samples(spark, sf), windows=ad.window_frames(spark, sf))
    return dis.accumulate_disagreement(pairs, _identity_edges(spark, sf))


_VAR = _DIS + """, v AS (
  SELECT s.*, coalesce(par_sum / "overlaps", 0) AS par_mean, coalesce(lat_sum / "overlaps", 0) AS lat_mean,
         coalesce("overlaps", 0) AS "overlaps"
  FROM v_samples s LEFT JOIN v_evidence USING (case_id, window_id, frame, "row", col)),
w AS (SELECT *, 2.5e-4 + 2.5e-5 * (x * x + y * y + z * z) + 0.25 * par_mean AS var_par,
             2.5e-4 + 2.5e-5 * (x * x + y * y + z * z) + 0.25 * lat_mean AS var_lat FROM v)"""


def _variances(spark, sf):
    s = ad.samples(spark, sf)
    pairs = joins.overlap_correspondences(s, windows=ad.window_frames(spark, sf))
    return dis.point_variances(s, dis.accumulate_disagreement(pairs, _identity_edges(spark, sf)))


@query(
    "point_variances",
    "P8 P13 P10",
    "case_id:str window_id:str frame:long row:long col:long var_par:d var_lat:d c_xx:d c_xy:d c_zz:d reliability:d",
    _VAR + """ SELECT *, var_lat + (var_par - var_lat) * x * x / (x * x + y * y + z * z) AS c_xx,
  (var_par - var_lat) * x * y / (x * x + y * y + z * z) AS c_xy,
  var_lat + (var_par - var_lat) * z * z / (x * x + y * y + z * z) AS c_zz,
  CASE WHEN "overlaps" > 0 THEN least(greatest(exp(-0.5 * least(par_mean / var_par + lat_mean / var_lat, 50)), 0.05), 1) ELSE 1 END AS reliability
FROM w""",
)
def _(spark, sf):
    v = dis.prior_reliability(dis.with_rays(_variances(spark, sf)), 0.05, "reliability")
    c = v3.structured(F.col("var_par"), F.col("var_lat"), v3.vec("r"))
    return v.select("*", *v3.named_sym(c))


@query(
    "reliability_features",
    "P14 W2",
    "case_id:str window_id:str frame:long row:long col:long has_overlap:d log_disagreement:d temporal_edge:d log_relative_variance:d has_flow:d validity_deficit:d",
    _VAR + """, k AS (SELECT *, var_par + 2 * var_lat AS tot FROM w WHERE valid),
md AS (SELECT case_id, window_id, median(tot) AS m FROM k GROUP BY 1, 2),
fr AS (SELECT case_id, window_id, frame, row_number() OVER (PARTITION BY case_id, window_id ORDER BY frame) - 1 AS i,
              count(*) OVER (PARTITION BY case_id, window_id) AS t
       FROM (SELECT DISTINCT case_id, window_id, frame FROM v_samples)),
nb AS (SELECT a.case_id, a.window_id, a.frame, a."row", a.col, count(*) AS n FROM k a JOIN k b
       ON a.case_id = b.case_id AND a.window_id = b.window_id AND a.frame = b.frame
       AND b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3, 4, 5)
SELECT k.case_id, k.window_id, k.frame, k."row", k.col,
  CASE WHEN "overlaps" > 0 THEN 1.0 ELSE 0.0 END AS has_overlap,
  CASE WHEN "overlaps" > 0 THEN ln(1 + par_mean / var_par + lat_mean / var_lat) ELSE 0.0 END AS log_disagreement,
  CASE WHEN t = 1 THEN 1.0 ELSE 1.0 - least(i, t - 1 - i) / greatest((t - 1) / 2.0, 1.0) END AS temporal_edge,
  ln(tot / m) AS log_relative_variance, 0.0 AS has_flow, 1.0 - nb.n / 9.0 AS validity_deficit
FROM k JOIN md USING (case_id, window_id) JOIN fr USING (case_id, window_id, frame)
JOIN nb USING (case_id, window_id, frame, "row", col)""",
)
def _(spark, sf):
    v = _variances(spark, sf).select("case_id", "window_id", "frame", "row", "col", "valid", "var_par", "var_lat", "par_mean", "lat_mean", "overlaps")
    return dis.reliability_features(v, ad.window_frames(spark, sf))


@query(
    "tile_argmax",
    "W4",
    "case_id:str window_id:str frame:long row:long col:long score:d",
    _VAR + """, k AS (SELECT *, sqrt(x * x + y * y + z * z) AS depth, var_par + 2 * var_lat AS tot,
   CASE WHEN "overlaps" > 0 THEN least(greatest(exp(-0.5 * least(par_mean / var_par + lat_mean / var_lat, 50)), 0.05), 1) ELSE 1 END AS rel
   FROM w WHERE valid),
md AS (SELECT case_id, window_id, frame, median(depth) AS md, median(tot) AS mt FROM k GROUP BY 1, 2, 3),
sc AS (SELECT k.*, rel * (1 + (depth / md) ** 2) * mt / tot AS score FROM k JOIN md USING (case_id, window_id, frame)),
rn AS (SELECT *, row_number() OVER (PARTITION BY case_id, window_id, frame, "row" // 8, col // 8 ORDER BY round(score, 9) DESC, "row", col) AS r FROM sc)
SELECT * FROM rn WHERE r = 1""",
)
def _(spark, sf):
    v = dis.prior_reliability(_variances(spark, sf)).where("valid")
    v = v.select("case_id", "window_id", "frame", "row", "col", "x", "y", "z", "valid", "var_par", "var_lat", "prior_reliability")
    return placed(pr.tile_argmax(v, 8, digits=9))  # the samples of a frame lie together: only what is picked is written


def _methods(spark, sf, more=()):
    """Two methods per cell, from all windows: the average, and the lowest values, which do not hold where they are far off.

    ``more``: further named aggregates over the valid samples of a cell, for both methods.
    """
    s = ad.samples(spark, sf).where("valid")
    both = s.groupBy("case_id", "frame", "row", "col").agg(
        *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.min(c).alias(f"l{c}") for c in "xyz"], *[c.alias(n) for n, c in dict(more).items()]
    )
    mean = F.struct(F.lit("mean").alias("method_id"), F.lit(True).alias("valid"), *[F.col(f"m{c}").alias(c) for c in "xyz"])
    low = F.struct(F.lit("low").alias("method_id"), (F.col("lx") - F.col("col") <= 2.5).alias("valid"), *[F.col(f"l{c}").alias(c) for c in "xyz"])
    return both.select("case_id", "frame", "row", "col", *dict(more), F.inline(F.array(mean, low)))


_METH = f"""{SAMPLES_SQL}, {TRUTH_SQL}, m AS (
  SELECT case_id, frame, "row", col, 'mean' AS method_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v_samples WHERE valid GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT case_id, frame, "row", col, 'low', min(x), min(y), min(z) FROM v_samples WHERE valid GROUP BY 1, 2, 3, 4 HAVING min(x) - col <= 2.5),
sup AS (SELECT case_id, frame, "row", col FROM m GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT method_id) = 2),
common AS (SELECT t.case_id, t.frame, t."row", t.col FROM v_truth t JOIN sup USING (case_id, frame, "row", col) WHERE t.valid),
j AS (SELECT m.*, t.x AS px, t.y AS py, t.z AS pz FROM m JOIN v_truth t USING (case_id, frame, "row", col)
      JOIN common USING (case_id, frame, "row", col)),
e AS (SELECT *, (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2 AS sq FROM j)"""


@query("common_support", "J4", "case_id:str frame:long row:long col:long", f"WITH {_METH} SELECT * FROM common")
def _(spark, sf):
    return joins.common_support(ad.truth(spark, sf), _methods(spark, sf), methods=2)


@query(
    "support_retention",
    "J4 J3",
    "case_id:str method_id:str native_rows:long common_rows:long retention:d",
    f"""WITH {_METH}, nat AS (SELECT m.case_id, method_id, count(*) AS native_rows FROM m JOIN v_truth t
  USING (case_id, frame, "row", col) WHERE t.valid GROUP BY 1, 2),
com AS (SELECT case_id, count(*) AS common_rows FROM common GROUP BY 1)
SELECT *, common_rows / native_rows AS retention FROM nat JOIN com USING (case_id)""",
)
def _(spark, sf):
    m, t = _methods(spark, sf), ad.truth(spark, sf)
    return joins.support_retention(t, m, joins.common_support(t, m, methods=2))


def _matched(spark, sf, more=()):
    return joins.common_rows(ad.truth(spark, sf), _methods(spark, sf, more), ["x", "y", "z", *dict(more)], methods=2, known="xyz")


_CARD = "rmse:d frame_balanced_rmse:d endpoint_rmse:d drift_slope:d points:long frames:long"


@query(
    "sequence_scorecard",
    "A15 J3 W1",
    "case_id:str method_id:str " + _CARD + " seam_rmse:d seam_points:long",
    f"""WITH {_METH}, f AS (SELECT case_id, method_id, frame, sum(sq) AS s, count(*) AS n, sqrt(avg(sq)) AS r FROM e GROUP BY 1, 2, 3),
c AS (SELECT case_id, method_id, sqrt(sum(s) / sum(n)) AS rmse, avg(r) AS frame_balanced_rmse, arg_max(r, frame) AS endpoint_rmse,
             coalesce(regr_slope(r, frame), 0) AS drift_slope, sum(n) AS points, count(*) AS frames FROM f GROUP BY 1, 2),
sm AS (SELECT a.case_id, a.method_id, sqrt(avg(((a.x - a.px) - (b.x - b.px)) ** 2 + ((a.y - a.py) - (b.y - b.py)) ** 2 + ((a.z - a.pz) - (b.z - b.pz)) ** 2)) AS seam_rmse,
              count(*) AS seam_points
       FROM e a JOIN e b ON a.case_id = b.case_id AND a.method_id = b.method_id AND a."row" = b."row" AND a.col = b.col AND a.frame = b.frame + 1
       WHERE a.frame IN (3, 5) GROUP BY 1, 2)
SELECT * FROM c LEFT JOIN sm USING (case_id, method_id)""",
)
def _(spark, sf):
    j = _matched(spark, sf)
    boundaries = ad.samples(spark, sf).where(F.col("frame").isin(3, 5)).select("case_id", "frame").distinct()
    return scores.sequence_scorecard(j, ["case_id", "method_id"], boundaries)


_FIT = """SELECT case_id, method_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(px) AS qx, avg(py) AS qy, avg(pz) AS qz,
  (sum(x * px + y * py + z * pz) - count(*) * (avg(x) * avg(px) + avg(y) * avg(py) + avg(z) * avg(pz)))
  / (sum(x * x + y * y + z * z) - count(*) * (avg(x) ** 2 + avg(y) ** 2 + avg(z) ** 2)) AS scale FROM e {0} GROUP BY 1, 2"""


@query(
    "scale_translation_fit",
    "A16",
    "case_id:str method_id:str fit_points:long scale:d tx:d5 ty:d5 tz:d5",
    f"WITH {_METH}, s AS ({_FIT.format('')}) SELECT case_id, method_id, n AS fit_points, scale, qx - scale * mx AS tx, qy - scale * my AS ty, qz - scale * mz AS tz FROM s",
)
def _(spark, sf):
    return scores.scale_translation_fit(_matched(spark, sf), ["case_id", "method_id"])


def _mode(name: str, where: str | None) -> str:
    if where is None:
        src = "SELECT case_id, method_id, frame, sq FROM e"
    else:
        src = f"""SELECT e.case_id, e.method_id, e.frame, (scale * x + qx - scale * mx - px) ** 2 + (scale * y + qy - scale * my - py) ** 2
          + (scale * z + qz - scale * mz - pz) ** 2 AS sq FROM e JOIN ({_FIT.format(where)}) USING (case_id, method_id)"""
    return f"""SELECT case_id, method_id, '{name}' AS mode, sqrt(sum(s) / sum(n)) AS rmse, avg(r) AS frame_balanced_rmse, arg_max(r, frame) AS endpoint_rmse,
      coalesce(regr_slope(r, frame), 0) AS drift_slope, sum(n) AS points, count(*) AS frames
      FROM (SELECT case_id, method_id, frame, sum(sq) AS s, count(*) AS n, sqrt(avg(sq)) AS r FROM ({src}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(
    "evaluation_modes",
    "A17",
    "case_id:str method_id:str mode:str " + _CARD,
    f"WITH {_METH} {_mode('metric', None)} UNION ALL {_mode('prefix_aligned', 'WHERE frame < 4')} UNION ALL {_mode('oracle_aligned', '')}",
)
def _(spark, sf):
    return scores.evaluation_modes(_matched(spark, sf), ["case_id", "method_id"], F.lit(4))


@query(
    "window_dispersion",
    "J15",
    "case_id:str frame:long row:long col:long n:long dispersion:d",
    f"""WITH {SAMPLES_SQL} SELECT case_id, frame, "row", col, count(*) AS n, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS dispersion
FROM v_samples WHERE valid GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return joins.dispersion(ad.samples(spark, sf))


@query(
    "subsample_rows",
    "T1",
    "case_id:str window_id:str frame:long row:long col:long",
)
def _(spark, sf):
    return rk.subsample(ad.samples(spark, sf), ["case_id", "window_id"], ["frame", "row", "col"], 100, seed=7)
