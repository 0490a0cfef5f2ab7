"""Queries over pixels, cameras and rays, and the composite plans of one provider."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators import disagreement as dis
from obsfuse.operators import project as pr
from obsfuse.plans import adapters as ad
from obsfuse.plans import pipelines
from obsfuse.plans.adapters import CASE_COLS, CASE_ROWS, RESID_SQL, SAMPLES_SQL
from obsfuse.plans.q_fusion import _METH, _matched
from obsfuse.plans.registry import query

_PIXEL = "case_id:str window_id:str frame:long row:long col:long"


@query(
    "flow_displacement",
    "P15",
    f"{_PIXEL} relative_gap:d angular_gap:d log_gap:d",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT *, CASE WHEN col % 3 = 0 THEN 0.0 ELSE 0.5 END AS fx, 0.0 AS fy, CASE WHEN col % 3 = 0 THEN 0.0 ELSE 2.0 END AS fz, ("row" + col) % 5 <> 0 AS deform FROM v_samples WHERE valid),
d AS (SELECT a.*, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM f a JOIN f b ON a.case_id = b.case_id AND a.window_id = b.window_id AND a."row" = b."row" AND a.col = b.col AND b.frame = a.frame + 1 WHERE a.deform),
n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS nd, sqrt(fx * fx + fy * fy + fz * fz) AS nf, sqrt((dx - fx) ** 2 + (dy - fy) ** 2 + (dz - fz) ** 2) AS g FROM d),
r AS (SELECT *, CASE WHEN nd + nf > 2.220446049250313e-16 THEN g / (nd + nf) ELSE 0 END AS relative_gap,
  CASE WHEN nd > 2.220446049250313e-16 AND nf > 2.220446049250313e-16 THEN 0.5 * (1 - least(greatest((dx * fx + dy * fy + dz * fz) / (nd * nf), -1), 1)) ELSE 0 END AS angular_gap FROM n)
SELECT *, ln(1 + relative_gap) AS log_gap FROM r""",
)
def _(spark, sf):
    still = F.col("col") % 3 == 0
    s = ad.samples(spark, sf).withColumns({
        "fx": F.when(still, 0.0).otherwise(0.5), "fy": F.lit(0.0), "fz": F.when(still, 0.0).otherwise(2.0), "deform": (F.col("row") + F.col("col")) % 5 != 0
    })
    return dis.flow_displacement(s)


@query(
    "pixel_samples",
    "P16",
    "case_id:str window_id:str frame:long source_row:long source_col:long row:long col:long depth:d",
    f"""WITH {SAMPLES_SQL}, g AS (SELECT case_id, frame, "row" // 2 AS r, col // 2 AS c, min(z) AS depth FROM v_samples WHERE valid AND "row" % 2 = 0 AND col < 48 GROUP BY 1, 2, 3, 4),
p AS (SELECT case_id, window_id, frame, "row" AS source_row, col AS source_col, (x + 0.5) * 0.5 - 0.5 - 0.5 AS u, (y + 0.5) * 0.5 - 0.5 - 0.0 AS v FROM v_samples WHERE valid),
q AS (SELECT *, CAST(round_even(v, 0) AS BIGINT) AS r, CAST(round_even(u, 0) AS BIGINT) AS c FROM p)
SELECT q.case_id, q.window_id, q.frame, source_row, source_col, q.r AS "row", q.c AS col, depth FROM q JOIN g USING (case_id, frame, r, c) WHERE r BETWEEN 0 AND 19 AND c BETWEEN 0 AND 23""",
)
def _(spark, sf):
    """Points of all windows looked up in a grid of half the size, cropped to 20 x 24."""
    s = ad.samples(spark, sf).where("valid")
    grid = s.where("row % 2 = 0 AND col < 48").groupBy("case_id", "frame", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col"))
    grid = grid.agg(F.min("z").alias("depth")).withColumn("valid", F.lit(True))
    points = s.select("case_id", "window_id", "frame", F.col("row").alias("source_row"), F.col("col").alias("source_col"), F.col("x").alias("u"), F.col("y").alias("v"))
    return pr.nearest_pixel(pr.map_pixels(points, (CASE_ROWS, CASE_COLS), (20, 24)), grid, 20, 24, ["case_id", "frame"])


def _poses(spark, sf):
    """A camera per case and frame that turns about one axis and moves along another."""
    f = ad.samples(spark, sf).select("case_id", "frame").distinct()
    a = 0.1 * F.col("frame") + 0.3
    c, s, zero, one = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    return f.select("case_id", "frame", *v3.named([c, -s, zero, s, c, zero, zero, zero, one], sim3.ROT), (2.0 * F.col("frame")).alias("tx"), F.lit(-1.0).alias("ty"), F.lit(0.5).alias("tz"))


@query(
    "first_camera",
    "P18",
    f"{_PIXEL} x:d y:d z:d",
    f"""WITH {SAMPLES_SQL}, f AS (SELECT case_id, min(frame) AS f0 FROM v_samples GROUP BY 1), p AS (SELECT s.*, 0.1 * f0 + 0.3 AS a, x - 2.0 * f0 AS dx, y + 1.0 AS dy, z - 0.5 AS dz FROM v_samples s JOIN f USING (case_id))
SELECT case_id, window_id, frame, "row", col, cos(a) * dx + sin(a) * dy AS x, -sin(a) * dx + cos(a) * dy AS y, dz AS z FROM p""",
)
def _(spark, sf):
    return pr.first_camera(ad.samples(spark, sf), _poses(spark, sf))


@query(
    "error_basis",
    "P19",
    "group_id:long step:long e_ray:d e_tangent:d e_normal:d",
    f"""WITH {RESID_SQL}, r AS (SELECT group_id, step, ex, ey, ez, 1.0 / n AS rx, w / n AS ry, -2.0 / n AS rz, CASE WHEN step % 5 = 0 THEN 3.0 ELSE 0.5 END AS qx, CASE WHEN step % 5 = 0 THEN 3.0 * w ELSE 1.0 END AS qy, CASE WHEN step % 5 = 0 THEN -6.0 ELSE 0.25 END AS qz
  FROM (SELECT *, target_norm / 5.0 AS w, sqrt(5.0 + target_norm * target_norm / 25.0) AS n FROM v_resid)),
d AS (SELECT *, qx * rx + qy * ry + qz * rz AS k, abs(rx) <= abs(ry) AND abs(rx) <= abs(rz) AS a1, abs(ry) <= abs(rz) AS a2 FROM r),
t AS (SELECT *, sqrt((qx - k * rx) ** 2 + (qy - k * ry) ** 2 + (qz - k * rz) ** 2) > 1e-10 AS own, CASE WHEN a1 THEN rx WHEN a2 THEN ry ELSE rz END AS m FROM d),
u AS (SELECT *, CASE WHEN own THEN qx - k * rx ELSE CASE WHEN a1 THEN 1.0 ELSE 0.0 END - m * rx END AS tx, CASE WHEN own THEN qy - k * ry ELSE CASE WHEN NOT a1 AND a2 THEN 1.0 ELSE 0.0 END - m * ry END AS ty,
  CASE WHEN own THEN qz - k * rz ELSE CASE WHEN NOT a1 AND NOT a2 THEN 1.0 ELSE 0.0 END - m * rz END AS tz FROM t),
v AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS l FROM u)
SELECT group_id, step, ex * rx + ey * ry + ez * rz AS e_ray, (ex * tx + ey * ty + ez * tz) / l AS e_tangent, (ex * (ry * tz - rz * ty) + ey * (rz * tx - rx * tz) + ez * (rx * ty - ry * tx)) / l AS e_normal FROM v""",
)
def _(spark, sf):
    """Residuals along their ray and two directions across it; every fifth reference is parallel to the ray."""
    e = ad.residuals(spark, sf)
    w, along = F.col("target_norm") / 5.0, F.col("step") % 5 == 0
    e = e.withColumns({
        "rx": F.lit(1.0), "ry": w, "rz": F.lit(-2.0), "qx": F.when(along, 3.0).otherwise(0.5), "qy": F.when(along, 3.0 * w).otherwise(1.0), "qz": F.when(along, -6.0).otherwise(0.25)
    })
    return pr.error_basis(e)


@query(
    "unprojected_depth",
    "P26",
    "case_id:str window_id:str frame:long row:long col:long valid:bool x:d y:d z:d rx:d ry:d rz:d",
    f"""WITH {SAMPLES_SQL}, d AS (SELECT *, CASE WHEN "row" % 9 = 0 THEN -z WHEN "row" % 9 = 1 THEN 'nan'::DOUBLE ELSE z END AS depth, 1.0 + col % 10 / 10.0 AS conf, (col - 24.5) / 55.0 AS cx, ("row" - 19.5) / 60.0 AS cy, 0.1 * frame + 0.3 AS a FROM v_samples),
o AS (SELECT *, NOT isnan(depth) AND depth > 0 AND conf >= 1.5 AS ok, cos(a) * cx - sin(a) * cy AS vx, sin(a) * cx + cos(a) * cy AS vy FROM d)
SELECT case_id, window_id, frame, "row", col, ok AS valid, CASE WHEN ok THEN depth * vx + 2.0 * frame ELSE 0.0 END AS x, CASE WHEN ok THEN depth * vy - 1.0 ELSE 0.0 END AS y, CASE WHEN ok THEN depth + 0.5 ELSE 0.0 END AS z,
  vx / sqrt(vx * vx + vy * vy + 1) AS rx, vy / sqrt(vx * vx + vy * vy + 1) AS ry, 1 / sqrt(vx * vx + vy * vy + 1) AS rz FROM o""",
)
def _(spark, sf):
    depth = ad.samples(spark, sf).withColumns({
        "depth": F.when(F.col("row") % 9 == 0, -F.col("z")).when(F.col("row") % 9 == 1, F.lit(float("nan"))).otherwise(F.col("z")), "confidence": 1.0 + F.col("col") % 10 / 10.0
    })
    zero, one = F.lit(0.0), F.lit(1.0)
    kinv = [F.lit(1 / 55.0), zero, F.lit(-24.5 / 55.0), zero, F.lit(1 / 60.0), F.lit(-19.5 / 60.0), zero, zero, one]
    windows = depth.select("case_id", "window_id").distinct()
    poses = _poses(spark, sf).select("*", *v3.named(kinv, [f"k{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)])).join(windows, "case_id")
    return pr.unproject_depth(depth, poses, ["case_id", "window_id", "frame"])


@query(
    "model_blend",
    "P27",
    "case_id:str frame:long row:long col:long alpha:d x:d y:d z:d",
    f"""WITH {SAMPLES_SQL}, m AS (SELECT case_id, frame, "row", col, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, min(x) AS bx, min(y) AS byy, min(z) AS bz FROM v_samples WHERE valid GROUP BY 1, 2, 3, 4)
SELECT case_id, frame, "row", col, alpha, alpha * ax + (1 - alpha) * bx AS x, alpha * ay + (1 - alpha) * byy AS y, alpha * az + (1 - alpha) * bz AS z FROM m JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.7::DOUBLE)) t(alpha) ON true""",
)
def _(spark, sf):
    key = ["case_id", "frame", "row", "col"]
    s = ad.samples(spark, sf).where("valid")
    a, b = (s.groupBy(*key).agg(*[f(c).alias(c) for c in "xyz"]) for f in (F.avg, F.min))
    return pr.blend(a, b, key, [0.0, 0.25, 0.7])


# --- composite plans --------------------------------------------------------------------------


@query(
    "provider_fusion",
    "C3 P3",
    "case_id:str frame:long row:long col:long x:d y:d z:d c_xx:d c_xy:d c_zz:d contributors:long",
    f"""WITH {SAMPLES_SQL}, pa AS (SELECT case_id, window_id, max(frame + CAST(substr(window_id, 2) AS BIGINT)) AS stop FROM v_samples GROUP BY 1, 2),
k AS (SELECT s.*, 2.5e-4 + 2.5e-5 * (x * x + y * y + z * z) AS v FROM v_samples s JOIN pa USING (case_id, window_id) WHERE stop <= 9 AND valid)
SELECT case_id, frame, "row", col, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(v) + var_pop(x) AS c_xx, covar_pop(x, y) AS c_xy, avg(v) + var_pop(z) AS c_zz, count(*) AS contributors FROM k GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    """Payloads whose frames all end in time, in world coordinates; one window of each case is late."""
    s = ad.samples(spark, sf)
    name = F.concat_ws(":", "case_id", "window_id")
    payloads = s.select("case_id", "window_id", name.alias("payload_id"), F.array(name).alias("dependence_group_ids")).distinct()
    stop = F.col("frame") + F.substring("window_id", 2, 9).cast("long")
    lineage = s.select(name.alias("payload_id"), F.col("frame").alias("output_frame"), F.lit(0).cast("bigint").alias("source_start"), stop.alias("source_stop")).distinct()
    return pipelines.fuse_provider(s, payloads, lineage, 9, "metric-world", "uniform")


_CHI = {p: q for p, q in v3.CHI2_3.items()}
_SCOPE = f"""WITH {_METH}, fu AS (SELECT case_id, frame, "row", col, count(*) AS contributors, 1.0 + coalesce(var_pop(x), 0) AS va, 0.5 + coalesce(var_pop(y), 0) AS vb, 2.0 + coalesce(var_pop(z), 0) AS vc FROM v_samples WHERE valid GROUP BY 1, 2, 3, 4),
fi AS (SELECT case_id, method_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(px) AS qx, avg(py) AS qy, avg(pz) AS qz,
  (sum(x * px + y * py + z * pz) - count(*) * (avg(x) * avg(px) + avg(y) * avg(py) + avg(z) * avg(pz))) / (sum(x * x + y * y + z * z) - count(*) * (avg(x) ** 2 + avg(y) ** 2 + avg(z) ** 2)) AS s FROM e GROUP BY 1, 2),
rs AS (SELECT e.case_id, e.method_id, contributors, s * (x - mx) + qx - px AS ex, s * (y - my) + qy - py AS ey, s * (z - mz) + qz - pz AS ez, s * s * va AS va, s * s * vb AS vb, s * s * vc AS vc FROM e JOIN fi USING (case_id, method_id) JOIN fu USING (case_id, frame, "row", col)),
sc AS (SELECT *, 'all' AS scope FROM rs UNION ALL SELECT *, 'overlap' FROM rs WHERE contributors > 1),
mz AS (SELECT *, ex * ex / va + ey * ey / vb + ez * ez / vc AS m2 FROM sc),
pe AS (SELECT case_id, method_id, scope, avg(CASE WHEN m2 <= {_CHI[0.9]} THEN 1.0 ELSE 0.0 END) AS coverage_90, avg(m2) AS mean_m2, avg(0.5 * (3 * {v3.LOG_2PI} + ln(va * vb * vc) + m2)) AS gaussian_nll,
  ({' + '.join(f"abs(avg(CASE WHEN m2 <= {q} THEN 1.0 ELSE 0.0 END) - {p})" for p, q in _CHI.items())}) / 4 AS calibration_error FROM mz GROUP BY 1, 2, 3)"""


def _scoped(spark, sf):
    spread = {f"c_{c}{c}": F.lit(k) + F.coalesce(F.var_pop(c), F.lit(0.0)) for c, k in zip("xyz", (1.0, 0.5, 2.0), strict=True)}
    fused = _matched(spark, sf, {"contributors": F.count(F.lit(1)), **spread}).drop("tx", "ty", "tz")
    return fused.withColumns({"valid": F.lit(True), **{f"c_{n}": F.lit(0.0) for n in ("xy", "xz", "yz")}})


@query(
    "scoped_comparison",
    "A73",
    "method_id:str scope:str sequences:long coverage_90:d gaussian_nll:d calibration_error:d mean_m2:d minimum_coverage_90:d",
    f"""{_SCOPE} SELECT method_id, scope, count(*) AS sequences, avg(coverage_90) AS coverage_90, avg(gaussian_nll) AS gaussian_nll, avg(calibration_error) AS calibration_error, avg(mean_m2) AS mean_m2, min(coverage_90) AS minimum_coverage_90
FROM pe GROUP BY 1, 2""",
)
def _(spark, sf):
    return pipelines.scoped_comparison(_scoped(spark, sf), ad.truth(spark, sf), "mean", 200)["summary"]
