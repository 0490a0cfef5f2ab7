"""Queries over joint covariances, track building, image grids, identity streams and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators import disagreement as dis
from obsfuse.operators import fusion, gaussian, joins, tracks
from obsfuse.operators import project as pr
from obsfuse.plans import adapters as ad
from obsfuse.plans.adapters import CASE_COLS, CASE_ROWS, EST_SQL, RESID_SQL, SAMPLES_SQL, TRACKS_SQL
from obsfuse.plans.q_models import _CAND_SQL, _CFG
from obsfuse.plans.registry import query
from obsfuse.runtime import fresh_folder
from obsfuse.sources import tables
from obsfuse.streaming import admission, incremental

# --- covariance of linked windows ----------------------------------------------------------

#: Gauge variances of the test view: scale, rotation, translation.
_GS, _GR, _GT = 1e-4, 1e-5, 0.5


def _gauge_rows(df):
    """Rows at unit gauges: the 3 x 7 Jacobian [p, -[p]x, I] and a conditional covariance."""
    x, y, z = v3.vec()
    zero, one = F.lit(0.0), F.lit(1.0)
    jac = [x, zero, z, -y, one, zero, zero, y, -z, zero, x, zero, one, zero, z, y, -x, zero, zero, zero, one]
    base = F.lit(2.0) - F.col("association_probability")
    cov = (base, F.lit(0.1), zero, base + 0.5, zero, F.lit(1.5))
    return df.select("*", F.array(*jac).alias("jacobian"), *v3.named_sym(cov, "k_"))  # type: ignore[arg-type]


def _gauge_blocks(rows, keys):
    """Covariance blocks of every ordered pair of windows; the windows of a case are correlated."""
    w = rows.groupBy(*keys, "window_id").agg(F.avg("association_probability").alias("m"))
    a, b = (w.select(*keys, F.col("window_id").alias(f"window_{i}"), F.col("m").alias(f"m{i}")) for i in "ij")
    j = a.join(b, keys)
    k = F.when(F.col("window_i") == F.col("window_j"), F.col("mi")).otherwise(0.4 * F.sqrt(F.col("mi") * F.col("mj")))
    size = [_GS, _GR, _GR, _GR, _GT, _GT, _GT]
    return j.select(*keys, "window_i", "window_j", F.array(*[k * size[r] if r == c else F.lit(0.0) for r in range(7) for c in range(7)]).alias("block"))


_BLOCKS_SQL = """wm AS (SELECT {k} window_id, avg(association_probability) AS m FROM {t} GROUP BY ALL),
bl AS (SELECT {a} i.window_id AS wi, j.window_id AS wj, CASE WHEN i.window_id = j.window_id THEN i.m ELSE 0.4 * sqrt(i.m * j.m) END AS k FROM wm i JOIN wm j {on})"""


def _cross(a: str, b: str, i: int, j: int) -> str:
    """Entry (i, j) of J_a P J_b^T without its factor k."""
    p, q = ([f"{s}.{c}" for c in "xyz"] for s in (a, b))
    dot = " + ".join(f"{m} * {n}" for m, n in zip(p, q, strict=True))
    same = f"({dot}) - " if i == j else "-"
    return f"({_GS} * {p[i]} * {q[j]} + {_GR} * ({same}{q[i]} * {p[j]}) + {_GT if i == j else 0.0})"


_SIX = [("xx", 0, 0), ("xy", 0, 1), ("xz", 0, 2), ("yy", 1, 1), ("yz", 1, 2), ("zz", 2, 2)]
_COND = {"xx": "(2 - l.association_probability) + (2 - r.association_probability)", "xy": "0.2", "xz": "0.0", "yy": "(2.5 - l.association_probability) + (2.5 - r.association_probability)", "yz": "0.0", "zz": "3.0"}
_EVIDENCE = f"""WITH {_CAND_SQL}, {_BLOCKS_SQL.format(k='', t='v_tracks', a='', on='ON true')},
pr AS (SELECT left_id, right_id, l.x - r.x AS dx, l.y - r.y AS dy, l.z - r.z AS dz, l.association_probability * r.association_probability AS w,
  {', '.join(f"{_COND[s]} + ll.k * {_cross('l', 'l', i, j)} + rr.k * {_cross('r', 'r', i, j)} - lr.k * ({_cross('l', 'r', i, j)} + {_cross('r', 'l', i, j)}) AS c_{s}" for s, i, j in _SIX)}
  FROM sc JOIN v_tracks l ON l.track_id = left_id JOIN v_tracks r ON r.track_id = right_id AND r.frame = l.frame
  JOIN bl ll ON ll.wi = 'w0' AND ll.wj = 'w0' JOIN bl rr ON rr.wi = 'w1' AND rr.wj = 'w1' JOIN bl lr ON lr.wi = 'w0' AND lr.wj = 'w1'),
dt AS (SELECT *, c_xx * (c_yy * c_zz - c_yz * c_yz) - c_xy * (c_xy * c_zz - c_yz * c_xz) + c_xz * (c_xy * c_yz - c_yy * c_xz) AS det FROM pr),
m AS (SELECT left_id, right_id, w, ((c_yy * c_zz - c_yz * c_yz) * dx * dx + (c_xx * c_zz - c_xz * c_xz) * dy * dy + (c_xx * c_yy - c_xy * c_xy) * dz * dz
  + 2 * ((c_xz * c_yz - c_xy * c_zz) * dx * dy + (c_xy * c_yz - c_xz * c_yy) * dx * dz + (c_xy * c_xz - c_xx * c_yz) * dy * dz)) / det AS m2 FROM dt),
n AS (SELECT left_id, right_id, sqrt(sum(w * m2 / 3) / sum(w)) AS normalized_rms FROM m GROUP BY 1, 2)
SELECT sc.*, normalized_rms, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS place FROM sc JOIN n USING (left_id, right_id)"""


@query("joint_link_evidence", "G8", "left_id:long right_id:long shared_frames:long support:d rms:d score:d place:long normalized_rms:d", _EVIDENCE)
def _(spark, sf):
    rows = _gauge_rows(ad.tracks(spark, sf).withColumn("case_id", F.lit("c")))
    blocks = _gauge_blocks(rows, ["case_id"])
    return tracks.ranked_link_evidence(rows.where("window_id = 'w0'"), rows.where("window_id = 'w1'"), blocks, _CFG)


_SEEN = """s AS (SELECT *, 0.5 + ("row" + col) % 10 / 20.0 AS association_probability FROM v_samples WHERE valid)"""
_A = [("0.001", "0.0", "0.0"), ("0.0", "0.001 * frame", "0.0005")]


def _sum7(k: int, n: int) -> str:
    """Sum of column k of J times query row n."""
    p = [["x", "0.0", "z", "-y", "1.0", "0.0", "0.0"], ["y", "-z", "0.0", "x", "0.0", "1.0", "0.0"], ["z", "y", "-x", "0.0", "0.0", "0.0", "1.0"]]
    return f"sum({' + '.join(f'({p[i][k]}) * {_A[n][i]}' for i in range(3))}) AS s{k}_{n}"


_D = [["2 - association_probability", "0.1", "0.0"], ["0.1", "2.5 - association_probability", "0.0"], ["0.0", "0.0", "1.5"]]


def _conditional(m: int, n: int) -> str:
    return f"sum({' + '.join(f'{_A[m][i]} * ({_D[i][j]}) * {_A[n][j]}' for i in range(3) for j in range(3))}) AS c{m}{n}"


def _gauge_part(m: int, n: int) -> str:
    size = [_GS, _GR, _GR, _GR, _GT, _GT, _GT]
    return f"sum(k * ({' + '.join(f'{size[k]} * a.s{k}_{m} * b.s{k}_{n}' for k in range(7))})) AS g{m}{n}"


_QUERY = f"""WITH {SAMPLES_SQL}, {_SEEN}, {_BLOCKS_SQL.format(k='case_id,', t='s', a='i.case_id,', on='USING (case_id)')},
lo AS (SELECT case_id, window_id, {', '.join(_sum7(k, n) for k in range(7) for n in range(2))} FROM s GROUP BY 1, 2),
co AS (SELECT case_id, count(*) AS n, {_conditional(0, 0)}, {_conditional(0, 1)}, {_conditional(1, 1)} FROM s GROUP BY 1),
ga AS (SELECT bl.case_id, {_gauge_part(0, 0)}, {_gauge_part(0, 1)}, {_gauge_part(1, 1)} FROM bl JOIN lo a ON a.case_id = bl.case_id AND a.window_id = wi JOIN lo b ON b.case_id = bl.case_id AND b.window_id = wj GROUP BY 1)
SELECT co.*, g00, g01, g11, c00 + g00 AS m00, c01 + g01 AS m01, c11 + g11 AS m11 FROM co JOIN ga USING (case_id)"""


def _seen(spark, sf):
    return ad.samples(spark, sf).where("valid").withColumn("association_probability", 0.5 + (F.col("row") + F.col("col")) % 10 / 20.0)


@query("gauge_query", "A41", "case_id:str n:long c00:d c01:d c11:d g00:d4 g01:d4 g11:d4 m00:d4 m01:d4 m11:d4", _QUERY)
def _(spark, sf):
    rows = _gauge_rows(_seen(spark, sf))
    a = F.array(F.lit(0.001), F.lit(0.0), F.lit(0.0), F.lit(0.0), 0.001 * F.col("frame"), F.lit(0.0005))
    out = gaussian.gauge_query(rows.withColumn("query", a), _gauge_blocks(rows, ["case_id"]), 2)
    parts = {"c": "conditional", "g": "gauge", "m": "marginal"}
    return out.select("case_id", "n", *[F.col(c)[2 * i + j].alias(f"{s}{i}{j}") for s, c in parts.items() for i, j in ((0, 0), (0, 1), (1, 1))])


# --- tracks inside a window -------------------------------------------------------------------

_LINK = tracks.LinkConfig(radius=3, maximum_error=1.2, sigma=0.9, minimum_link=0.1, minimum_length=2, require_target_deform=True)
_STOP = 6


def _flow_samples(spark, sf):
    """Samples with a flow that follows the scene, wrong for some columns, and a mask of moving pixels."""
    s = ad.samples(spark, sf)
    k = 1.0 + F.substring("window_id", 2, 1).cast("double") * 0.1
    return s.withColumns({
        "fx": F.when(F.col("col") % 7 == 0, 1.5 * k).otherwise(F.lit(0.0)), "fy": F.lit(0.0), "fz": 2.0 * k, "deform": (F.col("row") + F.col("col") + F.col("frame")) % 6 != 0
    })


_STEP = "sqrt((t.x - s.x - s.fx) ** 2 + (t.y - s.y - s.fy) ** 2 + (t.z - s.z - s.fz) ** 2)"
_WALK = f"""WITH RECURSIVE {SAMPLES_SQL},
f AS (SELECT *, 1.0 + CAST(substr(window_id, 2, 1) AS DOUBLE) * 0.1 AS k, ("row" + col + frame) % 6 <> 0 AS deform FROM v_samples WHERE frame < {_STOP}),
px AS (SELECT case_id, window_id, "row" AS r, col AS c, x, y, z, CASE WHEN col % 7 = 0 THEN 1.5 * k ELSE 0.0 END AS fx, 0.0 AS fy, 2.0 * k AS fz, valid, deform, frame,
  dense_rank() OVER (PARTITION BY case_id, window_id ORDER BY frame) - 1 AS local FROM f),
la AS (SELECT case_id, window_id, max(local) AS last FROM px GROUP BY 1, 2),
wk AS (SELECT case_id, window_id, row_number() OVER (PARTITION BY case_id, window_id ORDER BY r, c) - 1 AS track, local, r, c, 1.0::DOUBLE AS link, 1.0::DOUBLE AS assoc, NULL::VARCHAR AS why
  FROM px WHERE local = 0 AND valid AND deform AND r % 2 = 0 AND c % 2 = 0
  UNION ALL
  SELECT case_id, window_id, track, local + 1, tr, tc, lk, assoc * lk, CASE WHEN why IS NULL AND claim > 1 THEN 'collision' ELSE why END FROM (
    SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY case_id, window_id, tr, tc, why ORDER BY lk DESC, e, track) END AS claim FROM (
      SELECT *, CASE WHEN NOT sound THEN 'invalid-source' WHEN near = 0 THEN 'no-candidate' WHEN e IS NULL THEN 'target-mask' WHEN e > 1.2 THEN 'step-error' WHEN lk < 0.1 THEN 'low-probability' END AS why FROM (
        SELECT *, exp(-0.5 * (e / 0.9) ** 2) * (CASE WHEN e2 IS NULL THEN 1 ELSE 1 - exp(-0.5 * ((e2 - e) / 0.9) ** 2) END) AS lk FROM (
          SELECT case_id, window_id, track, local, assoc, sound, near, cand[1].e AS e, cand[1].r AS tr, cand[1].c AS tc, cand[2].e AS e2 FROM (
            SELECT w.case_id, w.window_id, w.track, w.local, w.assoc, bool_and(s.valid AND s.deform) AS sound, count(t.r) AS near,
              list_sort(list({{'e': {_STEP}, 'r': t.r, 'c': t.c}}) FILTER (t.deform)) AS cand
            FROM wk w JOIN la USING (case_id, window_id) JOIN px s ON s.case_id = w.case_id AND s.window_id = w.window_id AND s.local = w.local AND s.r = w.r AND s.c = w.c
            LEFT JOIN px t ON t.case_id = w.case_id AND t.window_id = w.window_id AND t.local = w.local + 1 AND t.valid AND abs(t.r - w.r) <= 3 AND abs(t.c - w.c) <= 3
            WHERE w.why IS NULL AND w.local < la.last GROUP BY 1, 2, 3, 4, 5)))))),
ok AS (SELECT *, count(*) OVER (PARTITION BY case_id, window_id, track) AS n FROM wk WHERE why IS NULL)"""


def _tracklets(spark, sf):
    s = _flow_samples(spark, sf)
    seeds = s.where("row % 2 = 0 AND col % 2 = 0").select("case_id", "window_id", "row", "col").distinct()
    return tracks.causal_tracklets(s, _STOP, seeds, _LINK)


@query(
    "causal_tracks",
    "W10 P24",
    "case_id:str window_id:str track_id:long frame:long local_frame:long row:long col:long link_probability:d association_probability:d",
    f"""{_WALK}, nm AS (SELECT case_id, window_id, track, row_number() OVER (PARTITION BY case_id, window_id ORDER BY track) - 1 AS track_id FROM ok WHERE n >= 2 AND local = 0)
SELECT ok.case_id, ok.window_id, track_id, px.frame, ok.local AS local_frame, ok.r AS "row", ok.c AS col, link AS link_probability, assoc AS association_probability
FROM ok JOIN nm USING (case_id, window_id, track) JOIN px ON px.case_id = ok.case_id AND px.window_id = ok.window_id AND px.local = ok.local AND px.r = ok.r AND px.c = ok.c""",
)
def _(spark, sf):
    return _tracklets(spark, sf)[0]


@query(
    "causal_track_ends",
    "W10",
    "case_id:str window_id:str reason:str tracks:long",
    f"""{_WALK}, e AS (SELECT case_id, window_id, why AS reason FROM wk WHERE why IS NOT NULL UNION ALL SELECT case_id, window_id, 'short' FROM ok WHERE n < 2)
SELECT case_id, window_id, reason, count(*) AS tracks FROM e GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return _tracklets(spark, sf)[1]


@query(
    "track_probability",
    "W12",
    "case_id:str window_id:str track_id:long geometric_mean:d length:long",
    f"""{_WALK}, nm AS (SELECT case_id, window_id, track, row_number() OVER (PARTITION BY case_id, window_id ORDER BY track) - 1 AS track_id FROM ok WHERE n >= 2 AND local = 0)
SELECT case_id, window_id, track_id, exp(avg(ln(link))) AS geometric_mean, count(*) AS length FROM ok JOIN nm USING (case_id, window_id, track) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return tracks.track_probability(_tracklets(spark, sf)[0])


# --- image grids -----------------------------------------------------------------------------

_KEY = ["case_id", "window_id", "frame"]
_KEYS = "case_id, window_id, frame"


def _lit_sql(n: int, m: int, name: str) -> str:
    """Target indices of one axis with two source indices and weights."""
    u = f"CASE WHEN i = {m - 1} THEN {float(n - 1)} ELSE i * CAST({(n - 1) / (m - 1)!r} AS DOUBLE) END"
    return f"""{name} AS (SELECT i AS t, CAST(floor(u) AS BIGINT) AS s, 1 - (u - floor(u)) AS w FROM (SELECT i, {u} AS u FROM range({m}) g(i))
  UNION ALL SELECT i, least(CAST(floor(u) AS BIGINT) + 1, {n - 1}), u - floor(u) FROM (SELECT i, {u} AS u FROM range({m}) g(i)))"""


def _resampled_sql(height: int, width: int) -> str:
    return f"""WITH {SAMPLES_SQL}, {_lit_sql(CASE_ROWS, height, 'ar')}, {_lit_sql(CASE_COLS, width, 'ac')}, k AS (SELECT DISTINCT {_KEYS} FROM v_samples),
s AS (SELECT k.case_id, k.window_id, k.frame, ar.t AS "row", ac.t AS col, sum(CASE WHEN p.z IS NOT NULL THEN ar.w * ac.w ELSE 0.0 END) AS support, sum(ar.w * ac.w * coalesce(p.z, 0.0)) AS z
  FROM k JOIN ar ON true JOIN ac ON true LEFT JOIN (SELECT * FROM v_samples WHERE valid) p ON p.case_id = k.case_id AND p.window_id = k.window_id AND p.frame = k.frame AND p."row" = ar.s AND p.col = ac.s GROUP BY 1, 2, 3, 4, 5)
SELECT {_KEYS}, "row", col, support, support >= 0.5 AS valid, CASE WHEN support >= 0.5 THEN z / support ELSE 0.0 END AS z FROM s"""


_GRID_SIG = "case_id:str window_id:str frame:long row:long col:long support:d valid:bool z:d"


@query("resampled_grid", "P17", _GRID_SIG, _resampled_sql(14, 17))
def _(spark, sf):
    return pr.resample_grid(ad.samples(spark, sf), (CASE_ROWS, CASE_COLS), (14, 17), ["z"], _KEY)


@query("enlarged_grid", "P17", _GRID_SIG, _resampled_sql(55, 60))
def _(spark, sf):
    return pr.resample_grid(ad.samples(spark, sf), (CASE_ROWS, CASE_COLS), (55, 60), ["z"], _KEY)


_FAR = 8


@query(
    "farthest_points",
    "T5",
    "case_id:str window_id:str frame:long rank:long row:long col:long",
    f"""WITH RECURSIVE {SAMPLES_SQL}, p AS (SELECT {_KEYS}, "row" AS r, col AS c FROM v_samples WHERE valid),
w AS (SELECT {_KEYS}, 0 AS rank, r, c, [{{'r': r, 'c': c}}] AS picks FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY (r - {(CASE_ROWS - 1) / 2}) ** 2 + (c - {(CASE_COLS - 1) / 2}) ** 2, r, c) AS i FROM p) WHERE i = 1
  UNION ALL SELECT case_id, window_id, frame, rank + 1, r, c, list_append(picks, {{'r': r, 'c': c}}) FROM (
    SELECT w.case_id, w.window_id, w.frame, w.rank, w.picks, p.r, p.c, row_number() OVER (PARTITION BY w.case_id, w.window_id, w.frame ORDER BY list_min(list_transform(w.picks, lambda q: (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c))) DESC, p.r, p.c) AS i
    FROM w JOIN p USING (case_id, window_id, frame) WHERE w.rank < {_FAR - 1} AND list_min(list_transform(w.picks, lambda q: (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c))) > 0) WHERE i = 1)
SELECT {_KEYS}, rank, r AS "row", c AS col FROM w""",
)
def _(spark, sf):
    return pr.farthest_points(ad.samples(spark, sf), _FAR, shape=(CASE_ROWS, CASE_COLS))


def _cell_sql(n: int, parts: int, c: str) -> str:
    bounds = [n * i // parts for i in range(1, parts)]
    return " + ".join(f"CASE WHEN {c} >= {b} THEN 1 ELSE 0 END" for b in bounds)


def _anchor_sql(n: int, parts: int, stride: int, name: str) -> str:
    rows = []
    for i in range(parts):
        lo, hi = n * i // parts, n * (i + 1) // parts
        mid, first = lo + (hi - lo - 1) // 2, lo + min(stride // 2, max(hi - lo - 1, 0))
        rows += [f"({i}, {k}, {a})" for k, a in enumerate([mid, *[v for v in range(first, hi, stride) if v != mid]])]
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) v(cell, k, pos))"


@query(
    "spatial_seeds",
    "W11",
    "case_id:str window_id:str row:long col:long cell_id:long",
    f"""WITH RECURSIVE {SAMPLES_SQL}, {_anchor_sql(CASE_ROWS, 4, 6, 'ar')}, {_anchor_sql(CASE_COLS, 4, 6, 'ac')},
p AS (SELECT case_id, window_id, "row" AS r, col AS c, {_cell_sql(CASE_ROWS, 4, '"row"')} AS cr, {_cell_sql(CASE_COLS, 4, 'col')} AS cc FROM v_samples WHERE valid AND frame = 1),
ce AS (SELECT case_id, window_id, cr, cc, list({{'r': r, 'c': c}}) AS px FROM p GROUP BY 1, 2, 3, 4),
an AS (SELECT ar.cell AS cr, ac.cell AS cc, ar.pos AS r, ac.pos AS c, row_number() OVER (PARTITION BY ar.cell, ac.cell ORDER BY ar.k, ac.k) AS i FROM ar JOIN ac ON true),
w AS (SELECT case_id, window_id, cr, cc, px, 0::BIGINT AS i, NULL::STRUCT(r BIGINT, c BIGINT) AS got, 0 AS n FROM ce
  UNION ALL SELECT case_id, window_id, cr, cc, list_filter(px, lambda q: q <> got), i, got, n + 1 FROM (
    SELECT w.case_id, w.window_id, w.cr, w.cc, w.px, an.i, w.n, list_sort(list_transform(w.px, lambda q: {{'d': (q.r - an.r) ** 2 + (q.c - an.c) ** 2, 'q': q}}))[1].q AS got
    FROM w JOIN an ON an.cr = w.cr AND an.cc = w.cc AND an.i = w.i + 1 WHERE len(w.px) > 0 AND w.n < 5))
SELECT case_id, window_id, got.r AS "row", got.c AS col, cr * 4 + cc AS cell_id FROM w WHERE i > 0""",
)
def _(spark, sf):
    return tracks.spatial_seeds(ad.samples(spark, sf).where("valid AND frame = 1"), CASE_ROWS, CASE_COLS, 6, (4, 4), 5)


# --- ranges along rays --------------------------------------------------------------------------

_CENTRE = ("1.5", "-2.25", "-30.0")


def _rays(spark, sf):
    """Rays from one centre per frame; parallel in every fifth frame and case, off the points in some."""
    s = ad.samples(spark, sf)
    off = tuple(F.col(c) - F.lit(float(m)) for c, m in zip("xyz", _CENTRE, strict=True))
    n = v3.norm(off)  # type: ignore[arg-type]
    parallel = (F.substring("case_id", 2, 9).cast("long") + F.col("frame")) % 5 == 0
    bent = (F.substring("case_id", 2, 9).cast("long") + F.col("frame")) % 5 == 1
    s = s.withColumns({"u": off[0] / n, "v": off[1] / n, "w": off[2] / n})
    tilt = F.when(bent & ((F.col("row") + F.col("col")) % 9 == 0), F.lit(0.01)).otherwise(F.lit(0.0))
    keep = F.sqrt(1.0 - tilt * tilt)
    s = s.withColumns({
        "rx": F.when(parallel, 0.0).otherwise(F.col("u") * keep + tilt), "ry": F.when(parallel, 0.0).otherwise(F.col("v") * keep),
        "rz": F.when(parallel, 1.0).otherwise(F.col("w") * keep),
    })
    return s.drop("u", "v", "w").where("NOT (frame = 7 AND row % 3 = 0)")


_RAYS = f"""{SAMPLES_SQL}, q AS (SELECT *, x - {_CENTRE[0]} AS a, y - ({_CENTRE[1]}) AS b, z - ({_CENTRE[2]}) AS c, (CAST(substr(case_id, 2) AS BIGINT) + frame) % 5 AS kind FROM v_samples WHERE NOT (frame = 7 AND "row" % 3 = 0)),
q2 AS (SELECT *, sqrt(a * a + b * b + c * c) AS len, CASE WHEN kind = 1 AND ("row" + col) % 9 = 0 THEN 0.01 ELSE 0.0 END AS tilt FROM q),
ry AS (SELECT *, CASE WHEN kind = 0 THEN 0.0 ELSE a / len * sqrt(1 - tilt * tilt) + tilt END AS rx, CASE WHEN kind = 0 THEN 0.0 ELSE b / len * sqrt(1 - tilt * tilt) END AS ry, CASE WHEN kind = 0 THEN 1.0 ELSE c / len * sqrt(1 - tilt * tilt) END AS rz FROM q2),
vr AS (SELECT *, rx * x + ry * y + rz * z AS al FROM ry WHERE valid),
su AS (SELECT {_KEYS}, count(*) AS n, count(*) - sum(rx * rx) AS a, -sum(rx * ry) AS b, -sum(rx * rz) AS c, count(*) - sum(ry * ry) AS d, -sum(ry * rz) AS e, count(*) - sum(rz * rz) AS f,
  sum(x - rx * al) AS px, sum(y - ry * al) AS py, sum(z - rz * al) AS pz FROM vr GROUP BY 1, 2, 3),
dt AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det, a + d + f AS tr FROM su),
ce AS (SELECT {_KEYS}, n, CASE WHEN n < 3 THEN 'too-few-rays' WHEN det <= 1e-9 * (tr / 3) ** 3 THEN 'ill-conditioned' ELSE 'ok' END AS status,
  ((d * f - e * e) * px + (c * e - b * f) * py + (b * e - c * d) * pz) / det AS cx, ((c * e - b * f) * px + (a * f - c * c) * py + (b * c - a * e) * pz) / det AS cy,
  ((b * e - c * d) * px + (b * c - a * e) * py + (a * d - b * b) * pz) / det AS cz FROM dt),
fr AS (SELECT DISTINCT {_KEYS} FROM ry),
rg AS (SELECT vr.*, cx, cy, cz, (x - cx) * rx + (y - cy) * ry + (z - cz) * rz AS rng FROM vr JOIN ce USING (case_id, window_id, frame) WHERE status = 'ok'),
pp AS (SELECT *, sqrt((x - cx - rng * rx) ** 2 + (y - cy - rng * ry) ** 2 + (z - cz - rng * rz) ** 2) AS perp, max(rng) OVER (PARTITION BY {_KEYS}) AS peak FROM rg),
bd AS (SELECT {_KEYS}, sum(CASE WHEN rng >= 0 AND perp <= 1e-5 + 1e-5 * peak THEN 0 ELSE 1 END) AS bad FROM pp GROUP BY 1, 2, 3),
st AS (SELECT fr.case_id, fr.window_id, fr.frame, coalesce(n, 0) AS rays, coalesce(bad, 0) AS inconsistent, CASE WHEN n IS NULL THEN 'too-few-rays' WHEN status = 'ok' AND bad > 0 THEN 'inconsistent-rays' ELSE status END AS status
  FROM fr LEFT JOIN ce USING (case_id, window_id, frame) LEFT JOIN bd USING (case_id, window_id, frame))"""


@query("range_status", "P9", "case_id:str window_id:str frame:long rays:long inconsistent:long status:str", f"WITH {_RAYS} SELECT * FROM st")
def _(spark, sf):
    return dis.range_status(_rays(spark, sf))


@query(
    "range_variances",
    "P9 P8",
    "case_id:str window_id:str frame:long row:long col:long range:d var_par:d var_lat:d",
    f"""WITH {_RAYS} SELECT case_id, window_id, frame, "row", col, rng AS "range", 2.5e-4 + 2.5e-5 * rng * rng AS var_par, 2.5e-4 + 2.5e-5 * rng * rng AS var_lat
FROM pp JOIN st USING (case_id, window_id, frame) WHERE status = 'ok'""",
)
def _(spark, sf):
    return dis.range_variances(_rays(spark, sf), None)


# --- rotations -------------------------------------------------------------------------------------

_AXIS = [("k", "CAST(e.event_id % 5 AS DOUBLE) - 2"), ("m", "CAST(e.event_id % 7 AS DOUBLE) - 3"), ("n", "CAST(e.event_id % 3 AS DOUBLE) - 1")]


@query(
    "rotation_log",
    "F1",
    "event_id:long wx:d wy:d wz:d",
    f"""WITH a AS (SELECT event_id, {', '.join(f"{x} AS {c}" for c, x in _AXIS)}, CASE WHEN event_id % 4 < 2 THEN pi() ELSE (event_id % 100) * 0.03 END AS angle FROM events e),
u AS (SELECT *, sqrt(k * k + m * m + n * n) AS len FROM a WHERE k <> 0 OR m <> 0 OR n <> 0),
s AS (SELECT *, CASE WHEN event_id % 4 < 2 AND (k < 0 OR k = 0 AND m < 0 OR k = 0 AND m = 0 AND n < 0) THEN -angle ELSE angle END / len AS f FROM u)
SELECT event_id, f * k AS wx, f * m AS wy, f * n AS wz FROM s""",
)
def _(spark, sf):
    """Rotations about small whole axes; half of them half turns, exact up to rounding."""
    e = ad.read(spark, sf, "events").select("event_id", *[(F.col("event_id") % p - q).cast("double").alias(c) for c, p, q in (("k", 5, 2), ("m", 7, 3), ("n", 3, 1))])
    e = e.where("k <> 0 OR m <> 0 OR n <> 0")
    length = F.sqrt(F.col("k") ** 2 + F.col("m") ** 2 + F.col("n") ** 2)
    a = tuple(F.col(c) / length for c in "kmn")
    half = F.col("event_id") % 4 < 2
    angle = (F.col("event_id") % 100) * 0.03
    c, s = F.when(half, -1.0).otherwise(F.cos(angle)), F.when(half, 0.0).otherwise(F.sin(angle))
    cross = [[None, -a[2], a[1]], [a[2], None, -a[0]], [-a[1], a[0], None]]
    rot = [(1 - c) * a[i] * a[j] + (c if i == j else s * cross[i][j]) for i in range(3) for j in range(3)]
    return sim3.rotation_vectors(e.select("event_id", *v3.named(rot, sim3.ROT)))


# --- forecasts ------------------------------------------------------------------------------------------


def _forecasts(spark, sf):
    t = ad.tracks(spark, sf).withColumn("case_id", F.lit("c"))
    end = t.agg(F.min("frame")).first()[0] + 10
    truth = t.where(F.col("window_id") == "w0").select("case_id", F.col("track_id").alias("point_id"), "frame", "x", "y", "z", (F.col("association_probability") > 0.4).alias("visible"))
    nodes = t.where(F.col("window_id") == "w1").select("case_id", F.col("track_id").alias("node_id"), "frame", "x", "y", "z")
    start = truth.where(F.col("frame") == end).select("case_id", "point_id", "x", "y", "z")
    later = truth.where(F.col("frame") > end)
    stay = later.select("case_id", "point_id", "frame").join(start, ["case_id", "point_id"])
    moved = {"persistence": stay} | {n: tracks.anchored_rollout(start, nodes, end, offset=o).where(F.col("frame") > end) for n, o in (("rollout", True), ("association_only", False))}
    forecasts = None
    for name, df in moved.items():
        df = df.select("case_id", "point_id", "frame", "x", "y", "z", F.lit(name).alias("method_id"))
        forecasts = df if forecasts is None else forecasts.unionByName(df)
    return tracks.forecast_comparison(later, forecasts)


@query(
    "forecast_comparison",
    "A68 P25",
    "method_id:str scope:str n:long mean:d rmse:d median:d p90:d p95:d",
    f"""WITH {TRACKS_SQL}, e AS (SELECT min(frame) + 10 AS e FROM v_tracks), t AS (SELECT track_id AS p, frame, x, y, z, association_probability > 0.4 AS vis FROM v_tracks WHERE window_id = 'w0'),
nd AS (SELECT track_id AS n, frame, x, y, z FROM v_tracks WHERE window_id = 'w1'), st AS (SELECT t.* FROM t, e WHERE frame = e), la AS (SELECT t.* FROM t, e WHERE frame > e), an AS (SELECT nd.* FROM nd, e WHERE frame = e),
ne AS (SELECT st.p, arg_min(an.n, ((st.x - an.x) ** 2 + (st.y - an.y) ** 2 + (st.z - an.z) ** 2, an.n)) AS n FROM st, an GROUP BY 1),
ro AS (SELECT ne.p, nd.frame, nd.x, nd.y, nd.z, st.x - an.x AS ox, st.y - an.y AS oy, st.z - an.z AS oz FROM ne JOIN nd USING (n) JOIN an USING (n) JOIN st ON st.p = ne.p),
fc AS (SELECT 'persistence' AS method_id, la.p, la.frame, st.x, st.y, st.z FROM la JOIN st ON st.p = la.p
  UNION ALL SELECT 'rollout', p, frame, x + ox, y + oy, z + oz FROM ro UNION ALL SELECT 'association_only', p, frame, x, y, z FROM ro),
er AS (SELECT method_id, vis, sqrt((fc.x - la.x) ** 2 + (fc.y - la.y) ** 2 + (fc.z - la.z) ** 2) AS err FROM fc JOIN la ON la.p = fc.p AND la.frame = fc.frame),
sc AS (SELECT method_id, 'all' AS scope, err FROM er UNION ALL SELECT method_id, 'visible', err FROM er WHERE vis)
SELECT method_id, scope, count(*) AS n, avg(err) AS mean, sqrt(avg(err * err)) AS rmse, quantile_cont(err, 0.5) AS median, quantile_cont(err, 0.9) AS p90, quantile_cont(err, 0.95) AS p95 FROM sc GROUP BY 1, 2""",
)
def _(spark, sf):
    return _forecasts(spark, sf)


# --- support audit ----------------------------------------------------------------------------------------

_AUDIT = f"""WITH {RESID_SQL}, b AS (SELECT group_id, step AS row_id, valid FROM v_resid),
pt AS (SELECT group_id, row_id FROM b WHERE valid UNION ALL SELECT group_id, row_id FROM b WHERE valid AND row_id % 97 = 0),
sc AS (SELECT group_id, row_id, axis FROM b JOIN (VALUES ('x'), ('y'), ('z')) a(axis) ON (valid OR row_id % 50 = 1) AND NOT (axis = 'z' AND row_id % 61 = 0) UNION ALL SELECT group_id, row_id, 'x' FROM b WHERE valid AND row_id % 83 = 0),
ep AS (SELECT group_id, row_id FROM b WHERE row_id % 10 = 0), ro AS (SELECT DISTINCT group_id FROM b WHERE group_id % 19 <> 0 UNION ALL SELECT -1),
de AS (SELECT group_id, count(*) + CASE WHEN group_id % 23 = 0 THEN 1 ELSE 0 END AS declared, sum(row_id) + CASE WHEN group_id % 29 = 0 THEN 1 ELSE 0 END AS declared_sum FROM pt WHERE group_id % 31 <> 0 GROUP BY group_id)"""


def _audit(spark, sf):
    b = ad.residuals(spark, sf).select("group_id", F.col("step").alias("row_id"), "valid")
    row, group = F.col("row_id"), F.col("group_id")
    points = b.where("valid").withColumn("c", F.explode(F.when(row % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("group_id", "row_id")
    axis = F.array(F.lit("x"), F.lit("y"), F.when(row % 61 != 0, "z"), F.when(F.col("valid") & (row % 83 == 0), "x"))
    scores = b.where(F.col("valid") | (row % 50 == 1)).select("group_id", "row_id", F.explode(F.array_compact(axis)).alias("axis"))
    endpoints = b.where(row % 10 == 0).select("group_id", "row_id")
    roster = b.select("group_id").distinct().where(group % 19 != 0).union(spark.range(1).select(F.lit(-1).cast("bigint").alias("group_id")))
    declared = points.where(group % 31 != 0).groupBy("group_id").agg(
        (F.count(F.lit(1)) + F.when(group % 23 == 0, 1).otherwise(0)).alias("declared"), (F.sum("row_id") + F.when(group % 29 == 0, 1).otherwise(0)).alias("declared_sum")
    )
    return joins.audit_support(points, scores, declared, ["group_id"], 3, {"endpoint": endpoints}, roster)


@query(
    "support_audit",
    "J17",
    "group_id:long row_id:long problem:str",
    f"""{_AUDIT} SELECT DISTINCT group_id, row_id, 'orphan_score' AS problem FROM sc WHERE (group_id, row_id) NOT IN (SELECT group_id, row_id FROM pt)
UNION ALL SELECT DISTINCT group_id, row_id, 'orphan_endpoint' FROM ep WHERE (group_id, row_id) NOT IN (SELECT group_id, row_id FROM pt)
UNION ALL SELECT group_id, row_id, 'duplicate_point' FROM pt GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT p.group_id, p.row_id, 'axis_roster' FROM (SELECT DISTINCT * FROM pt) p LEFT JOIN (SELECT group_id, row_id, count(*) AS n, count(DISTINCT axis) AS a FROM sc GROUP BY 1, 2) s USING (group_id, row_id) WHERE coalesce(a, 0) <> 3 OR n > a
UNION ALL SELECT group_id, NULL, 'missing_pair' FROM ro WHERE group_id NOT IN (SELECT group_id FROM pt)
UNION ALL SELECT DISTINCT group_id, NULL::BIGINT, 'extra_pair' FROM pt WHERE group_id NOT IN (SELECT group_id FROM ro)""",
)
def _(spark, sf):
    return _audit(spark, sf)[0]


@query(
    "support_recount",
    "J17",
    "group_id:long counted:long counted_sum:long declared:long declared_sum:long",
    f"""{_AUDIT}, c AS (SELECT group_id, count(*) AS counted, sum(row_id) AS counted_sum FROM pt GROUP BY 1)
SELECT * FROM c FULL JOIN de USING (group_id) WHERE counted IS DISTINCT FROM declared OR counted_sum IS DISTINCT FROM declared_sum""",
)
def _(spark, sf):
    return _audit(spark, sf)[1]


# --- fused table ---------------------------------------------------------------------------------------------

_AT_REST = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("x", "y", "z"))


@query(
    "fused_round_trip",
    "S5 S4",
    "case_id:str method_id:str cell:long x:d3 y:d3 z:d3 c_xx:d3 c_xy:d3 c_yy:d3 c_zz:d3 contributors:long",
    f"""WITH {EST_SQL}, u AS (SELECT cell, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(a) + coalesce(var_pop(x), 0) AS c_xx, avg(b) + covar_pop(x, y) AS c_xy,
  avg(c) + coalesce(var_pop(y), 0) AS c_yy, avg(e) + coalesce(var_pop(z), 0) AS c_zz, count(*) AS contributors FROM v_est GROUP BY 1),
i AS (SELECT *, c / (a * c - b * b) AS pa, -b / (a * c - b * b) AS pb, a / (a * c - b * b) AS pc, 1.0 / e AS pe FROM v_est),
s AS (SELECT cell, count(*) AS contributors, sum(pa) AS ia, sum(pb) AS ib, sum(pc) AS ic, sum(pe) AS ize, sum(pa * x + pb * y) AS sx, sum(pb * x + pc * y) AS sy, sum(pe * z) AS sz FROM i GROUP BY 1),
p AS (SELECT cell, (ic * sx - ib * sy) / (ia * ic - ib * ib) AS x, (ia * sy - ib * sx) / (ia * ic - ib * ib) AS y, sz / ize AS z, contributors FROM s)
SELECT 'c' || CAST(cell % 5 AS VARCHAR) AS case_id, 'mean' AS method_id, cell, {_AT_REST}, {', '.join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("c_xx", "c_xy", "c_yy", "c_zz"))}, contributors FROM u
UNION ALL SELECT 'c' || CAST(cell % 5 AS VARCHAR), 'information', cell, {_AT_REST}, NULL, NULL, NULL, NULL, contributors FROM p""",
)
def _(spark, sf):
    """One method is written twice, two cases of it a third time; the other is read without its covariances."""
    est, path = ad.estimates(spark, sf), f"{fresh_folder(spark, 'fused')}/t"

    def placed(df):
        return df.select(
            F.concat(F.lit("c"), (F.col("cell") % 5).cast("string")).alias("case_id"), F.lit(0).cast("bigint").alias("frame"), F.col("cell").cast("int").alias("row"), F.lit(0).alias("col"),
            "x", "y", "z", *[f"c_{s}" for s in v3.SYM], "contributors",
        )

    mean = placed(fusion.fuse_uniform(est, ["cell"]))
    tables.write_fused(mean.withColumn("x", F.lit(0.0)), path, "mean", "uniform")
    tables.write_fused(mean, path, "mean", "uniform")
    tables.write_fused(placed(fusion.fuse_precision(est, ["cell"])), path, "information", "precision")
    tables.write_fused(mean.where("case_id IN ('c1', 'c3')"), path, "mean", "uniform")
    both = tables.read_fused(spark, path, ["mean"]).unionByName(tables.read_fused(spark, path, ["information"], covariance=False))
    return both.withColumn("cell", F.col("row").cast("bigint"))


# --- streams ----------------------------------------------------------------------------------------------------


def _identity_updates(c):
    n, turn = F.length("text"), F.col("turn")

    def window(k):
        return F.concat(F.lit("w"), (turn + k).cast("string"))

    more = F.array_compact(F.array(F.when(n % 4 == 0, window(-2)), F.when(n % 11 == 0, window(-1)), F.when(n % 13 == 0, window(3))))
    sources = F.when(turn == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(window(-1)), more))
    stop = turn * 10 - F.when(n % 17 == 0, 25).otherwise(0)
    return c.select(
        F.col("conv_id").cast("string").alias("stream_id"), F.concat_ws(":", "conv_id", "turn").alias("update_id"), turn.alias("position"),
        F.when(n % 9 == 0, window(-1)).otherwise(window(0)).alias("target"), sources.alias("sources"),
        F.transform(sources, lambda s, i: stop + F.when((n % 6 == 0) & (i == 1), 1).otherwise(0)).alias("stops"), F.sha2("text", 256).alias("content_hash"),
    )


_IDENTITY = """WITH RECURSIVE n AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, concat_ws(':', conv_id, turn) AS update_id, turn AS position, length(text) AS n, sha256(text) AS content FROM conversations),
b AS (SELECT *, 'w' || CASE WHEN n % 9 = 0 THEN position - 1 ELSE position END AS target, CASE WHEN position = 0 THEN []::VARCHAR[] ELSE list_filter(['w' || (position - 1), CASE WHEN n % 4 = 0 THEN 'w' || (position - 2) END,
  CASE WHEN n % 11 = 0 THEN 'w' || (position - 1) END, CASE WHEN n % 13 = 0 THEN 'w' || (position + 3) END], lambda x: x IS NOT NULL) END AS sources, position * 10 - CASE WHEN n % 17 = 0 THEN 25 ELSE 0 END AS stop FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY position, update_id) AS i FROM b),
w AS (SELECT stream_id, 0::BIGINT AS i, []::VARCHAR[] AS known, NULL::BIGINT AS last, NULL::VARCHAR AS chain, NULL::VARCHAR AS update_id, NULL::VARCHAR AS target, NULL::BIGINT AS position, NULL::VARCHAR AS reason, NULL::BIGINT AS hypotheses FROM (SELECT DISTINCT stream_id FROM o)
  UNION ALL SELECT stream_id, i, CASE WHEN reason IS NULL THEN list_append(known, target) ELSE known END, CASE WHEN reason IS NULL AND len(sources) > 0 THEN stop ELSE last END,
    CASE WHEN reason IS NULL THEN sha256(coalesce(chain, '') || '|' || content) ELSE chain END, update_id, target, position, reason, CASE WHEN reason IS NULL THEN len(sources) END FROM (
    SELECT o.*, w.known, w.last, w.chain, CASE WHEN len(known) = 0 AND len(sources) = 0 THEN NULL WHEN list_contains(known, o.target) THEN 'target-already-admitted' WHEN len(sources) = 0 THEN 'no-association'
      WHEN len(list_distinct(sources)) <> len(sources) THEN 'repeated-source' WHEN NOT list_has_all(known, sources) THEN 'source-not-admitted' WHEN n % 6 = 0 AND len(sources) > 1 THEN 'causal-stop-differs'
      WHEN stop < w.last THEN 'causal-stop-decreases' END AS reason FROM w JOIN o ON o.stream_id = w.stream_id AND o.i = w.i + 1))
SELECT stream_id, update_id, target, position, reason IS NULL AS admitted, reason, hypotheses, CASE WHEN reason IS NULL THEN chain END AS chain_id FROM w WHERE i > 0"""


@query("identity_stream", "R4", "stream_id:str update_id:str target:str position:long admitted:bool reason:str hypotheses:long chain_id:str", _IDENTITY)
def _(spark, sf):
    """Two runs over one checkpoint: the first turns of all conversations, then the others."""
    table, folder = ad.read(spark, sf, "conversations"), fresh_folder(spark, "identity")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in ("turn < 3", "turn >= 3"):
        table.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
        incremental.run_available(admission.admit_identities(_identity_updates(stream)), f"{folder}/out")
    return spark.read.parquet(f"{folder}/out")


@query(
    "stream_late_rows",
    "R2",
    "event_type:str kept:long late:long kept_value:d4 late_value:d4",
    """WITH m AS (SELECT max(ts) - INTERVAL 9 DAY AS mark FROM events WHERE event_id % 3 <> 0), e AS (SELECT event_type, value, event_id % 3 = 0 AND ts < mark AS late FROM events, m)
SELECT event_type, sum(CASE WHEN late THEN 0 ELSE 1 END) AS kept, sum(CASE WHEN late THEN 1 ELSE 0 END) AS late, sum(CASE WHEN late THEN 0.0 ELSE value END) AS kept_value, sum(CASE WHEN late THEN value ELSE 0.0 END) AS late_value FROM e GROUP BY 1""",
)
def _(spark, sf):
    """A second arrival holds rows of all days; those behind the watermark of the first are late."""
    table, folder = ad.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), fresh_folder(spark, "late")
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        table.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{folder}/in")
        incremental.causal_rows(stream, f"{folder}/out", delay="9 days")
    rows, late = spark.read.parquet(f"{folder}/out/rows"), F.col("late")
    return rows.groupBy("event_type").agg(
        F.count_if(~late).alias("kept"), F.count_if(late).alias("late"), F.sum(F.when(late, 0.0).otherwise(F.col("value"))).alias("kept_value"), F.sum(F.when(late, F.col("value")).otherwise(0.0)).alias("late_value")
    )
