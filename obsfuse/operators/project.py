"""Row projections: masks, cut-offs, geometry, resampling and factor rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators.ranking import window_median
from obsfuse.runtime import attach, durable, violations

TINY = 2.2250738585072014e-308


def active_rows(df: DataFrame, mask: str = "valid", values: Sequence[str] = ("x", "y", "z"), strict: bool = True) -> DataFrame:
    """Rows with the mask set.  Active non-finite values raise (or are dropped if not strict)."""
    ok = v3.finite(*[F.col(c) for c in values])
    kept = df.where(F.coalesce(F.col(mask), F.lit(False)))
    if not strict:
        return kept.where(ok)
    guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("active value is not finite")))
    return kept.where(guard)


def quarantine_rows(df: DataFrame, mask: str = "valid", values: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    ok = v3.finite(*[F.col(c) for c in values])
    return df.where(F.coalesce(F.col(mask), F.lit(False)) & ~ok).withColumn("reason", F.lit("non-finite-active-value"))


def causal_windows(manifest: DataFrame, cutoff: int) -> DataFrame:
    """Manifest windows whose whole source interval lies before ``cutoff``.

    Admitted windows must be a prefix of the ordered manifest (index ``position``) and
    starts must not decrease; both are checked on the manifest only, before any payload
    is read.
    """
    kept = F.col("stop_frame") <= cutoff
    edge = manifest.groupBy("case_id").agg(
        F.max(F.when(kept, F.col("position"))).alias("last_in"), F.min(F.when(~kept, F.col("position"))).alias("first_out")
    )
    violations(edge.where("last_in > first_out"), "admitted windows are not a manifest prefix")
    order = W.partitionBy("case_id").orderBy("position")
    violations(
        manifest.withColumn("prev", F.lag("start_frame").over(order)).where("start_frame < prev"),
        "window starts decrease",
    )
    return manifest.where(kept)


def admitted_payloads(lineage: DataFrame, cutoff: int) -> DataFrame:
    """Payloads all of whose output frames use sources before ``cutoff``."""
    return (
        lineage.groupBy("payload_id")
        .agg(F.max("source_stop").alias("source_stop"), F.count(F.lit(1)).alias("frames"))
        .where(F.col("source_stop") <= cutoff)
    )


def sliding_lineage(sequences: DataFrame, size: int, overlap: int, cutoff: int | None = None) -> DataFrame:
    """Output frame -> min/max source frame over the slices that contain it.

    Slices are [k s, k s + size) with s = size - overlap, clipped to the sequence; a
    sequence no longer than ``size`` is one slice.  Input: (sequence_id, frames).
    Slice membership is arithmetic, so there is no range join.
    """
    stride = size - overlap
    n = F.col("frames")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(stride)).cast("int"))
    slices = sequences.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("k") * stride
    stop = F.least(start + size, n)
    rows = slices.select(
        "sequence_id", "frames", start.alias("start"), stop.alias("stop"),
        F.explode(F.sequence(start.cast("bigint"), (stop - 1).cast("bigint"))).alias("frame"),
    )
    out = rows.groupBy("sequence_id", "frame").agg(
        F.min("start").cast("bigint").alias("source_min"),
        (F.max("stop") - 1).cast("bigint").alias("source_max"),
        F.count(F.lit(1)).alias("slices"),
    )
    return out if cutoff is None else out.withColumn("admissible", F.col("source_max") < cutoff)


def usable_observations(df: DataFrame, include_invalid: bool = False) -> DataFrame:
    return df if include_invalid else df.where("valid AND association_probability > 0 AND prior_reliability > 0")


def to_world(samples: DataFrame, gauges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """y = s R x + t for points, s R f for flows, R d for directions when present."""
    j = attach(samples, gauges.select(*keys, *sim3.GAUGE_COLUMNS), keys, how="inner")
    rot, s, t = sim3.rot_columns(), F.col("scale"), sim3.t_columns()
    new = dict(zip("xyz", v3.apply_similarity(s, rot, t, v3.vec()), strict=True))
    if "fx" in samples.columns:
        new.update(zip(("fx", "fy", "fz"), v3.scale(s, v3.mat_vec(rot, v3.vec("f"))), strict=True))
    if "rx" in samples.columns:
        new.update(zip(("rx", "ry", "rz"), v3.mat_vec(rot, v3.vec("r")), strict=True))
    if "c_xx" in samples.columns:
        c = v3.congruence(rot, v3.sym())
        new.update({f"c_{n}": s * s * v for n, v in zip(v3.SYM, c, strict=True)})
    return j.withColumns(new).select(*samples.columns)


def tile_argmax(df: DataFrame, stride: int, fixed_grid: bool = False, digits: int | None = None) -> DataFrame:
    """Best-scoring row per stride x stride tile of every frame, scan order on ties.

    Score = reliability (1 + (depth / median)^2) median variance / variance; medians are
    per frame, which is sorted in one task: rows that lie together by frame are not moved.  ``digits`` rounds the score before ranking so engines that sum in a
    different order agree on ties.  A tile holds at most stride^2 rows.
    """
    valid = df.where("valid")
    if fixed_grid:
        return valid.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    frame = ["case_id", "window_id", "frame"]
    base = valid.withColumns({"__depth": v3.norm(v3.vec()), "__var": F.col("var_par") + 2 * F.col("var_lat")})
    j = window_median(window_median(base, frame, "__depth", "__md"), frame, "__var", "__mv")
    score = (
        F.col("prior_reliability")
        * (1 + F.pow(F.col("__depth") / F.greatest("__md", F.lit(TINY)), F.lit(2.0)))
        * F.greatest("__mv", F.lit(TINY))
        / F.col("__var")
    )
    j = j.withColumn("score", score)
    rank = F.round("score", digits) if digits is not None else F.col("score")
    w = W.partitionBy(*frame, F.floor(F.col("row") / stride), F.floor(F.col("col") / stride)).orderBy(
        rank.desc(), "row", "col"
    )
    return j.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__depth", "__var", "__md", "__mv")


def nearest_pixel(points: DataFrame, grid: DataFrame, height: int, width: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Sample the grid at rint(u, v) (banker's rounding) inside bounds and mask."""
    p = points.withColumns({"col": F.rint("u").cast("int"), "row": F.rint("v").cast("int")})
    p = p.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))
    return p.join(grid.where("valid").drop("valid"), [*keys, "row", "col"])


def cover_resize(source: tuple[int, int], target: tuple[int, int]) -> tuple[float, float, float]:
    """Scale and crop offsets of a cover resize: (scale, row offset, col offset)."""
    (sh, sw), (th, tw) = source, target
    k = max(th / sh, tw / sw)
    return k, (sh * k - th) / 2.0, (sw * k - tw) / 2.0


def map_pixels(df: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(u, v) of the source image -> pixel coordinates of the resized, cropped grid."""
    k, top, left = cover_resize(source, target)
    return df.withColumns(
        {
            "u": (F.col("u") + 0.5) * F.lit(k) - 0.5 - F.lit(left),
            "v": (F.col("v") + 0.5) * F.lit(k) - 0.5 - F.lit(top),
        }
    )


def resample_grid(
    df: DataFrame, source: tuple[int, int], target: tuple[int, int], values: Sequence[str], keys: Sequence[str], minimum_support: float = 0.5
) -> DataFrame:
    """Mask-aware bilinear resampling: bilinear(mask value) / bilinear(mask), for every cell of the target grid.

    The valid pixels of a key meet in bands of target rows, so only they are shuffled, most of them once; each band
    gathers the four weighted neighbours of its cells from its own pixels.  A cell is valid where the support is at
    least ``minimum_support``; the values of the others are 0.
    """
    keys, values = list(keys), list(values)
    (n, width), (m, _) = source, target
    (rl, rh, rw), (cl, ch, cw) = (_sides(a, b) for a, b in zip(source, target, strict=True))
    height = max(1, BAND_CELLS // max(source[1], target[1]))
    bands = -(-m // height)
    table = [sorted({i // height for i in range(m) if s in (rl[i], rh[i])}) for s in range(n)]
    lookup = F.array(*[F.array(*[F.lit(b) for b in bs]).cast("array<int>") for bs in table])
    none = F.lit(None)
    pixels = df.where("valid").where(F.col("row").between(0, n - 1) & F.col("col").between(0, width - 1)).select(
        *keys, F.explode(lookup[F.col("row").cast("int")]).alias("__band"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values],
    )
    every = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("__band")).select(
        "*", none.cast("int").alias("row"), none.cast("int").alias("col"), *[none.cast("double").alias(v) for v in values]
    )
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "row int, col int, support double, valid boolean", *[f"`{v}` double" for v in values]])

    def run(group: pa.Table) -> pa.Table:
        band = group["__band"][0].as_py()
        to = np.arange(band * height, min(m, band * height + height))
        first = rl[to].min()
        rows = rh[to].max() - first + 1
        here = group.filter(pc.is_valid(group["row"]))
        at = (here["row"].to_numpy() - first) * width + here["col"].to_numpy()

        def bilinear(weights: np.ndarray | None) -> np.ndarray:
            grid = np.bincount(at, weights, rows * width).astype(float).reshape(rows, width)
            total = np.zeros((len(to), len(cl)))
            for r, wr in ((rl[to], 1 - rw[to]), (rh[to], rw[to])):
                for c, wc in ((cl, 1 - cw), (ch, cw)):
                    total += np.outer(wr, wc) * grid[np.ix_(r - first, c)]
            return total.ravel()

        support = bilinear(None)
        ok = support >= minimum_support
        size = len(support)
        out = {k: pa.repeat(group[k][0], size) for k in keys}
        out |= {"row": np.repeat(to, len(cl)).astype(np.int32), "col": np.tile(np.arange(len(cl), dtype=np.int32), len(to)), "support": support, "valid": ok}
        for v in values:
            out[v] = np.where(ok, bilinear(here[v].to_numpy()) / np.where(ok, support, 1.0), 0.0)
        return pa.table(out)

    return pixels.unionByName(every).groupBy(*keys, "__band").applyInArrow(run, schema)


#: cells of one row of bands that :func:`resample_grid` handles at once.
BAND_CELLS = 65_536


def _sides(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target index of one axis its two source indices and the weight of the second."""
    at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
    at[m - 1] = float(n - 1) if m > 1 else 0.0
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n - 1), at - low


def resample_mask(df: DataFrame, source: tuple[int, int], target: tuple[int, int], keys: Sequence[str]) -> DataFrame:
    """Plain masks take the pixel at rint(linspace(0, n - 1, m)) on each axis."""
    def targets(coord: str, n: int, m: int) -> Column:
        picks = np.rint(np.linspace(0, n - 1, m)).astype(int)
        table = [[int(t) for t in np.flatnonzero(picks == s)] for s in range(n)]
        lookup = F.array(*[F.array(*[F.lit(t) for t in ts]).cast("array<int>") for ts in table])
        return lookup[F.col(coord)]

    r = df.withColumn("__r", F.explode(targets("row", *[source[0], target[0]])))
    c = r.withColumn("__c", F.explode(targets("col", *[source[1], target[1]])))
    return c.select(*keys, F.col("__r").alias("row"), F.col("__c").alias("col"), "valid")


def first_camera(samples: DataFrame, poses: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Express points in the first frame's camera: R0^T (p - t0)."""
    cols = [*sim3.ROT, "tx", "ty", "tz"]
    first = poses.groupBy(*keys).agg(F.min_by(F.struct(*cols), "frame").alias("p")).select(*keys, "p.*")
    j = attach(samples, first, keys, how="inner")
    off = v3.sub(v3.vec(), sim3.t_columns())
    rt = [F.col(f"r{j}{i}") for i in (1, 2, 3) for j in (1, 2, 3)]
    return j.withColumns(dict(zip("xyz", v3.mat_vec(rt, off), strict=True))).select(*samples.columns)  # type: ignore[arg-type]


def error_basis(df: DataFrame, reference: str = "q") -> DataFrame:
    """Residual components along the ray, the tangent of a reference direction, and
    their cross product.

    The reference direction is in columns ``<reference>x/y/z``; where it is parallel to
    the ray the coordinate axis with the smallest ray component takes its place.
    """
    ray = v3.unit(v3.vec("r"))
    staged = df.withColumns(dict(zip(("__rx", "__ry", "__rz"), ray, strict=True)))
    r, q = v3.vec("__r"), v3.vec(reference)

    def tangent(v: v3.Vec) -> v3.Vec:
        k = v3.dot(v, r)
        return tuple(a - k * b for a, b in zip(v, r, strict=True))  # type: ignore[return-value]

    ax, ay, az = (F.abs(c) for c in r)
    first = (ax <= ay) & (ax <= az)
    second = ~first & (ay <= az)
    axis = (
        F.when(first, 1.0).otherwise(0.0),
        F.when(second, 1.0).otherwise(0.0),
        F.when(~first & ~second, 1.0).otherwise(0.0),
    )
    t1, t2 = tangent(q), tangent(axis)
    use = v3.norm(t1) > 1e-10
    raw = tuple(F.when(use, a).otherwise(b) for a, b in zip(t1, t2, strict=True))
    staged = staged.withColumns(dict(zip(("__tx", "__ty", "__tz"), raw, strict=True)))
    t = v3.unit(v3.vec("__t"))
    staged = staged.withColumns(dict(zip(("__ux", "__uy", "__uz"), t, strict=True)))
    u, e = v3.vec("__u"), v3.vec("e")
    return staged.select(
        *df.columns,
        v3.dot(e, r).alias("e_ray"),
        v3.dot(e, u).alias("e_tangent"),
        v3.dot(e, v3.cross(r, u)).alias("e_normal"),
    )


def unproject_depth(depth: DataFrame, poses: DataFrame, keys: Sequence[str] = ("case_id", "frame"), confidence: float = 1.5) -> DataFrame:
    """Depth + confidence -> world points and unit rays.

    Valid = finite depth and confidence, depth > 0, confidence >= threshold; confidence
    decides support only.  ``poses``: rotation, translation, inverse intrinsics k11..k33.
    """
    kinv = [f"k{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    j = attach(depth, poses.select(*keys, *sim3.ROT, "tx", "ty", "tz", *kinv), keys, how="inner", salt_by=["row", "col"])
    ok = v3.finite(F.col("depth"), F.col("confidence")) & (F.col("depth") > 0) & (F.col("confidence") >= confidence)
    pixel = (F.col("col").cast("double"), F.col("row").cast("double"), v3.d(1.0))
    cam = v3.mat_vec([F.col(c) for c in kinv], pixel)
    rot = sim3.rot_columns()
    world = v3.add(v3.mat_vec(rot, v3.scale(F.col("depth"), cam)), sim3.t_columns())  # type: ignore[arg-type]
    ray = v3.unit(v3.mat_vec(rot, cam))
    nul = F.lit(0.0)
    return j.select(
        *keys, "row", "col", ok.alias("valid"),
        *[F.when(ok, c).otherwise(nul).alias(n) for n, c in zip("xyz", world, strict=True)],
        *v3.named(ray, ["rx", "ry", "rz"]),
    )


def blend(a: DataFrame, b: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """alpha a + (1 - alpha) b on matching rows, one output row per alpha (exploded)."""
    r = b.select(*keys, *[F.col(c).alias(f"b{c}") for c in "xyz"])
    j = a.join(r, list(keys)).withColumn("alpha", F.explode(F.array(*[F.lit(float(v)) for v in alphas])))
    k = F.col("alpha")
    return j.select(*keys, "alpha", *[(k * F.col(c) + (1 - k) * F.col(f"b{c}")).alias(c) for c in "xyz"])


def link_likelihood(best: Column, second: Column, sigma: float) -> Column:
    """exp(-(e1/s)^2/2) (1 - exp(-((e2-e1)/s)^2/2)); the second factor is 1 without e2."""
    first = F.exp(F.lit(-0.5) * F.pow(best / F.lit(sigma), F.lit(2.0)))
    margin = F.greatest(second - best, F.lit(0.0))
    unique = F.when(second.isNull(), F.lit(1.0)).otherwise(
        1 - F.exp(F.lit(-0.5) * F.pow(margin / F.lit(sigma), F.lit(2.0)))
    )
    return F.least(F.greatest(first * unique, F.lit(0.0)), F.lit(1.0))


def track_factors(tracks: DataFrame, effective: float = 64.0, cells: tuple[int, int] | None = None) -> DataFrame:
    """Track rows -> observation factor rows with composite weights.

    One factor per frame; the frame's total weight budget is min(1, n_eff / count).  With
    ``cells`` (row size, col size) a frame is split into spatial groups that share that
    budget.  Counts are aggregated first, so a busy frame is never one window.
    """
    frame = ["window_id", "frame"]
    counts = tracks.groupBy(*frame).agg(F.count(F.lit(1)).alias("frame_count"))
    out = attach(tracks, counts, frame, salt_by=["track_id"])
    weight = F.least(F.lit(1.0), F.lit(effective) / F.col("frame_count"))
    if cells is None:
        return out.select("*", weight.alias("composite_weight"), F.col("frame").alias("correlation_group_id"))
    out = out.withColumns(
        {"cell_row": F.floor(F.col("row") / cells[0]), "cell_col": F.floor(F.col("col") / cells[1])}
    )
    grouped = out.groupBy(*frame, "cell_row", "cell_col").agg(F.count(F.lit(1)).alias("cell_count"))
    out = attach(out, grouped, [*frame, "cell_row", "cell_col"], salt_by=["track_id"])
    group = F.concat_ws(":", "frame", "cell_row", "cell_col")
    return out.select("*", weight.alias("composite_weight"), group.alias("correlation_group_id"))


# --- linearised factors ----------------------------------------------------------------


def gauge_coefficients(gauges: DataFrame, keys: Sequence[str], factor: bool = False) -> DataFrame:
    """Per-gauge affine coefficients: covariance polynomial, ``jac`` (3x7) and, when a
    column ``block`` (7 x R row-major) is present and ``factor`` is set, ``fac`` (3 x R)."""
    extra = ", jac array<double>" + (", fac array<double>, rank int" if factor else "")
    base = [*keys, *sim3.GAUGE_COLUMNS]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gauges.select(*base).schema.fields)
    schema += ", " + ", ".join(f"{c} double" for c in sim3.POLY) + extra

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                t = sim3.unpack(row)
                cov = np.zeros((7, 7)) if row.get("cov") is None else sim3.square(row["cov"])
                basis = sim3.jacobian_basis(t)
                out = [*[row[c] for c in base], *sim3.covariance_polynomial(t, cov), basis.ravel().tolist()]
                if factor:
                    block = np.asarray(row["block"], dtype=float).reshape(7, -1)
                    out += [(basis @ block).ravel().tolist(), block.shape[1]]
                rows.append(out)
            yield pd.DataFrame(rows, columns=[*base, *sim3.POLY, "jac", *(["fac", "rank"] if factor else [])])

    return gauges.mapInPandas(run, schema)


def affine_array(coeff: Column, size: Column | int, p: v3.Vec) -> Column:
    """Array form of the affine evaluation for a data-dependent length."""
    n = size if isinstance(size, Column) else F.lit(size)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: coeff[i] + coeff[n + i] * p[0] + coeff[2 * n + i] * p[1] + coeff[3 * n + i] * p[2],
    )


def stack_factors(rows: DataFrame, gauges: DataFrame, keys: Sequence[str], factor: bool = False) -> DataFrame:
    """World mean, conditional and marginal covariance, 3x7 Jacobian, shared factor rows.

    The Jacobian stays sparse: 21 values plus the gauge key, never 3 x 7K.  Fields not
    listed are carried through unchanged.
    """
    g = gauge_coefficients(gauges, keys, factor)
    j = attach(rows, g, keys, how="inner")
    p, rot, s = v3.vec(), sim3.rot_columns(), F.col("scale")
    world = v3.apply_similarity(s, rot, sim3.t_columns(), p)
    cond = tuple(s * s * c for c in v3.congruence(rot, v3.sym()))
    marg = v3.add(cond, sim3.gauge_covariance_columns(p))
    cols = [
        *[F.col(c) for c in rows.columns],
        *v3.named(world, ["wx", "wy", "wz"]),
        *v3.named_sym(cond, "k_"),  # type: ignore[arg-type]
        *v3.named_sym(marg, "m_"),  # type: ignore[arg-type]
        affine_array(F.col("jac"), 21, p).alias("jacobian"),
    ]
    if factor:
        cols.append(affine_array(F.col("fac"), 3 * F.col("rank"), p).alias("factor"))
    return j.select(*cols)


def farthest_points(
    df: DataFrame, k: int, keys: Sequence[str] = ("case_id", "window_id", "frame"), shape: tuple[int, int] | None = None
) -> DataFrame:
    """Centre-first farthest-point subset of the valid pixels of each frame: ``rank`` 0 to k - 1.

    The first pixel is the nearest to the centre of the image (``shape``, or the largest row and column that
    occur, valid or not); each next one is the farthest from all chosen ones; ties in scan order.  The k rounds
    keep one small row per frame, written down each round; distances are taken from it, so no plan grows.
    Frames with fewer than k valid pixels give all of them.
    """
    keys = list(keys)
    pts = durable(df.where("valid").select(*keys, "row", "col"))
    if shape is None:
        size = df.groupBy(*keys).agg((F.max("row") / 2.0).alias("mr"), (F.max("col") / 2.0).alias("mc"))
    else:
        size = pts.select(*keys).distinct().select(*keys, F.lit((shape[0] - 1) / 2.0).alias("mr"), F.lit((shape[1] - 1) / 2.0).alias("mc"))
    none = F.array().cast("array<struct<row: int, col: int>>")
    chosen = durable(size.withColumn("picks", none))

    def gap(row: Column, col: Column) -> Column:
        return F.pow(F.col("row") - row, F.lit(2.0)) + F.pow(F.col("col") - col, F.lit(2.0))

    for i in range(k):
        j = attach(pts, chosen, keys, how="inner", salt_by=["row", "col"])
        nearest = F.array_min(F.transform("picks", lambda p: gap(p["row"], p["col"])))
        far = gap(F.col("mr"), F.col("mc")) if i == 0 else F.when(nearest > 0, -nearest)
        best = j.select(*keys, far.alias("__d"), F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).alias("__at"))
        best = best.where("__d IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("__d", "__at")).alias("__b"))
        added = F.when(F.col("__b").isNull(), F.col("picks")).otherwise(F.array_append("picks", F.col("__b.__at")))
        chosen = durable(chosen.join(best, keys, "left").withColumn("picks", added).drop("__b"))
    return chosen.select(*keys, F.posexplode("picks").alias("rank", "__p")).select(*keys, "rank", "__p.row", "__p.col")
