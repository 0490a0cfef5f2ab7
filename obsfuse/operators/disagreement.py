"""Overlap disagreement, the depth + disagreement variance model and row reliability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators.ranking import exact_quantiles
from obsfuse.runtime import attach, attach_few, durable, maybe_broadcast, placed

CELL = ["case_id", "frame", "row", "col"]
EDGE = ["case_id", "reference_id", "moving_id"]


@dataclass(frozen=True)
class VarianceModel:
    """Along-ray and lateral variance as floor + k depth^2 + gain/2 disagreement."""

    parallel_floor: float = 2.5e-4
    lateral_floor: float = 2.5e-4
    parallel_depth: float = 2.5e-5
    lateral_depth: float = 2.5e-5
    gain: float = 0.5
    parallel_scale: float = 1.0
    lateral_scale: float = 1.0


def with_rays(samples: DataFrame) -> DataFrame:
    """Unit ray from the stored direction, else from the point (zero at the origin)."""
    if "rx" in samples.columns:
        has = F.col("rx").isNotNull()
        raw = tuple(F.when(has, F.col(f"r{c}")).otherwise(F.col(c)).cast("double") for c in "xyz")
    else:
        raw = v3.vec()
    staged = samples.withColumns(dict(zip(("__ux", "__uy", "__uz"), raw, strict=True))).withColumn("__un", v3.norm(v3.vec("__u")))
    unit = {f"r{c}": F.when(F.col("__un") > 1e-12, F.col(f"__u{c}") / F.col("__un")).otherwise(F.lit(0.0)) for c in "xyz"}
    return staged.withColumns(unit).drop("__ux", "__uy", "__uz", "__un")


def pair_disagreement(pairs: DataFrame) -> DataFrame:
    """Add ``par`` and ``lat`` to correspondences joined with their transform.

    ``p*`` is the reference point, ``s*`` the moving point; ``pr*``/``sr*`` are stored
    rays when present, otherwise the point directions.
    """
    rot, s, t = sim3.rot_columns(), F.col("scale"), sim3.t_columns()
    target, source = v3.vec("p"), v3.vec("s")
    ref_ray = v3.vec("pr") if "prx" in pairs.columns else v3.unit(target)
    mov_ray = v3.mat_vec(rot, v3.vec("sr") if "srx" in pairs.columns else v3.unit(source))
    # staged: residual and rays, then their sum, then the split (each is read repeatedly)
    res = v3.sub(target, v3.apply_similarity(s, rot, t, source))
    one = pairs.select(
        *[c for c in pairs.columns if c not in {*sim3.GAUGE_COLUMNS}],
        *v3.named(res, ["__ex", "__ey", "__ez"]), *v3.named(ref_ray, ["__ax", "__ay", "__az"]), *v3.named(mov_ray, ["__bx", "__by", "__bz"]),
    )
    two = one.withColumns({f"__q{c}": F.col(f"__a{c}") + F.col(f"__b{c}") for c in "xyz"})
    two = two.withColumn("__n", v3.norm(v3.vec("__q")))
    ray = tuple(F.when(F.col("__n") > 1e-12, F.col(f"__q{c}") / F.col("__n")).otherwise(F.col(f"__a{c}")) for c in "xyz")
    e = v3.vec("__e")
    three = two.withColumns({"par": v3.dot(e, ray) ** 2, "__sq": v3.dot(e, e)})  # type: ignore[arg-type]
    kept = [c for c in pairs.columns if c not in {*sim3.GAUGE_COLUMNS}]
    return three.select(*kept, "par", (F.lit(0.5) * F.greatest(F.col("__sq") - F.col("par"), F.lit(0.0))).alias("lat"))


def accumulate(scored: DataFrame) -> DataFrame:
    """Credit every pair to both windows and sum per window cell."""
    side = F.explode(F.array("reference_id", "moving_id")).alias("window_id")
    return (
        scored.select(*CELL, side, "par", "lat")
        .groupBy("case_id", "window_id", "frame", "row", "col")
        .agg(F.sum("par").alias("par_sum"), F.sum("lat").alias("lat_sum"), F.count(F.lit(1)).alias("overlaps"))
        .withColumn("par_mean", F.col("par_sum") / F.col("overlaps"))
        .withColumn("lat_mean", F.col("lat_sum") / F.col("overlaps"))
    )


def accumulate_disagreement(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Disagreement evidence per window cell from fitted edges."""
    cols = [*EDGE, *sim3.GAUGE_COLUMNS]
    joined = attach_few(pairs, durable(edges.select(*cols)), EDGE, how="inner", salt_by=["frame", "row", "col"])
    return accumulate(pair_disagreement(joined))


def fold_assignment(pairs: DataFrame, folds: int = 4, seed: int = 0) -> DataFrame:
    """Give every (edge, cluster) a fold; folds are balanced by a seeded hash order.

    Works on the table of distinct clusters, which is small next to the pairs.
    """
    clusters = pairs.select(*EDGE, "cluster").distinct()
    w = W.partitionBy(*EDGE)
    draw = _fold_draw(seed)
    k = F.least(F.lit(folds), F.count(F.lit(1)).over(w))
    return clusters.select(
        *EDGE,
        "cluster",
        k.alias("fold_count"),
        F.pmod(F.row_number().over(w.orderBy(draw, "cluster")) - 1, k).cast("int").alias("fold"),
    )


def _fold_draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in EDGE], F.col("cluster"))


def cross_fitted_disagreement(
    pairs: DataFrame,
    folds: int = 4,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Score each cluster with a transform fitted on the other folds only.

    Returns (evidence, report).  A fold whose training set cannot be fitted is skipped;
    its cells simply receive no evidence.
    """
    from obsfuse.operators import align

    # one row for each cluster: the folds and the sizes of the edges come from it
    clusters = durable(pairs.groupBy(*EDGE, "cluster").agg(F.count(F.lit(1)).alias("n")))
    plan = fold_assignment(clusters, folds, seed)
    tagged = attach(pairs, plan, [*EDGE, "cluster"], how="inner", salt_by=["frame", "row", "col"])
    usable = tagged.where("fold_count >= 2")
    large = durable(clusters.groupBy(*EDGE).agg(F.sum("n").alias("n")).where(F.col("n") > align.GROUP_PAIRS).select(*EDGE))
    if large.isEmpty():
        fits = align.fit_held_folds(pairs, EDGE, folds, _fold_draw(seed))
    else:
        small = pairs.join(F.broadcast(large), EDGE, "left_anti")
        held = F.explode(F.sequence(F.lit(0), F.col("fold_count").cast("int") - 1)).alias("held_fold")
        training = usable.join(F.broadcast(large), EDGE, "left_semi").select("*", held).where("fold != held_fold")
        fits = align.fit_held_folds(small, EDGE, folds, _fold_draw(seed)).unionByName(align.fit_whole_edges(training, [*EDGE, "held_fold"]))
    fits = durable(fits)
    good = fits.where("status = 'ok'").select(*EDGE, F.col("held_fold").alias("fold"), *sim3.GAUGE_COLUMNS)
    scored = attach(usable, good, [*EDGE, "fold"], how="inner", salt_by=["frame", "row", "col"])
    evidence = accumulate(pair_disagreement(scored))
    report = (
        plan.groupBy(*EDGE).agg(F.max("fold_count").alias("fold_count"))
        .join(good.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("fitted_folds")), EDGE, "left")
        .fillna({"fitted_folds": 0})
        .select(
            *EDGE,
            F.when(F.col("fold_count") >= 2, F.col("fold_count")).otherwise(0).alias("candidate_folds"),
            "fitted_folds",
        )
        .withColumn("skipped_folds", F.col("candidate_folds") - F.col("fitted_folds"))
    )
    return evidence, report


def point_variances(
    samples: DataFrame, evidence: DataFrame | None, model: VarianceModel = VarianceModel(), depth2=None  # noqa: B008, ANN001
) -> DataFrame:
    """Add ``var_par``/``var_lat`` (and the disagreement means) to samples."""
    key = ["case_id", "window_id", "frame", "row", "col"]
    if evidence is None:
        j = samples.withColumns({"par_mean": F.lit(0.0), "lat_mean": F.lit(0.0), "overlaps": F.lit(0)})
    else:
        e = evidence.select(*key, "par_mean", "lat_mean", "overlaps")
        j = samples.join(e, key, "left").fillna({"par_mean": 0.0, "lat_mean": 0.0, "overlaps": 0})
    d2 = v3.dot(v3.vec(), v3.vec()) if depth2 is None else depth2
    half = 0.5 * model.gain
    par = (F.lit(model.parallel_floor) + F.lit(model.parallel_depth) * d2 + F.lit(half) * F.col("par_mean")) * F.lit(model.parallel_scale)
    lat = (F.lit(model.lateral_floor) + F.lit(model.lateral_depth) * d2 + F.lit(half) * F.col("lat_mean")) * F.lit(model.lateral_scale)
    tiny = F.lit(2.220446049250313e-16)
    return j.withColumns({"var_par": F.greatest(par, tiny), "var_lat": F.greatest(lat, tiny)})


def camera_centres(samples: DataFrame, keys: Sequence[str] = ("case_id", "window_id", "frame"), maximum_condition: float = 1e12) -> DataFrame:
    """Least-squares ray intersection per frame from mergeable sums, with a ``status`` for each frame.

    Solves (n I - sum r r^T)(c - mean) = sum (I - r r^T)(p - mean), many frames at once.  Needs three valid rays (else
    ``too-few-rays``) and a matrix whose condition, the ratio of its eigenvalues, is at most
    ``maximum_condition`` (else ``ill-conditioned``); such frames have a null centre.
    """
    keys = list(keys)
    on = F.coalesce(F.col("valid"), F.lit(False))
    p, r = v3.vec(), v3.vec("r")
    o = v3.outer_sym(r)
    along = v3.dot(r, p)
    b = tuple(pc - rc * along for pc, rc in zip(p, r, strict=True))
    sums = samples.groupBy(*keys).agg(
        F.sum(on.cast("double")).alias("n"),
        *[F.sum(F.when(on, c)).alias(f"o_{s}") for c, s in zip(o, v3.SYM, strict=True)],
        *[F.sum(F.when(on, c)).alias(f"b{a}") for c, a in zip(b, "xyz", strict=True)],
        *[F.avg(F.when(on, c)).alias(f"m{a}") for c, a in zip(p, "xyz", strict=True)],
    )
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rays bigint, status string, cx double, cy double, cz double"

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            outer = b[[f"o_{s}" for s in v3.SYM]].fillna(0.0).to_numpy(float)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            matrix = n[:, None, None] * np.eye(3) - outer
            mean, right = b[["mx", "my", "mz"]].to_numpy(float), b[["bx", "by", "bz"]].to_numpy(float)
            values = np.linalg.eigvalsh(matrix)
            enough = n >= 3
            good = enough & (values[:, 0] > 0) & (values[:, 2] <= maximum_condition * values[:, 0])
            centre = np.full((len(b), 3), np.nan)
            shift = right[good] - np.einsum("nij,nj->ni", matrix[good], mean[good])
            centre[good] = mean[good] + np.linalg.solve(matrix[good], shift[:, :, None])[:, :, 0]
            out = b[keys].assign(rays=n.astype("int64"), status=np.select([~enough, ~good], ["too-few-rays", "ill-conditioned"], "ok"))
            yield out.assign(**dict(zip(("cx", "cy", "cz"), centre.T, strict=True)))

    found = sums.mapInPandas(solved, schema)
    return found.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("cx", "cy", "cz")})


def ray_ranges(samples: DataFrame, centres: DataFrame, keys: Sequence[str] = ("case_id", "window_id", "frame")) -> DataFrame:
    """Range along the ray from the camera centre, with the residual tolerance check.

    ``range_ok`` is false where the range is negative or the perpendicular residual
    exceeds 1e-5 + 1e-5 max range of the frame.  Frames without a centre have no rows.
    """
    keys = list(keys)
    known = centres.where("status = 'ok'").select(*keys, "cx", "cy", "cz")
    j = attach(samples.where("valid"), known, keys, how="inner", salt_by=["row", "col"])
    off = v3.sub(v3.vec(), v3.vec("c"))
    along = v3.dot(off, v3.vec("r"))  # type: ignore[arg-type]
    # squares of nearly equal lengths would cancel, so the residual is the length of the difference
    perp = v3.norm(tuple(o - along * r for o, r in zip(off, v3.vec("r"), strict=True)))  # type: ignore[arg-type]
    r = j.select(*samples.columns, along.alias("range"), perp.alias("perp"))
    peak = r.groupBy(*keys).agg(F.max("range").alias("__peak"))
    out = attach(r, peak, keys, salt_by=["row", "col"])
    ok = (F.col("range") >= 0) & (F.col("perp") <= F.lit(1e-5) + F.lit(1e-5) * F.col("__peak"))
    return out.withColumn("range_ok", ok).drop("__peak")


def range_status(samples: DataFrame, keys: Sequence[str] = ("case_id", "window_id", "frame")) -> DataFrame:
    """One row per frame: its rays and ``ok``, ``too-few-rays``, ``ill-conditioned`` or ``inconsistent-rays``."""
    keys = list(keys)
    centres = camera_centres(samples, keys)
    bad = ray_ranges(samples, centres, keys).groupBy(*keys).agg(F.count_if(~F.col("range_ok")).alias("bad"))
    j = centres.join(bad, keys, "left")
    status = F.when((F.col("status") == "ok") & (F.col("bad") > 0), "inconsistent-rays").otherwise(F.col("status"))
    return j.select(*keys, "rays", F.coalesce("bad", F.lit(0)).alias("inconsistent"), status.alias("status"), "cx", "cy", "cz")


def range_variances(samples: DataFrame, evidence: DataFrame | None, model: VarianceModel = VarianceModel()) -> DataFrame:  # noqa: B008
    """Variance model with range^2 in place of the squared point norm, for the frames whose status is ``ok``."""
    good = range_status(samples).where("status = 'ok'").drop("inconsistent")
    ranged = ray_ranges(samples, good)
    return point_variances(ranged, evidence, model, F.col("range") * F.col("range"))


def prior_reliability(df: DataFrame, minimum: float = 0.05, name: str = "prior_reliability") -> DataFrame:
    """exp(-min(d, 50)/2) of the normalised disagreement; 1 without overlap."""
    norm = F.col("par_mean") / F.greatest(F.col("var_par"), F.lit(1e-12)) + F.col("lat_mean") / F.greatest(
        F.col("var_lat"), F.lit(1e-12)
    )
    value = F.when(F.col("overlaps") > 0, F.exp(F.lit(-0.5) * F.least(norm, F.lit(50.0)))).otherwise(F.lit(1.0))
    return df.withColumn(name, F.least(F.greatest(value, F.lit(minimum)), F.lit(1.0)))


#: Distance of two rows of pixels on the line on which neighbours are counted.
_LINE = 1 << 32


def _neighbours(frame: Sequence[str]) -> Column:
    """Rows of the 3 x 3 pixels around a row: three ranges on the line of pixels of its frame, which is sorted once."""
    line = W.partitionBy(*frame).orderBy(F.col("row").cast("bigint") * _LINE + F.col("col"))
    return sum((F.count(F.lit(1)).over(line.rangeBetween(at * _LINE - 1, at * _LINE + 1)) for at in (-1, 1)), F.count(F.lit(1)).over(line.rangeBetween(-1, 1)))


def reliability_features(df: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Seven source-only features per valid sample.

    ``df`` is the output of :func:`point_variances`; flow columns are optional.  Medians are exact per window, the 3 x 3
    neighbours are counted in sorted frames.  The samples are read once and written with what a frame knows;
    ``windows`` are rows that give the windows and their frames, where there are fewer than the samples.
    """
    key = ["case_id", "window_id"]
    cell = [*key, "frame", "row", "col"]
    total = F.col("var_par") + 2 * F.col("var_lat")
    known = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in cell]) == 0, _neighbours([*key, "frame"]))
    norm = F.col("par_mean") / F.greatest(F.col("var_par"), F.lit(1e-15)) + F.col("lat_mean") / F.greatest(
        F.col("var_lat"), F.lit(1e-15)
    )
    flow = [c for c in ("fx", "fy", "fz", "deform") if c in df.columns]
    valid = df.where("valid").select(
        *cell, *flow, total.alias("__total"), known.alias("__neighbours"), (F.col("overlaps") > 0).alias("__seen"), norm.alias("__norm")
    )
    valid = placed(valid)  # read by the medians and by the rows
    med = exact_quantiles(valid, key, "__total", {"__var_scale": 0.5}).drop("n")
    frames = (df if windows is None else windows).select(*key, "frame").distinct()
    fw = W.partitionBy(*key).orderBy("frame")
    span = W.partitionBy(*key)
    t = F.count(F.lit(1)).over(span).cast("double")
    i = (F.row_number().over(fw) - 1).cast("double")
    edge = F.when(t == 1, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.least(i, t - 1 - i) / F.greatest((t - 1) / 2.0, F.lit(1.0))
    )
    edges = frames.select(*key, "frame", edge.alias("temporal_edge"))
    j = attach_few(valid, durable(edges), [*key, "frame"], salt_by=["row", "col"])
    j = attach_few(j, durable(med), key, salt_by=["frame", "row", "col"])
    tiny = F.lit(2.2250738585072014e-308)
    if "fx" in df.columns:
        flow = v3.norm(v3.vec("f"))
        deform = F.coalesce(F.col("deform"), F.lit(False))
        fl = valid.where(deform).withColumn("__flow", flow).where(F.col("__flow") > 0)
        fmed = exact_quantiles(fl, key, "__flow", {"__flow_scale": 0.5}).drop("n")
        j = attach(j, fmed, key, salt_by=["frame", "row", "col"])
        has_flow = F.when(deform, F.lit(1.0)).otherwise(F.lit(0.0))
        log_flow = F.when(deform, F.log1p(flow / F.greatest(F.coalesce("__flow_scale", F.lit(1.0)), tiny))).otherwise(F.lit(0.0))
    else:
        has_flow = log_flow = F.lit(0.0)
    return j.select(
        *cell,
        F.when(F.col("__seen"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("has_overlap"),
        F.when(F.col("__seen"), F.log1p(F.greatest(F.col("__norm"), F.lit(0.0)))).otherwise(F.lit(0.0)).alias("log_disagreement"),
        F.least(F.greatest(F.col("temporal_edge"), F.lit(0.0)), F.lit(1.0)).alias("temporal_edge"),
        F.log(F.greatest(F.col("__total") / F.greatest(F.col("__var_scale"), tiny), tiny)).alias("log_relative_variance"),
        has_flow.alias("has_flow"),
        log_flow.alias("log_relative_flow"),
        (F.lit(1.0) - F.coalesce("__neighbours", F.lit(0)) / F.lit(9.0)).alias("validity_deficit"),
    )


def flow_displacement(samples: DataFrame, keys: Sequence[str] = ("case_id", "window_id")) -> DataFrame:
    """Flow at t against the displacement to t + 1 on the same pixel.

    The next frame is reached with an equi-join on frame - 1, so the work is spread by
    pixel and frame instead of one window per track.
    """
    cell = [*keys, "frame", "row", "col"]
    now = samples.where("valid AND deform")
    nxt = samples.where("valid").select(
        *keys, (F.col("frame") - 1).alias("frame"), "row", "col", *[F.col(c).alias(f"n{c}") for c in "xyz"]
    )
    j = now.join(nxt, cell)
    disp, flow = v3.sub(v3.vec("n"), v3.vec()), v3.vec("f")
    nd, nf = v3.norm(disp), v3.norm(flow)  # type: ignore[arg-type]
    gap = v3.norm(v3.sub(disp, flow))  # type: ignore[arg-type]
    both, eps = nd + nf, F.lit(2.220446049250313e-16)
    rel = F.when(both > eps, gap / both).otherwise(F.lit(0.0))
    cos = F.when((nd > eps) & (nf > eps), v3.dot(disp, flow) / (nd * nf)).otherwise(F.lit(1.0))  # type: ignore[arg-type]
    cos = F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))
    return j.select(
        *cell, rel.alias("relative_gap"), (F.lit(0.5) * (1 - cos)).alias("angular_gap"), F.log1p(rel).alias("log_gap")
    )
