"""Robust similarity fits and their covariance, from weighted sums.

With z = (1, x, y, z) of a source point and r its residual, everything a fit needs is a sum over
rows: the Gram matrix of (z, target) gives the transform, the Gram matrix of z the information, and
the sums of z r by cluster the score covariance. The two forms share these sums:

* ``fit_edges``: one edge per group, for edges whose size the caller bounds;
* ``fit_edges_distributed``: edges of any size; each iteration is one aggregation per edge and two
  exact medians, the covariance one more aggregation by cluster. Only 3x3 to 7x7 problems leave
  the row pass, and every edge that enters comes out with a status.

``fit_whole_edges`` takes each edge by the form that its size allows, always with all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators.ranking import exact_quantiles
from obsfuse.runtime import attach, durable

EPS = np.finfo(float).eps
# Added to every covariance, in the order of the seven parameters.
COV_FLOOR = np.diag([1e-10] * 4 + [1e-12] * 3)
#: Weights at or below this one do not count as active.
ACTIVE = 1e-3
#: Pairs of the largest edge that `fit_whole_edges` puts into one group; larger ones are fitted by sums.
GROUP_PAIRS = 100_000
FIT_COLUMNS = (
    sim3.GAUGE_SCHEMA
    + ", cov array<double>, rms double, inlier_fraction double, n bigint, clusters bigint,"
    " covariance_method string, iterations int, status string"
)
FIT_NAMES = [c.strip().split()[0] for c in FIT_COLUMNS.split(",")]


class FitError(ValueError):
    """A point set that has no fit; the message becomes the status of its row."""


def similarity(gram: np.ndarray) -> sim3.Transform:
    """The similarity of least squares from the 7x7 Gram matrix of (1, source, target).

    The rotation is the largest eigenvector of the quaternion form of the cross moments.
    """
    total = gram[0, 0]
    if not total > EPS:
        raise FitError("no weight is left")
    mean = gram[0, 1:] / total
    central = gram[1:, 1:] / total - np.outer(mean, mean)
    spread, m = np.trace(central[:3, :3]), central[:3, 3:]
    if not spread > EPS:
        raise FitError("the source points coincide")
    twist = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
    form = np.zeros((4, 4))
    form[0, 0], form[0, 1:], form[1:, 0] = np.trace(m), twist, twist
    form[1:, 1:] = m + m.T - np.trace(m) * np.eye(3)
    w, x, y, z = np.linalg.eigh(form)[1][:, -1]
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    r = np.eye(3) + 2 * (w * cross + cross @ cross)
    scale = float((r * m.T).sum() / spread)
    if not (np.isfinite(scale) and scale > 0):
        raise FitError("no positive scale fits")
    return scale, r, mean[3:] - scale * (r @ mean[:3])


def _affine(t: sim3.Transform) -> np.ndarray:
    """The transform as a 3x4 matrix on (1, x, y, z)."""
    return np.column_stack([t[2], t[0] * t[1]])


def relative_motion(gram: np.ndarray, old: sim3.Transform, new: sim3.Transform) -> float:
    """RMS motion of a cloud between two transforms over its transformed size, from the Gram matrix of (1, source)."""
    n, before, change = gram[0, 0], _affine(old), _affine(new) - _affine(old)
    centre = before @ gram[:, 0] / n
    size = np.trace(before @ gram @ before.T) / n - centre @ centre
    return float(np.sqrt(max(np.trace(change @ gram @ change.T), 0.0) / n) / max(np.sqrt(max(size, 0.0)), EPS))


def cutoff(median: float, deviation: float, huber: float) -> float:
    return max(median + huber * max(1.4826 * deviation, EPS), EPS)


def finished(t: sim3.Transform, centre: np.ndarray, sums: dict) -> dict:
    """Covariance and statistics of a fit from its sums over rows (source points less ``centre``).

    ``gram`` (4x4): sum of w z z'; ``points`` (4,3,4,3): sum of w^2 z r z r over active rows;
    ``meat`` (7x7) and ``clusters``: summed by cluster, None and 0 without clusters; ``square``: sum of
    w |r|^2; ``weight``, ``active``, ``inliers``, ``n``.
    """
    basis = _centred_basis(t, centre)
    info = np.einsum("ab,aik,bil->kl", sums["gram"], basis, basis)
    size = np.linalg.svd(info, compute_uv=False)
    if (size > max(size[0] * 1e-10, EPS)).sum() < 7:
        raise FitError("the points do not fix all seven parameters")
    active, clusters, meat, method = int(sums["active"]), int(sums["clusters"]), sums["meat"], "cluster_robust"
    if meat is None:
        method, clusters = "iid", active
    elif clusters <= 7:
        method, clusters, meat = "iid_fallback", active, None
        if active > 7:
            method, meat = "pointwise_fallback", np.einsum("aibj,aik,bjl->kl", sums["points"], basis, basis)
    inverse = np.linalg.inv(info)
    if meat is None:
        cov = inverse * (sums["square"] / max(1, 3 * active - 7))
    else:
        cov = inverse @ meat @ inverse * (clusters / (clusters - 1) * (active - 1) / max(active - 7, 1))
    return {
        **sim3.pack(t),
        "cov": (0.5 * (cov + cov.T) + COV_FLOOR).ravel().tolist(),
        "rms": float(np.sqrt(sums["square"] / max(sums["weight"], EPS))),
        "inlier_fraction": float(sums["inliers"] / sums["n"]),
        "n": int(sums["n"]),
        "clusters": clusters,
        "covariance_method": method,
        "status": "ok",
    }


def _centred_basis(t: sim3.Transform, centre: np.ndarray) -> np.ndarray:
    basis = sim3.jacobian_basis(t).copy()
    basis[0] += np.einsum("k,kij->ij", centre, basis[1:])
    return basis


def fit_points(
    src: np.ndarray, dst: np.ndarray, weights: np.ndarray | None = None, clusters: np.ndarray | None = None,
    max_iterations: int = 64, huber: float = 2.5, tolerance: float = 1e-8, fallback: str = "pointwise",
) -> dict:
    """Reweighted Huber fit of one bounded point set; raises `FitError` when there is none."""
    ok = np.isfinite(src).all(axis=1) & np.isfinite(dst).all(axis=1)
    src, dst = src[ok], dst[ok]
    if len(src) < 4:
        raise FitError("less than four pairs of points")
    base = np.ones(len(src)) if weights is None else weights[ok]
    centre = src.mean(axis=0)
    z = np.column_stack([np.ones(len(src)), src - centre])
    both = np.column_stack([z, dst])
    cloud, w, last = (z.T * base) @ z, base, None
    for iteration in range(1, max_iterations + 1):
        local = similarity((both.T * w) @ both)
        r = dst - z @ _affine(local).T
        norm = np.sqrt((r * r).sum(axis=1))
        cut = cutoff(np.median(norm), np.median(np.abs(norm - np.median(norm))), huber)
        if last is not None and relative_motion(cloud, last, local) < tolerance:
            break
        last, w = local, base * np.minimum(1.0, cut / np.maximum(norm, cut))
    else:
        raise FitError("the iteration limit was reached")
    active = w > ACTIVE
    t = (local[0], local[1], local[2] - local[0] * (local[1] @ centre))
    pull = ((w[:, None] * z)[:, :, None] * r[:, None, :])[active]
    flat = pull.reshape(-1, 12)
    meat, count = None, 0
    if clusters is not None:
        names, of = np.unique(clusters[ok][active], return_inverse=True)
        count = len(names)
        if count <= 7 and fallback == "error":
            raise FitError("less than eight clusters")
        each = np.stack([np.bincount(of, column, count) for column in flat.T], axis=1).reshape(count, 4, 3)
        score = np.einsum("cai,aik->ck", each, _centred_basis(t, centre))
        meat = score.T @ score
    sums = {
        "gram": (z.T * w) @ z, "points": (flat.T @ flat).reshape(4, 3, 4, 3), "meat": meat, "clusters": count,
        "square": float(w @ norm**2), "weight": w.sum(), "active": active.sum(), "inliers": (norm <= cut).sum(), "n": len(src),
    }
    return finished(t, centre, sums) | {"iterations": iteration}


#: status of an edge that has more pairs than a group may hold.
LARGE = "large"


def fit_edges(pairs: DataFrame, keys: Sequence[str], most: int | None = None, seed: int = 0, limit: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """One robust fit per key, a key in one group.  Failures become a ``status`` row, never a silent fit.

    ``most`` is the number of pairs that a fit uses (a seeded sample of each key; the pairs
    themselves stay whole for whatever else reads them). Without it the caller vouches for the
    size of the groups, or gives a ``limit``: a key with more pairs is not fitted and has the status ``LARGE``;
    :func:`fit_edges_distributed` needs no bound.
    """
    from obsfuse.operators.ranking import subsample

    keys = list(keys)
    schema = f"{_types(pairs, keys)}, {FIT_COLUMNS}"
    clustered = "cluster" in pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            n += batch.num_rows
            held = [*held, batch] if limit is None or n <= limit else [*held, batch][:1]
        table = pa.Table.from_batches(held)
        if limit is not None and n > limit:
            fit = dict.fromkeys(FIT_NAMES) | {"n": n, "status": LARGE}
        else:
            src, dst, (clusters,) = _ordered(table, ["cluster"] if clustered else [None])
            fit = _fit_or_status(src, dst, clusters, **options)
        yield from _fit_rows(table, keys, [fit]).to_batches()

    if most is not None:
        pairs = subsample(pairs, keys, [c for c in ("frame", "row", "col") if c in pairs.columns], most, seed)
    need = [*keys, "sx", "sy", "sz", "px", "py", "pz", *(["cluster"] if clustered else [])]
    return pairs.select(*dict.fromkeys(need)).groupBy(*keys).applyInArrow(run, schema)


def _ordered(table: pa.Table, extra: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Source points, target points and ``extra`` columns of a group, in an order that the shuffle does not change."""
    points = [table.column(c).to_numpy().astype(float) for c in ("px", "py", "pz", "sx", "sy", "sz")]
    order = np.lexsort(points[::-1])
    both = np.column_stack(points)[order]
    return both[:, 3:], both[:, :3], [None if c is None else table.column(c).to_numpy()[order] for c in extra]


def _fit_or_status(src: np.ndarray, dst: np.ndarray, clusters: np.ndarray | None, **options) -> dict:  # noqa: ANN003
    try:
        return fit_points(src, dst, clusters=clusters, **options)
    except (FitError, np.linalg.LinAlgError) as error:
        return dict.fromkeys(FIT_NAMES) | {"n": len(src), "status": str(error)}


def _fit_rows(table: pa.Table, keys: Sequence[str], rows: list[dict], more: Mapping[str, pa.Array] | None = None) -> pa.Table:
    """Fits of one group as a table: its keys, ``more`` columns, then the columns of a fit."""
    first = pa.array(np.zeros(len(rows), dtype=np.int64))
    columns = {k: table.column(k).take(first) for k in keys} | dict(more or {})
    kinds = {"cov": pa.list_(pa.float64()), "n": pa.int64(), "clusters": pa.int64(), "iterations": pa.int32(), "covariance_method": pa.string(), "status": pa.string()}
    return pa.table(columns | {c: pa.array([r[c] for r in rows], kinds.get(c, pa.float64())) for c in FIT_NAMES})


def fit_held_folds(pairs: DataFrame, keys: Sequence[str], folds: int, draw: Column, **options) -> DataFrame:  # noqa: ANN003
    """For each key and each of its folds a fit on the clusters of all other folds; a key in one group.

    The clusters of a key take its folds in turn by (``draw``, cluster), as in `disagreement.fold_assignment`. So a pair
    is shuffled once, not once for each fold that it trains. Keys with one cluster have no rows.
    """
    keys = list(keys)

    def run(table: pa.Table) -> pa.Table:
        src, dst, (clusters, draws) = _ordered(table, ["cluster", "__draw"])
        names, at, of = np.unique(clusters, return_index=True, return_inverse=True)
        count = min(folds, len(names))
        turn = np.empty(len(names), dtype=np.int64)
        turn[np.lexsort((names, draws[at]))] = np.arange(len(names))
        fold = (turn % count)[of]
        held = range(count) if count > 1 else []
        rows = [_fit_or_status(src[fold != f], dst[fold != f], clusters[fold != f], **options) for f in held]
        return _fit_rows(table, keys, rows, {"held_fold": pa.array(list(held), pa.int32())})

    need = [*keys, "sx", "sy", "sz", "px", "py", "pz", "cluster", draw.alias("__draw")]
    return pairs.select(*need).groupBy(*keys).applyInArrow(run, f"{_types(pairs, keys)}, held_fold int, {FIT_COLUMNS}")


def _z() -> list[Column]:
    return [F.lit(1.0), *(F.col(f"u{a}") for a in "xyz")]


_GRAM = [(a, b) for a in range(7) for b in range(a, 7)]


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _solved(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transforms on centred source points from Gram sums; ``trouble`` says why there is none."""
    schema = f"{_types(sums, keys)}, {sim3.GAUGE_SCHEMA}, trouble string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                gram = np.zeros((7, 7))
                for i, j in _GRAM:
                    gram[i, j] = gram[j, i] = r[f"g{i}{j}"]
                try:
                    row = {**sim3.pack(similarity(gram)), "trouble": None}
                except (FitError, np.linalg.LinAlgError) as error:
                    row = {**dict.fromkeys(sim3.GAUGE_COLUMNS), "trouble": str(error)}
                rows.append({**{k: r[k] for k in keys}, **row})
            yield pd.DataFrame(rows, columns=[*keys, *sim3.GAUGE_COLUMNS, "trouble"])

    return sums.mapInPandas(run, schema)


def _distance(prefix: str = "") -> Column:
    moved = v3.apply_similarity(F.col(f"{prefix}scale"), sim3.rot_columns(prefix), sim3.t_columns(prefix), v3.vec("u"))
    return v3.norm(v3.sub(v3.vec("p"), moved))  # type: ignore[arg-type]


def fit_edges_distributed(
    pairs: DataFrame, keys: Sequence[str], max_iterations: int = 64, huber: float = 2.5, tolerance: float = 1e-8
) -> DataFrame:
    """The fit of :func:`fit_edges`, with its covariance, for edges of any size; one row per key.

    Edges leave the loop when they have converged or failed. Between iterations only one row per
    edge is kept, in reliable storage: weights follow from the previous transform and cut-off.
    """
    keys = list(keys)
    clustered = "cluster" in pairs.columns
    finite = " AND ".join(f"NOT isnan({s}{a}) AND abs({s}{a}) < double('inf')" for s in "sp" for a in "xyz")
    good = pairs.where(finite)
    centres = durable(good.groupBy(*keys).agg(*[F.avg(f"s{a}").alias(f"c{a}") for a in "xyz"], F.count(F.lit(1)).alias("n")))
    few = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("all")).join(centres, keys, "left").where("coalesce(n, 0) < 4")
    lost = [few.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.lit("less than four pairs of points").alias("status"), F.lit(0).alias("iterations"))]
    columns = [*keys, "px", "py", "pz", *(["cluster"] if clustered else [])]
    rows = attach(good.select(*columns, "sx", "sy", "sz"), centres.where("n >= 4"), keys, how="inner")
    rows = durable(rows.select(*columns, *[(F.col(f"s{a}") - F.col(f"c{a}")).alias(f"u{a}") for a in "xyz"]))
    both = [*_z(), *(F.col(f"p{a}") for a in "xyz")]
    grams = [F.sum(F.col("w") * both[i] * both[j]).alias(f"g{i}{j}") for i, j in _GRAM]
    state: DataFrame | None = None
    done: list[DataFrame] = []
    for iteration in range(1, max_iterations + 1):
        if state is None:
            weighted = rows.withColumn("w", F.lit(1.0))
        else:
            weighted = attach(rows, state.select(*keys, *sim3.GAUGE_COLUMNS, "cut"), keys, how="inner")
            weighted = weighted.withColumn("w", F.least(F.lit(1.0), F.col("cut") / F.greatest(_distance(), F.col("cut"))))
        solved = durable(_solved(weighted.groupBy(*keys).agg(*grams), keys))
        bad = solved.where("trouble IS NOT NULL").join(centres, keys)
        lost.append(bad.select(*keys, "n", F.col("trouble").alias("status"), F.lit(iteration).alias("iterations")))
        fit = solved.where("trouble IS NULL").drop("trouble")
        res = attach(rows, fit, keys, how="inner").select(*keys, _distance().alias("r"))
        med = exact_quantiles(res, keys, "r", {"med": 0.5}).drop("n")
        dev = attach(res, med, keys).withColumn("a", F.abs(F.col("r") - F.col("med")))
        mad = exact_quantiles(dev, keys, "a", {"mad": 0.5}).drop("n")
        cut = F.greatest(F.col("med") + huber * F.greatest(1.4826 * F.col("mad"), F.lit(EPS)), F.lit(EPS))
        now = fit.join(med, keys).join(mad, keys).withColumn("cut", cut).drop("med", "mad").withColumn("iterations", F.lit(iteration))
        if state is None:
            now = now.withColumn("motion", F.lit(float("inf")))
        else:
            old = state.select(*keys, *[F.col(c).alias(f"o_{c}") for c in sim3.GAUGE_COLUMNS], F.col("cut").alias("o_cut"))
            now = now.join(old, keys).join(_motion(rows, old, now, keys), keys)
        now = durable(now)
        done += [now.where(F.col("motion") < tolerance)] if state is not None else []
        state = now.where(F.col("motion") >= tolerance)
        if state.isEmpty():
            break
    if state is not None:
        late = state.join(centres, keys)
        lost.append(late.select(*keys, "n", F.lit("the iteration limit was reached").alias("status"), "iterations"))
    failed = lost[0]
    for part in lost[1:]:
        failed = failed.unionByName(part)
    out = failed.select(*keys, *[F.col(c) if c in ("n", "status", "iterations") else F.lit(None).alias(c) for c in FIT_NAMES])
    schema = f"{_types(pairs, keys)}, {FIT_COLUMNS}"
    out = out.select(*[F.col(c).cast(kind) for c, kind in _pairs_of(schema)])
    if not done:
        return out
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    return _with_covariance(rows, durable(final), centres, keys, clustered, schema).unionByName(out)


def fit_whole_edges(pairs: DataFrame, keys: Sequence[str], **options) -> DataFrame:  # noqa: ANN003
    """One robust fit per key on all its pairs: in one group up to ``GROUP_PAIRS``, by sums above.

    The pairs are read once unless an edge has more of them: such a group only says so, and holds no more than a first fit does.
    """
    keys = list(keys)
    fits = durable(fit_edges(pairs, keys, limit=GROUP_PAIRS, **options))
    large = fits.where(F.col("status") == LARGE).select(*keys)
    if large.isEmpty():
        return fits
    # one row for each large edge: few beside the pairs
    rest = pairs.join(F.broadcast(large), keys, "left_semi")
    return fits.where(F.col("status") != LARGE).unionByName(fit_edges_distributed(rest, keys, **options))


def _pairs_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().replace("`", "").split(" ", 1)) for part in schema.split(", ")]  # type: ignore[misc]


def _motion(rows: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMS motion of the transformed cloud divided by its size, from one aggregation."""
    j = attach(rows, old.join(new.select(*keys, *sim3.GAUGE_COLUMNS), list(keys)), keys, how="inner")
    a = v3.apply_similarity(F.col("o_scale"), sim3.rot_columns("o_"), sim3.t_columns("o_"), v3.vec("u"))
    b = v3.apply_similarity(F.col("scale"), sim3.rot_columns(), sim3.t_columns(), v3.vec("u"))
    d = v3.sub(b, a)
    agg = j.groupBy(*keys).agg(
        F.avg(v3.dot(d, d)).alias("d2"), *[F.var_pop(c).alias(f"v{n}") for c, n in zip(a, "xyz", strict=True)]  # type: ignore[arg-type]
    )
    size = F.sqrt(F.col("vx") + F.col("vy") + F.col("vz"))
    return agg.select(*keys, (F.sqrt("d2") / F.greatest(size, F.lit(EPS))).alias("motion"))


_ZZ = [(a, b) for a in range(4) for b in range(a, 4)]
_RR = [(i, j) for i in range(3) for j in range(i, 3)]


def _with_covariance(
    rows: DataFrame, final: DataFrame, centres: DataFrame, keys: list[str], clustered: bool, schema: str
) -> DataFrame:
    """Sums by (edge, cluster), score products by edge, then one 7x7 problem for each edge."""
    j = attach(rows, final.drop("motion"), keys, how="inner")
    moved = v3.apply_similarity(F.col("scale"), sim3.rot_columns(), sim3.t_columns(), v3.vec("u"))
    weight = F.least(F.lit(1.0), F.col("o_cut") / F.greatest(_distance("o_"), F.col("o_cut")))
    j = j.select(
        *keys, "cut", *(["cluster"] if clustered else []), "ux", "uy", "uz", weight.alias("w"),
        *[(F.col(f"p{a}") - m).alias(f"r{i}") for i, (a, m) in enumerate(zip("xyz", moved, strict=True))],
    )
    z = _z()
    on, r = (F.col("w") > ACTIVE).cast("double"), [F.col(f"r{i}") for i in range(3)]
    square = sum((c * c for c in r[1:]), r[0] * r[0])
    sums = {f"G{a}{b}": F.col("w") * z[a] * z[b] for a, b in _ZZ}
    sums |= {f"H{a}{i}": on * F.col("w") * z[a] * r[i] for a in range(4) for i in range(3)}
    sums |= {f"P{a}{b}{i}{k}": on * F.col("w") * F.col("w") * z[a] * z[b] * r[i] * r[k] for a, b in _ZZ for i, k in _RR}
    sums |= {"square": F.col("w") * square, "weight": F.col("w"), "active": on, "inliers": (F.sqrt(square) <= F.col("cut")).cast("double")}
    by_cluster = j.groupBy(*keys, *(["cluster"] if clustered else [])).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    small = final.select(*keys, *sim3.GAUGE_COLUMNS, "iterations").join(centres, keys)
    by_cluster = attach(by_cluster, small, keys, how="inner", salt_by=["cluster"] if clustered else keys)
    names = [n for n in sums if n[0] != "H"]
    meat = [f"m{a}{b}" for a in range(7) for b in range(a, 7)]
    heads = [*sim3.GAUGE_COLUMNS, "iterations", "cx", "cy", "cz", "n"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, *heads, *names]].copy()
            products = np.zeros((len(b), 7, 7))
            for k, row in enumerate(b.to_dict("records")):
                pull = np.array([[row[f"H{a}{i}"] for i in range(3)] for a in range(4)])
                score = np.einsum("ai,aik->k", pull, _centred_basis(*_global(row)))
                products[k] = np.outer(score, score)
            out["clusters"] = (b["active"] > 0).astype(float)
            for name in meat:
                out[name] = products[:, int(name[1]), int(name[2])]
            yield out

    kinds = _types(final, keys) + ", " + sim3.GAUGE_SCHEMA + ", iterations int, cx double, cy double, cz double, n bigint"
    extra = "".join(f", {n} double" for n in [*names, "clusters", *meat])
    edges = by_cluster.mapInPandas(scored, kinds + extra)
    edges = edges.groupBy(*keys, *heads).agg(*[F.sum(n).alias(n) for n in [*names, "clusters", *meat]])

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows_ = []
            for row in b.to_dict("records"):
                gram, points, product = np.zeros((4, 4)), np.zeros((4, 3, 4, 3)), np.zeros((7, 7))
                for a, c in _ZZ:
                    gram[a, c] = gram[c, a] = row[f"G{a}{c}"]
                    for i, k in _RR:
                        points[a, i, c, k] = points[c, i, a, k] = points[a, k, c, i] = points[c, k, a, i] = row[f"P{a}{c}{i}{k}"]
                for name in meat:
                    product[int(name[1]), int(name[2])] = product[int(name[2]), int(name[1])] = row[name]
                t, centre = _global(row)
                have = {**row, "gram": gram, "points": points, "meat": product if clustered else None}
                try:
                    fit = finished(t, centre, have)
                except (FitError, np.linalg.LinAlgError) as error:
                    fit = dict.fromkeys(FIT_NAMES) | {"n": row["n"], "status": str(error)}
                rows_.append({**{k: row[k] for k in keys}, **fit, "iterations": row["iterations"]})
            yield pd.DataFrame(rows_, columns=[*keys, *FIT_NAMES])

    return edges.mapInPandas(closed, schema)


def _global(row: dict) -> tuple[sim3.Transform, np.ndarray]:
    """The transform for source points as given, and the centre that was taken off them."""
    scale, r, t = sim3.unpack(row)
    centre = np.array([row["cx"], row["cy"], row["cz"]])
    return (scale, r, t - scale * (r @ centre)), centre


def align_windows(samples: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Correspondence join plus one robust fit on all pairs of every two windows of a case."""
    from obsfuse.operators.joins import overlap_correspondences

    pairs = overlap_correspondences(samples, options.pop("cluster_size", 32))
    return fit_edges_distributed(pairs, ["case_id", "reference_id", "moving_id"], **options)


def metric_anchor(samples: DataFrame, truth: DataFrame, fit_end: int, **options) -> DataFrame:  # noqa: ANN003
    """Fit each case to metric truth with all frames before ``fit_end``."""
    key = ["case_id", "frame", "row", "col"]
    t = truth.where("valid").where(F.col("frame") < fit_end).select(*key, *[F.col(c).alias(f"p{c}") for c in "xyz"])
    p = samples.where("valid").select(*key, "window_id", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    return fit_whole_edges(p.join(t, key), ["case_id", "window_id"], **options)


def two_point_scale(anchors: DataFrame, keys: Sequence[str] = ("case_id", "window_id")) -> DataFrame:
    """Scale from the known distance of two points: known / measured."""
    gap = v3.norm(v3.sub(v3.vec("a"), v3.vec("b")))  # type: ignore[arg-type]
    return anchors.select(*keys, (F.col("distance") / gap).alias("scale"), (F.col("sd") / gap).alias("scale_sd"))
