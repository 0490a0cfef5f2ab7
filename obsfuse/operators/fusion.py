"""Fusion of duplicate Gaussian estimates under different correlation assumptions.

Input rows ("estimates"): cell keys, ``contributor``, mean x/y/z, covariance c_xx..c_zz.
Any DataFrame of that shape can be fused, whatever loader produced it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.runtime import attach, attach_few, durable, placed

INFO = [f"i_{s}" for s in v3.SYM]
MEAN = ["x", "y", "z"]
COV = [f"c_{s}" for s in v3.SYM]


def ci_weight_grid(size: int = 21, minimum: float = 0.0) -> list[float]:
    """Weight grid, visited nearest to one half first."""
    grid = np.linspace(minimum, 1.0 - minimum, size)
    return [float(w) for w in grid[np.argsort(np.abs(grid - 0.5), kind="stable")]]


def information(df: DataFrame) -> DataFrame:
    """Add the six information entries of the packed covariance.

    Well-conditioned rows use the closed form; the few others go through an
    eigenvalue floor of 1e-12.  Rows stay where they are.
    """
    staged = df.withColumn("__bad", F.coalesce(v3.ill_conditioned(v3.sym()), F.lit(True)))
    # the closed form sees the identity in place of the others
    safe = {f"__c_{s}": F.when(F.col("__bad"), F.lit(1.0 if s[0] == s[1] else 0.0)).otherwise(F.col(f"c_{s}")) for s in v3.SYM}
    staged = staged.withColumns({**safe, "__floored": F.when(F.col("__bad"), v3.floored_inverse(v3.sym()))})
    both = v3.with_inverse(staged, "__c_", "__i_")
    info = {f"i_{s}": F.when(F.col("__bad"), F.col("__floored")[k]).otherwise(F.col(f"__i_{s}")) for k, s in enumerate(v3.SYM)}
    return both.select(*df.columns, *[c.alias(n) for n, c in info.items()])


def _finish(info_sums: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Sums of information and information vectors -> mean and covariance.

    Cells with one contributor keep their own mean and covariance unchanged.
    """
    cov = v3.sym("v_")
    mean = v3.sym_vec(cov, v3.vec("q_"))
    single = F.col("contributors") == 1
    return v3.with_inverse(info_sums, "s_", "v_").select(
        *keys,
        *[F.when(single, F.col(f"only_{n}")).otherwise(c).alias(n) for n, c in zip(MEAN, mean, strict=True)],
        *[F.when(single, F.col(f"only_{n}")).otherwise(c).alias(n) for n, c in zip(COV, cov, strict=True)],
        F.col("contributors").cast("int").alias("contributors"),
        *extra,
    )


def _information_sums(weight: Column) -> list[Column]:
    info = tuple(F.col(c) for c in INFO)
    iv = v3.sym_vec(info, v3.vec())
    return [
        *[F.sum(weight * c).alias(f"s_{s}") for c, s in zip(info, v3.SYM, strict=True)],
        *[F.sum(weight * c).alias(f"q_{a}") for c, a in zip(iv, "xyz", strict=True)],
        F.count(F.lit(1)).alias("contributors"),
        *[F.max(c).alias(f"only_{c}") for c in (*MEAN, *COV)],
    ]


def fuse_uniform(est: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of means; covariance is the mixture second moment."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return est.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in MEAN],
        *[
            (F.avg(f"c_{s}") + F.covar_pop(a, b)).alias(f"c_{s}")
            for s, (a, b) in zip(v3.SYM, pairs, strict=True)
        ],
        F.count(F.lit(1)).cast("int").alias("contributors"),
    )


def fuse_precision(est: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Information sum, which assumes independent contributors."""
    return _finish(information(est).groupBy(*keys).agg(*_information_sums(F.lit(1.0))), keys)


def _with_pattern(est: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cell: contributor-sorted array of estimates and their id pattern.

    An array holds at most one entry per window that sees the cell.
    """
    fields = ["contributor", *MEAN, *COV, *INFO]
    cells = information(est).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("members")
    )
    return cells.withColumn("pattern", F.transform("members", lambda m: m["contributor"].cast("string")))


def _split_pair(cells: DataFrame) -> DataFrame:
    """Information of both members as scalar columns a_i_*, b_i_*."""
    return cells.withColumns({f"{s}_{i}": F.col("members")[k][i] for k, s in enumerate("ab") for i in INFO})


def _mixed_log_det(df: DataFrame, w: Column, name: str) -> DataFrame:
    """Add -log det(w A + (1 - w) B); the mix is staged before its determinant."""
    mixed = {f"__m_{s}": w * F.col(f"a_i_{s}") + (F.lit(1.0) - w) * F.col(f"b_i_{s}") for s in v3.SYM}
    return df.withColumns(mixed).withColumn(name, -F.log(v3.det(v3.sym("__m_")))).drop(*mixed)


def _first_improvement(entries: Column) -> Column:
    """Fold (visit, score, weight) entries: replace only on an improvement over 1e-12."""
    start = F.struct(F.lit(float("inf")).alias("score"), F.lit(0.5).alias("weight"))

    def step(acc: Column, e: Column) -> Column:
        better = e["score"] < acc["score"] - F.lit(1e-12)
        return F.struct(
            F.when(better, e["score"]).otherwise(acc["score"]).alias("score"),
            F.when(better, e["weight"]).otherwise(acc["weight"]).alias("weight"),
        )

    return F.aggregate(F.array_sort(entries), start, step, lambda acc: acc["weight"])


def pair_weights(cells: DataFrame, groups: Sequence[str], grid_size: int = 21, minimum: float = 0.0) -> DataFrame:
    """Global two-contributor weight per group: minimise the mean log determinant.

    det(w A + (1 - w) B) is a cubic in w whose coefficients are taken once per row, so the whole grid is one
    aggregation of ``grid_size`` means over rows that are not multiplied.
    """
    grid = list(ci_weight_grid(grid_size, minimum))
    a, b = v3.sym("a_i_"), v3.sym("b_i_")
    staged = _split_pair(cells).select(
        *groups, *v3.named_sym(b, "b_i_"), *v3.named_sym(tuple(x - y for x, y in zip(a, b, strict=True)), "d_i_")  # type: ignore[arg-type]
    )
    b, d = v3.sym("b_i_"), v3.sym("d_i_")

    def paired(m: v3.Sym, n: v3.Sym) -> Column:
        """tr(adj(m) n)"""
        xx, xy, xz, yy, yz, zz = m
        adj = (yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - yy * xz, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)
        return sum((k * p * q for k, p, q in zip((1.0, 2.0, 2.0, 1.0, 2.0, 1.0), adj, n, strict=True)), F.lit(0.0))

    cubic = staged.select(*groups, v3.det(b).alias("__0"), paired(b, d).alias("__1"), paired(d, b).alias("__2"), v3.det(d).alias("__3"))

    def mean(w: float) -> Column:
        det = F.col("__0") + F.lit(w) * (F.col("__1") + F.lit(w) * (F.col("__2") + F.lit(w) * F.col("__3")))
        return F.avg(-F.log(det))

    means = cubic.groupBy(*groups).agg(*[mean(w).alias(f"__g{i}") for i, w in enumerate(grid)])
    entries = F.array(*[F.struct(F.lit(i).alias("visit"), F.col(f"__g{i}").alias("score"), F.lit(w).alias("weight")) for i, w in enumerate(grid)])
    best = means.select(*groups, _first_improvement(entries).alias("w"))
    return best.select(*groups, F.array(F.col("w"), F.lit(1.0) - F.col("w")).alias("weights"))


def quadratic_step(weights: np.ndarray, gain: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The point of the simplex where the quadratic model of the mean log determinant is largest.

    ``gain`` and ``curve`` are the mean traces of M^-1 I_k and of M^-1 I_k M^-1 I_l. Contributors
    that the model pushes below zero are taken out one after the other.
    """
    free = np.arange(len(weights))
    pull = gain + curve @ weights
    while True:
        n = len(free)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = curve[np.ix_(free, free)]
        system[:n, n] = system[n, :n] = 1.0
        found = np.linalg.lstsq(system, np.append(pull[free], 1.0), rcond=None)[0][:n]
        if n == 1 or found.min() >= 0:
            out = np.zeros(len(weights))
            out[free] = np.maximum(found, 0.0) if n > 1 else 1.0
            return out / out.sum()
        free = np.delete(free, found.argmin())


def _weight_sums(packed: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, the sum of log det M, of all tr(M^-1 I_k) and of tr(M^-1 I_k M^-1 I_l), from packed informations."""
    info = packed[:, :, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(len(packed), len(w), 3, 3)
    mix = np.einsum("k,nkij->nij", w, info)
    ratio = np.linalg.solve(mix[:, None], info)
    curve = np.einsum("nkij,nlji->kl", ratio, ratio)
    return np.concatenate([[len(packed), np.linalg.slogdet(mix)[1].sum()], np.einsum("nkii->k", ratio), curve.ravel()])


def _next_weights(w: np.ndarray, base: np.ndarray, best: float, sums: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Weights, base, value and whether they are settled after one step; one that does not raise the value is halved."""
    k = len(w)
    value, gain, curve = sums[1] / sums[0], sums[2 : 2 + k] / sums[0], sums[2 + k :].reshape(k, k) / sums[0]
    if value < best - 1e-13:
        close = bool(np.abs(w - base).max() <= tolerance)
        return (base if close else (w + base) / 2), base, best, close
    # at the optimum no contributor's gain is above the dimension
    settled = bool(gain.max() <= 3.0 + tolerance)
    return (w if settled else quadratic_step(w, gain, curve)), w, value, settled


def _packed_information() -> Column:
    return F.flatten(F.transform("members", lambda m: F.array(*[m[i] for i in INFO])))


def _curvature(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group the number of rows, and sums of log det M, of all tr(M^-1 I_k) and tr(M^-1 I_k M^-1 I_l)."""
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{g}` {types[g]}" for g in groups) + ", at int, part double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, rows in b.groupby(b["spot"], sort=False):
                w = np.asarray(rows["weights"].iloc[0], float)
                parts = _weight_sums(np.array(rows["i"].tolist(), float).reshape(len(rows), len(w), 6), w)
                out = pd.DataFrame({"at": np.arange(len(parts), dtype=np.int32), "part": parts})
                for g in groups:
                    out[g] = [rows[g].iloc[0]] * len(out)
                yield out[[*groups, "at", "part"]]

    flat = _packed_information().alias("i")
    spot = F.xxhash64(*groups).alias("spot")
    parts = cells.select(*groups, "weights", spot, flat).mapInPandas(partial, schema)
    sums = parts.groupBy(*groups, "at").agg(F.sum("part").alias("part"))
    return sums.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]).alias("sums"))


#: cells of a group whose weights are found in one task.
GROUP_CELLS = 20_000


def nway_weights(cells: DataFrame, groups: Sequence[str], iterations: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Generalised CI weights for three or more contributors, from all rows of each group.

    Groups of up to ``GROUP_CELLS`` rows are solved in one pass, each in one task; larger ones by rounds over all of them.
    """
    groups = list(groups)
    sizes = cells.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    large = durable(sizes.where(F.col("n") > GROUP_CELLS).select(*groups))
    if large.isEmpty():
        return _grouped_weights(cells, groups, iterations, tolerance)
    # few beside the cells: each has more than GROUP_CELLS of them
    small, rest = (cells.join(F.broadcast(large), groups, how) for how in ("left_anti", "left_semi"))
    return _grouped_weights(small, groups, iterations, tolerance).unionByName(_spread_weights(rest, groups, iterations, tolerance))


def _grouped_weights(cells: DataFrame, groups: list[str], iterations: int, tolerance: float) -> DataFrame:
    """:func:`nway_weights` of groups that fit one task."""
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{g}` {types[g]}" for g in groups) + ", weights array<double>"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        packed = np.array(rows["i"].tolist(), float).reshape(len(rows), -1, 6)
        base = w = np.full(packed.shape[1], 1.0 / packed.shape[1])
        value, settled = -np.inf, False
        for _ in range(iterations):
            w, base, value, settled = _next_weights(w, base, value, _weight_sums(packed, w), tolerance)
            if settled:
                break
        return pd.DataFrame({**{g: [rows[g].iloc[0]] for g in groups}, "weights": [w if settled else base]})

    return cells.select(*groups, _packed_information().alias("i")).groupBy(*groups).applyInPandas(solve, schema)


def _spread_weights(cells: DataFrame, groups: Sequence[str], iterations: int, tolerance: float) -> DataFrame:
    """:func:`nway_weights` of groups of any size.

    Every round is one aggregation of value, gradient and curvature over the rows and one small
    problem for each group; a step that does not raise the mean log determinant is halved. Groups
    whose gradient shows an optimum leave the loop.
    """
    groups = list(groups)
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    keys = ", ".join(f"`{g}` {types[g]}" for g in groups)
    schema = f"{keys}, weights array<double>, base array<double>, value double, settled boolean"

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                w, base, sums = np.asarray(r["weights"], float), np.asarray(r["base"], float), np.asarray(r["sums"], float)
                w, base, value, settled = _next_weights(w, base, r["value"], sums, tolerance)
                rows.append({**{g: r[g] for g in groups}, "weights": w, "base": base, "value": value, "settled": settled})
            yield pd.DataFrame(rows, columns=[*groups, "weights", "base", "value", "settled"])

    start = F.expr("array_repeat(1D / size(pattern), size(pattern))")
    state = cells.select(*groups).distinct().withColumn("weights", start).withColumn("base", start)
    state = durable(state.withColumn("value", F.lit(float("-inf"))))
    found = state.select(*groups, "weights").limit(0)
    for _ in range(iterations):
        if state.isEmpty():
            return found
        sums = _curvature(attach(cells, state.select(*groups, "weights"), groups, how="inner"), groups)
        moved = durable(state.select(*groups, "weights", "base", "value").join(sums, groups).mapInPandas(advance, schema))
        found = found.unionByName(moved.where("settled").select(*groups, "weights"))
        state = moved.where("NOT settled")
    return found.unionByName(state.select(*groups, F.col("base").alias("weights")))


def fuse_covariance_intersection(
    est: DataFrame,
    keys: Sequence[str],
    frame_keys: Sequence[str] = (),
    written: bool = False,
) -> DataFrame:
    """CI with one weight vector per (frame, contributor pattern), from all rows of the pattern.

    The cells are read by the weights and by the final pass; where ``est`` is a ``written`` table, whose rows of a cell lie
    together, they are made from it each time.  Cells of one contributor meet no weights.
    """
    frame_keys = list(frame_keys)
    cells = _with_pattern(est, keys)
    cells = cells if written else placed(_slim(cells))
    groups = [*frame_keys, "pattern"]
    two = pair_weights(cells.where(F.size("members") == 2), groups)
    many = nway_weights(cells.where(F.size("members") > 2), groups)
    weights = durable(two.unionByName(many))
    single = cells.where(F.size("members") == 1).select(*keys, F.col("members")[0].alias("__m"))
    alone = single.select(*keys, *[F.col(f"__m.{n}").alias(n) for n in (*MEAN, *COV)], F.lit(1).alias("contributors"), F.array(F.lit(1.0)).alias("weights"))
    joined = attach_few(cells.where(F.size("members") > 1), weights, groups, salt_by=list(keys))
    one = F.array(F.lit(1.0))
    rows = joined.select(
        *keys,
        F.inline(F.arrays_zip(F.col("members"), F.coalesce("weights", one).alias("w"))),
    ).select(*keys, "members.*", "w")
    weighted = rows.groupBy(*keys).agg(
        *_information_sums(F.col("w")),
        F.array_sort(F.collect_list(F.struct("contributor", "w"))).alias("cw"),
    )
    return alone.unionByName(_finish(weighted, keys, [F.transform("cw", lambda e: e["w"]).alias("weights")]))


def _slim(cells: DataFrame) -> DataFrame:
    """Cells without what is never read again: the information of an only member, the covariances of several."""
    none, single = F.lit(None).cast("double"), F.size("members") == 1

    def kept(m: Column) -> Column:
        return F.struct(
            m["contributor"].alias("contributor"), *[m[n].alias(n) for n in MEAN],
            *[F.when(single, m[n]).otherwise(none).alias(n) for n in COV], *[F.when(single, none).otherwise(m[n]).alias(n) for n in INFO],
        )

    return cells.withColumn("members", F.transform("members", kept))


def fuse_ci_pointwise(est: DataFrame, keys: Sequence[str], grid_size: int = 21) -> DataFrame:
    """Two-contributor CI with the weight chosen per row (diagnostic alternative).

    The grid is exploded per cell and folded back per cell, so one row carries one
    determinant instead of twenty-one nested ones.
    """
    cells = _split_pair(_with_pattern(est, keys).where(F.size("members") == 2))
    entries = F.array(
        *[F.struct(F.lit(i).alias("visit"), F.lit(w).alias("weight")) for i, w in enumerate(ci_weight_grid(grid_size))]
    )
    tried = cells.select(*keys, *[f"{s}_{i}" for s in "ab" for i in INFO], F.explode(entries).alias("g"))
    scored = _mixed_log_det(tried, F.col("g.weight"), "score")
    best = scored.groupBy(*keys).agg(
        _first_improvement(F.collect_list(F.struct(F.col("g.visit").alias("visit"), "score", F.col("g.weight").alias("weight")))).alias("w")
    )
    rows = cells.select(*keys, F.inline(F.arrays_zip(F.col("members"), F.array(F.lit(0), F.lit(1)).alias("k")))).select(*keys, "members.*", "k")
    w = F.when(F.col("k") == 0, F.col("w")).otherwise(1 - F.col("w"))
    sums = rows.join(best, list(keys)).groupBy(*keys).agg(*_information_sums(w), F.max("w").alias("w"))
    return _finish(sums, keys, ["w"])


def fuse(est: DataFrame, keys: Sequence[str], method: str, **options) -> DataFrame:  # noqa: ANN003
    if method == "uniform":
        return fuse_uniform(est, keys)
    if method == "precision":
        return fuse_precision(est, keys)
    if method == "covariance_intersection":
        return fuse_covariance_intersection(est, keys, **options)
    raise ValueError(f"unknown fusion method {method!r}")


# --- windows to estimates -----------------------------------------------------------


def with_polynomials(gauges: DataFrame, keys: Sequence[str], translation: bool = True) -> DataFrame:
    """Transform and gauge-covariance coefficients per window as non-null scalar columns."""
    names = [*sim3.GAUGE_COLUMNS, *sim3.POLY]
    schema = T.StructType(
        [T.StructField(k, gauges.schema[k].dataType, False) for k in keys] + [T.StructField(n, T.DoubleType(), False) for n in names]
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                t = sim3.unpack(row)
                cov = np.zeros((7, 7)) if row.get("cov") is None else sim3.square(row["cov"])
                coef = sim3.covariance_polynomial(t, cov, translation)
                rows.append((*[row[k] for k in keys], *[row[c] for c in sim3.GAUGE_COLUMNS], *coef))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return gauges.mapInPandas(build, schema)


def _solid(*names: str) -> list[Column]:
    """Nulls become NaN: non-nullable inputs keep the generated code of long formulas small."""
    return [F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in names]


def world_estimates(
    samples: DataFrame, gauges: DataFrame, keys: Sequence[str] = ("case_id",), flow: bool = False
) -> DataFrame:
    """Transform samples into the common frame with structured + gauge covariance.

    Samples carry ``ray`` columns rx, ry, rz and variances ``var_par``/``var_lat``;
    gauges carry scale, rotation, translation and a 7x7 ``cov``.
    """
    return estimates_of(world_parts(samples, gauges, keys, flow))


def world_parts(
    samples: DataFrame, gauges: DataFrame, keys: Sequence[str] = ("case_id",), flow: bool = False, more: Sequence[str] = ()
) -> DataFrame:
    """What :func:`world_estimates` adds up: mean w*, ray u*, its variances vp and vl, and the gauge's covariance g_*.

    ``more`` are other variances of the samples, which are carried to the common frame under their own names.
    """
    cell = [c for c in ("case_id", "frame", "row", "col") if c in samples.columns]
    value = ["fx", "fy", "fz"] if flow else ["x", "y", "z"]
    need = samples.select(*cell, "window_id", *_solid(*value, "rx", "ry", "rz", "var_par", "var_lat", *more))
    g = durable(with_polynomials(gauges, [*keys, "window_id"], not flow))
    j = attach_few(need, g, [*keys, "window_id"], how="inner", salt_by=cell[1:])
    rot, s = sim3.rot_columns(), F.col("scale")
    local: v3.Vec = tuple(F.col(c) for c in value)  # type: ignore[assignment]
    world = v3.scale(s, v3.mat_vec(rot, local)) if flow else v3.apply_similarity(s, rot, sim3.t_columns(), local)
    ray = tuple(F.col(c) for c in ("rx", "ry", "rz"))
    turned = v3.mat_vec(rot, ray)  # type: ignore[arg-type]
    return j.select(
        *cell, F.col("window_id").alias("contributor"), *v3.named(world, ["wx", "wy", "wz"]), *v3.named(turned, ["ux", "uy", "uz"]),
        (s * s * F.col("var_par")).alias("vp"), (s * s * F.col("var_lat")).alias("vl"), *[(s * s * F.col(c)).alias(c) for c in more],
        *[c.alias(f"g_{n}") for n, c in zip(v3.SYM, sim3.gauge_covariance_columns(local), strict=True)],
    )


def estimates_of(parts: DataFrame, along: str = "vp", across: str = "vl", gauge: bool = True) -> DataFrame:
    """Estimates from :func:`world_parts`, with the variances ``along`` and ``across`` the ray, with or without the gauge's covariance."""
    cell = [c for c in ("case_id", "frame", "row", "col") if c in parts.columns]
    u = tuple(F.col(f"u{a}") for a in "xyz")
    base = v3.structured(F.col(along), F.col(across), u)  # type: ignore[arg-type]
    return parts.select(
        *cell, "contributor",
        *[F.col(f"w{a}").alias(a) for a in "xyz"],
        *[(c + F.col(f"g_{n}") if gauge else c).alias(f"c_{n}") for n, c in zip(v3.SYM, base, strict=True)],
    )


def fuse_windows(
    samples: DataFrame, gauges: DataFrame, method: str = "covariance_intersection"
) -> DataFrame:
    """Fuse the valid points (and, when present, deforming flows) of all windows.

    Output: cell, mean, covariance, contributors; flow columns f*, f_* and
    ``flow_contributors`` are null where no window carries flow.
    """
    keys = ["case_id", "frame", "row", "col"]
    options = {"frame_keys": ["case_id", "frame"]} if method == "covariance_intersection" else {}
    world = world_estimates(samples.where("valid"), gauges)
    points = fuse(world, keys, method, **options).drop("weights")
    if "fx" not in samples.columns:
        return points
    flows = fuse(world_estimates(samples.where("deform"), gauges, flow=True), keys, method, **options).drop("weights")
    flows = flows.withColumnsRenamed(
        {**{c: f"f{c}" for c in MEAN}, **{f"c_{s}": f"f_{s}" for s in v3.SYM}, "contributors": "flow_contributors"}
    )
    return points.join(flows, keys, "left")
