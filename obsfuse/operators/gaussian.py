"""Structured Gaussian scoring from sufficient statistics.

Per group the covariance is blockdiag(D_i) + U U^T.  One aggregation collects
z^T z, W^T z (R), W^T W (R x R), sum log det D and the row count, with z and W whitened by
D; everything else is small algebra on one row per group.  3N x 3N never exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3
from obsfuse.functions.scalars import log_add_exp
from obsfuse.operators.bootstrap import group_bootstrap
from obsfuse.runtime import attach, durable

LOG_2PI = v3.LOG_2PI


def cholesky_columns(df: DataFrame, prefix: str = "c_") -> DataFrame:
    """Inverse lower Cholesky factor of the packed covariance as six columns.

    With D = L L^T the rows are whitened by L^-1; entries i11, i21, i22, i31, i32, i33.
    """
    c = [F.col(f"{prefix}{s}") for s in v3.SYM]
    xx, xy, xz, yy, yz, zz = c
    one = df.withColumn("l11", F.sqrt(xx))
    two = one.withColumns({"l21": xy / F.col("l11"), "l31": xz / F.col("l11")})
    three = two.withColumn("l22", F.sqrt(yy - F.col("l21") * F.col("l21")))
    four = three.withColumn("l32", (yz - F.col("l31") * F.col("l21")) / F.col("l22"))
    return four.withColumn("l33", F.sqrt(zz - F.col("l31") * F.col("l31") - F.col("l32") * F.col("l32")))


def _solve_lower(v: Sequence[Column]) -> tuple[Column, Column, Column]:
    a = v[0] / F.col("l11")
    b = (v[1] - F.col("l21") * a) / F.col("l22")
    c = (v[2] - F.col("l31") * a - F.col("l32") * b) / F.col("l33")
    return a, b, c


def sufficient_statistics(
    df: DataFrame, keys: Sequence[str], rank: int, residual: Sequence[str] = ("ex", "ey", "ez"), factor: str = "factor"
) -> DataFrame:
    """One row per key: n, zz, ld, wz[R], ww[R*R] (upper triangle mirrored).

    ``factor`` is a row-major 3 x R array column (ignored when R = 0).  Sums are plain
    aggregates, so hot groups combine on the map side.
    """
    keys = list(keys)
    base = cholesky_columns(df)
    z = dict(zip(("z0", "z1", "z2"), _solve_lower([F.col(c) for c in residual]), strict=True))
    cols: dict[str, Column] = {}
    for r in range(rank):
        u = [F.col(factor)[i * rank + r] for i in range(3)]
        cols.update(zip((f"w{r}_0", f"w{r}_1", f"w{r}_2"), _solve_lower(u), strict=True))
    white = base.withColumns({**z, **cols})

    def dot(a: str, b: str) -> Column:
        return sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(1, 3)), F.col(f"{a}0") * F.col(f"{b}0"))

    ld = F.lit(2.0) * (F.log("l11") + F.log("l22") + F.log("l33"))
    tri = [(i, j) for i in range(rank) for j in range(i, rank)]
    agg = white.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(dot("z", "z")).alias("zz"),
        F.sum(ld).alias("ld"),
        *[F.sum(dot(f"w{r}_", "z")).alias(f"s{r}") for r in range(rank)],
        *[F.sum(dot(f"w{i}_", f"w{j}_")).alias(f"g{i}_{j}") for i, j in tri],
    )
    wz = F.array(*[F.col(f"s{r}") for r in range(rank)]).cast("array<double>")
    ww = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(rank) for j in range(rank)]).cast("array<double>")
    return agg.select(*keys, "n", "zz", "ld", wz.alias("wz"), ww.alias("ww"))


SCORES = (
    "dimension bigint, m2 double, log_det double, nll double, nll_per_dimension double, nees double,"
    " effective_rank int, shared_energy double, conditional_energy double"
)


def group_scores(stats: DataFrame, keys: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """Finish sufficient statistics: Mahalanobis, NLL, NEES and subspace energies."""
    types = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + SCORES
    names = [c.strip().split()[0] for c in SCORES.split(",")]

    def finish(n: int, zz: float, ld: float, wz: np.ndarray, ww: np.ndarray) -> tuple:
        dim, r = 3 * int(n), len(wz)
        g = np.eye(r) + ww
        m2 = max(zz - float(wz @ np.linalg.solve(g, wz)), 0.0) if r else zz
        logdet = ld + (float(np.linalg.slogdet(g)[1]) if r else 0.0)
        nll = 0.5 * (dim * LOG_2PI + logdet + m2)
        lam, vec = np.linalg.eigh(ww) if r else (np.zeros(0), np.zeros((0, 0)))
        lam, vec = np.maximum(lam[::-1], 0.0), vec[:, ::-1]
        sv = np.sqrt(lam)
        eff = int((sv > tolerance * max(sv[0] if r else 0.0, 2.2e-308)).sum())
        coef = (vec[:, :eff].T @ wz) / sv[:eff] if eff else np.zeros(0)
        shared = float((coef**2 / (1.0 + sv[:eff] ** 2)).sum()) / eff if eff else None
        rest = dim - eff
        cond = max(zz - float(coef @ coef), 0.0) / rest if rest else None
        return dim, m2, logdet, nll, nll / dim, m2 / dim, eff, shared, cond

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (*[r[k] for k in keys], *finish(r["n"], r["zz"], r["ld"], np.asarray(r["wz"], float), np.asarray(r["ww"], float).reshape(len(r["wz"]), -1) if len(r["wz"]) else np.zeros((0, 0))))
                for r in b.to_dict("records")
            ]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return stats.mapInPandas(run, schema)


def joint_scores(df: DataFrame, keys: Sequence[str], rank: int, tolerance: float = 1e-10) -> DataFrame:
    return group_scores(sufficient_statistics(df, keys, rank), keys, tolerance)


def marginal_rows(df: DataFrame, rank: int, factor: str = "factor") -> DataFrame:
    """D + U_i U_i^T per row: same marginals, no dependence."""
    u = [[F.col(factor)[i * rank + r] for r in range(rank)] for i in range(3)]
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    return df.withColumns(
        {
            f"c_{s}": F.col(f"c_{s}") + sum((u[i][r] * u[j][r] for r in range(rank)), F.lit(0.0))
            for s, (i, j) in zip(v3.SYM, pairs, strict=True)
        }
    )


def dependence_ablation(df: DataFrame, group: str, rank: int) -> DataFrame:
    """Per group the NLL and |NEES - 1| advantage of the joint arm over two ablations."""
    joint = joint_scores(df, [group], rank).select(group, F.col("nll_per_dimension").alias("j_nll"), F.col("nees").alias("j_nees"))
    out = None
    for name, rows in (("marginal", marginal_rows(df, rank)), ("conditional", df)):
        a = joint_scores(rows, [group], 0).select(group, "nll_per_dimension", "nees").join(joint, group)
        a = a.select(
            group, F.lit(name).alias("ablation"),
            (F.col("nll_per_dimension") - F.col("j_nll")).alias("nll_advantage"),
            (F.abs(F.col("nees") - 1) - F.abs(F.col("j_nees") - 1)).alias("nees_advantage"),
        )
        out = a if out is None else out.unionByName(a)
    assert out is not None
    return out


def ablation_summary(rows: DataFrame, group: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    better = rows.groupBy("ablation").agg(
        F.avg(F.when(F.col("nll_advantage") > 0, 1.0).otherwise(0.0)).alias("better_fraction"),
        F.avg("nees_advantage").alias("mean_nees_advantage"),
    )
    return group_bootstrap(rows, ["ablation"], group, "nll_advantage", resamples, seed).join(better, "ablation")


# --- contaminated mixtures -----------------------------------------------------------------


def mixture_scores(scores: DataFrame, specs: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Two-scale group mixture per candidate (id, contamination, inflation).

    Candidates are exploded from a literal array; contamination 0 is the Gaussian.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(float(p)).alias("p"), F.lit(float(k)).alias("k")) for i, p, k in specs])
    s = scores.withColumn("s", F.explode(grid))
    p, k, dim = F.col("s.p"), F.col("s.k"), F.col("dimension")
    inflated = F.lit(0.5) * (dim * LOG_2PI + F.col("log_det") + dim * F.log(k) + F.col("m2") / k)
    gauss = p == 0
    clean = F.log1p(-p) - F.col("nll")
    dirty = F.log(F.when(gauss, F.lit(1.0)).otherwise(p)) - inflated
    total = log_add_exp(clean, dirty)
    post = F.when(gauss, F.lit(0.0)).otherwise(F.exp(dirty - total))
    return s.select(
        *scores.columns, F.col("s.spec_id").alias("spec_id"), p.alias("contamination"), k.alias("inflation"),
        F.when(gauss, F.col("nll")).otherwise(-total).alias("mixture_nll"),
        post.alias("posterior_contamination"),
        (1 - post + post / k).alias("expected_precision"),
    )


def select_mixture(
    units: DataFrame,
    minimum_units: int = 4,
    minimum_advantage: float = 0.0,
    maximum_harm: float = 0.1,
    maximum_harmful_fraction: float = 0.0,
    minimum_agreement: float = 0.5,
    tolerance: float = 1e-12,
) -> tuple[DataFrame, DataFrame]:
    """Leave-one-unit-out selection from a candidate x unit NLL-per-dimension table.

    Returns (folds, decision).  A fold picks the best mean over the *other* units by
    total minus own; within ``tolerance`` the simplest wins: Gaussian, then smaller
    contamination, inflation, id.
    """
    total = units.groupBy("spec_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("m"))
    j = units.join(total, "spec_id").withColumn("rest", (F.col("total") - F.col("value")) / (F.col("m") - 1))
    best = j.groupBy("unit_id").agg(F.min("rest").alias("best"))
    simple = F.struct((F.col("contamination") > 0).alias("g"), "contamination", "inflation", "spec_id", "value")
    picks = j.join(best, "unit_id").where(F.col("rest") <= F.col("best") + tolerance).groupBy("unit_id").agg(F.min(simple).alias("p"))
    gauss = units.where("contamination = 0").select("unit_id", F.col("value").alias("gaussian"))
    folds = picks.join(gauss, "unit_id").select(
        "unit_id", F.col("p.spec_id").alias("spec_id"), F.col("p.value").alias("selected"), "gaussian",
        (F.col("gaussian") - F.col("p.value")).alias("advantage"),
    )
    mean = units.groupBy("spec_id", "contamination", "inflation").agg(F.avg("value").alias("value"))
    low = mean.agg(F.min("value").alias("low"))
    final = mean.crossJoin(F.broadcast(low)).where(F.col("value") <= F.col("low") + tolerance).agg(F.min(simple).alias("p"))
    final = final.select(F.col("p.spec_id").alias("candidate"), (F.col("p.contamination") == 0).alias("is_gaussian"))
    agg = folds.crossJoin(F.broadcast(final)).agg(
        F.count(F.lit(1)).alias("units"),
        F.avg("advantage").alias("mean_advantage"),
        F.avg(F.when(F.col("advantage") < -maximum_harm, 1.0).otherwise(0.0)).alias("harmful_fraction"),
        F.avg(F.when(F.col("spec_id") == F.col("candidate"), 1.0).otherwise(0.0)).alias("agreement"),
        F.max("candidate").alias("candidate"),
        F.max("is_gaussian").alias("is_gaussian"),
    )
    ok = (
        (F.col("units") >= minimum_units)
        & (F.col("mean_advantage") >= minimum_advantage)
        & (F.col("harmful_fraction") <= maximum_harmful_fraction)
        & (F.col("agreement") >= minimum_agreement)
    )
    name = units.where("contamination = 0").agg(F.min("spec_id").alias("gaussian_id"))
    decision = agg.crossJoin(F.broadcast(name)).withColumn("accepted", ok).withColumn(
        "selected", F.when(ok, F.col("candidate")).otherwise(F.col("gaussian_id"))
    )
    return folds, decision


# --- localisation ---------------------------------------------------------------------------


def localize_failure(
    scores: DataFrame,
    bands: Mapping[str, tuple[float, float]],
    mean_ok: bool = True,
    identity_ok: bool = True,
    minimum_groups: int = 2,
    pass_fraction: float = 0.8,
    require_shared: bool = False,
) -> DataFrame:
    """Ordered classification of where a covariance model fails (one row)."""
    def share(c: str) -> Column:
        lo, hi = bands[c]
        return F.avg(F.when(F.col(c).isNull() | F.col(c).between(lo, hi), 1.0).otherwise(0.0)).alias(f"{c}_fraction")

    a = scores.agg(
        F.count(F.lit(1)).alias("groups"), share("nees"), share("shared_energy"), share("conditional_energy"),
        F.sum(F.col("shared_energy").isNull().cast("int")).alias("no_shared"),
        F.sum(F.col("conditional_energy").isNull().cast("int")).alias("no_conditional"),
    )
    verdict = (
        F.when(F.lit(not mean_ok), "mean-negative")
        .when(F.lit(not identity_ok), "identity-negative")
        .when(F.col("groups") < minimum_groups, "technical-failure")
        .when(F.lit(require_shared) & (F.col("no_shared") > 0), "technical-failure")
        .when(F.col("no_conditional") > 0, "technical-failure")
        .when(F.col("shared_energy_fraction") < pass_fraction, "gauge-or-dependence-negative")
        .when(F.col("conditional_energy_fraction") < pass_fraction, "point-covariance-localized")
        .when(F.col("nees_fraction") < pass_fraction, "gauge-or-dependence-negative")
        .otherwise("covariance-adequate")
    )
    return a.withColumn("classification", verdict)


# --- query projections ---------------------------------------------------------------------


def query_statistics(rows: DataFrame, keys: Sequence[str], q: int, rank: int, jacobian: str = "jac", factor: str = "factor") -> DataFrame:
    """Mergeable sums of a linear query: cond[Q*Q] = sum J D J^T, shared[Q*R] = sum J U.

    ``jac`` is Q x 3 row-major.  Also the streaming form: plain sums only.
    """
    j = [[F.col(jacobian)[3 * a + i] for i in range(3)] for a in range(q)]
    staged = rows.withColumns({f"jd{a}_{i}": c for a in range(q) for i, c in enumerate(v3.sym_vec(v3.sym(), tuple(j[a])))})  # type: ignore[arg-type]

    def cond(a: int, b: int) -> Column:
        return sum((F.col(f"jd{a}_{i}") * j[b][i] for i in range(3)), F.lit(0.0))

    def shared(a: int, r: int) -> Column:
        return sum((j[a][i] * F.col(factor)[i * rank + r] for i in range(3)), F.lit(0.0))

    agg = staged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(cond(a, b)).alias(f"k{a}_{b}") for a in range(q) for b in range(a, q)],
        *[F.sum(shared(a, r)).alias(f"u{a}_{r}") for a in range(q) for r in range(rank)],
    )
    return agg.select(
        *keys, "n",
        F.array(*[F.col(f"k{min(a, b)}_{max(a, b)}") for a in range(q) for b in range(q)]).alias("conditional"),
        F.array(*[F.col(f"u{a}_{r}") for a in range(q) for r in range(rank)]).cast("array<double>").alias("shared"),
    )


def query_covariance(stats: DataFrame, keys: Sequence[str], q: int, rank: int, tolerance: float = 1e-10) -> DataFrame:
    """Finish: covariance C + S S^T, shared trace fraction, directional relevance range."""
    types = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, covariance array<double>, shared_fraction double, min_relevance double, max_relevance double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                c = np.asarray(r["conditional"], float).reshape(q, q)
                s = np.asarray(r["shared"], float).reshape(q, rank)
                total = c + s @ s.T
                w, v = np.linalg.eigh(total)
                keep = w > tolerance * max(w[-1], 0.0)
                root = v[:, keep] / np.sqrt(w[keep])
                rel = np.linalg.eigvalsh(root.T @ s @ s.T @ root) if keep.any() else np.zeros(1)
                rows.append((*[r[k] for k in keys], r["n"], total.ravel().tolist(), float(np.trace(s @ s.T) / max(np.trace(total), 1e-300)), float(rel.min()), float(rel.max())))
            yield pd.DataFrame(rows, columns=[*keys, "n", "covariance", "shared_fraction", "min_relevance", "max_relevance"])

    return stats.mapInPandas(run, schema)


def gauge_action(rows: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("case_id",), gauge: str = "window_id") -> DataFrame:
    """Sigma v per row by component for rows with Jacobian (21), conditional D and v.

    Gauge part: per-gauge sums J^T v (7), multiplied by the covariance blocks, then
    J times the response.  Conditional part is row-local.
    """
    keys = list(keys)
    j, v = F.col("jacobian"), v3.vec("v")
    local = rows.groupBy(*keys, gauge).agg(
        *[F.sum(sum((j[7 * i + a] * v[i] for i in range(3)), F.lit(0.0))).alias(f"s{a}") for a in range(7)]
    )
    b = blocks.select(*keys, F.col("window_i").alias("wi"), F.col("window_j").alias(gauge), "block")
    moved = b.join(local, [*keys, gauge]).groupBy(*keys, F.col("wi").alias(gauge)).agg(
        *[F.sum(sum((F.col("block")[7 * a + k] * F.col(f"s{k}") for k in range(7)), F.lit(0.0))).alias(f"p{a}") for a in range(7)]
    )
    back = attach(rows, moved, [*keys, gauge], salt_by=["row_id"])
    cond = v3.sym_vec(v3.sym("k_"), v)
    gpart = [sum((j[7 * i + a] * F.coalesce(F.col(f"p{a}"), F.lit(0.0)) for a in range(7)), F.lit(0.0)) for i in range(3)]
    return back.select(*rows.columns, *v3.named(cond, ["ax", "ay", "az"]), *v3.named(gpart, ["bx", "by", "bz"]))


def quadratic_forms(acted: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """v^T Sigma v by component, clamped at zero."""
    v = v3.vec("v")
    a, b = v3.dot(v, v3.vec("a")), v3.dot(v, v3.vec("b"))
    zero = F.lit(0.0)
    return acted.groupBy(*keys).agg(
        F.greatest(F.sum(a), zero).alias("conditional"), F.greatest(F.sum(b), zero).alias("gauge"), F.greatest(F.sum(a + b), zero).alias("marginal")
    )


def gauge_query(rows: DataFrame, blocks: DataFrame, q: int, keys: Sequence[str] = ("case_id",), gauge: str = "window_id") -> DataFrame:
    """A Sigma A^T of a linear query over all rows of a key, by component; nothing of size rows or 7 K is formed.

    Rows carry the query ``query`` (Q x 3), the conditional covariance k_* and the gauge ``jacobian`` (3 x 7).  Rows are
    summed to A D A^T per key and to J^T A^T (7 x Q) per gauge; one join with the covariance blocks, one row for each
    ordered pair of gauges, takes these sums to the Q x Q gauge part.
    """
    keys = list(keys)
    a = [[F.col("query")[3 * n + i] for i in range(3)] for n in range(q)]
    staged = rows.withColumns({f"__d{n}_{i}": c for n in range(q) for i, c in enumerate(v3.sym_vec(v3.sym("k_"), tuple(a[n])))})  # type: ignore[arg-type]
    pairs = [(m, n) for m in range(q) for n in range(m, q)]
    names = [f"s{k}_{n}" for k in range(7) for n in range(q)]

    def part(k: int, n: int) -> Column:
        return sum((F.col("jacobian")[7 * i + k] * a[n][i] for i in range(3)), F.lit(0.0))

    local = staged.groupBy(*keys, gauge).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(sum((a[m][i] * F.col(f"__d{n}_{i}") for i in range(3)), F.lit(0.0))).alias(f"c{m}_{n}") for m, n in pairs],
        *[F.sum(part(k, n)).alias(f"s{k}_{n}") for k in range(7) for n in range(q)],
    )
    local = durable(local)  # one row per gauge, met from both sides below
    far = local.select(*keys, F.col(gauge).alias("window_j"), *[F.col(c).alias(f"f{c}") for c in names])
    met = blocks.select(*keys, F.col("window_i").alias(gauge), "window_j", "block").join(far, [*keys, "window_j"])
    response = met.groupBy(*keys, gauge).agg(
        *[F.sum(sum((F.col("block")[7 * k + m] * F.col(f"fs{m}_{n}") for m in range(7)), F.lit(0.0))).alias(f"p{k}_{n}") for k in range(7) for n in range(q)]
    )
    joined = local.join(response, [*keys, gauge], "left")

    def gauged(m: int, n: int) -> Column:
        return sum((F.col(f"s{k}_{m}") * F.coalesce(F.col(f"p{k}_{n}"), F.lit(0.0)) for k in range(7)), F.lit(0.0))

    sums = joined.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.sum(f"c{m}_{n}").alias(f"c{m}_{n}") for m, n in pairs], *[F.sum((gauged(m, n) + gauged(n, m)) / 2.0).alias(f"g{m}_{n}") for m, n in pairs]
    )

    def square(*names: str) -> Column:
        return F.array(*[sum((F.col(f"{c}{min(m, n)}_{max(m, n)}") for c in names), F.lit(0.0)) for m in range(q) for n in range(q)])

    return sums.select(*keys, "n", square("c").alias("conditional"), square("g").alias("gauge"), square("c", "g").alias("marginal"))


def woodbury_summary(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NLL, log det and quadratic of v = residual under blockdiag(D) + U U^T."""
    return group_scores(stats, keys).select(*keys, "log_det", "m2", "nll")


def condition_query(
    rows: DataFrame, keys: Sequence[str], q: int, rank: int, prior: DataFrame
) -> DataFrame:
    """Posterior of a linear query given the innovations: m + C S^-1 v, P - C S^-1 C^T.

    Rows carry the innovation e*, D, factor U (3 x R) and the query cross covariance
    ``cross`` (Q x 3).  Pass 1 sums W^T W, W^T z, C D^-1 U, C D^-1 v and C D^-1 C^T; the R x R
    and Q x Q solves run on one row per key with its prior (mean[Q], cov[Q*Q]).
    """
    keys = list(keys)
    base = cholesky_columns(rows)
    white = {**dict(zip(("z0", "z1", "z2"), _solve_lower([F.col("ex"), F.col("ey"), F.col("ez")]), strict=True))}
    for r in range(rank):
        white.update(zip((f"w{r}_0", f"w{r}_1", f"w{r}_2"), _solve_lower([F.col("factor")[i * rank + r] for i in range(3)]), strict=True))
    for a in range(q):
        white.update(zip((f"c{a}_0", f"c{a}_1", f"c{a}_2"), _solve_lower([F.col("cross")[3 * a + i] for i in range(3)]), strict=True))
    w = base.withColumns(white)
    names = ["z", *[f"w{r}_" for r in range(rank)], *[f"c{a}_" for a in range(q)]]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    agg = w.groupBy(*keys).agg(
        *[F.sum(sum((F.col(f"{names[i]}{k}") * F.col(f"{names[j]}{k}") for k in range(3)), F.lit(0.0))).alias(f"g{i}_{j}") for i, j in pairs]
    )
    m = len(names)
    gram = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(m) for j in range(m)])
    j = agg.select(*keys, gram.alias("gram")).join(prior, keys)
    types = {f.name: f.dataType.simpleString() for f in j.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", mean array<double>, cov array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                g = np.asarray(r["gram"], float).reshape(m, m)
                wi, ci = slice(1, 1 + rank), slice(1 + rank, m)
                inner = np.linalg.inv(np.eye(rank) + g[wi, wi]) if rank else np.zeros((0, 0))
                gain = g[ci, 0] - g[ci, wi] @ inner @ g[wi, 0]
                drop = g[ci, ci] - g[ci, wi] @ inner @ g[wi, ci]
                cov = np.asarray(r["cov"], float).reshape(q, q) - drop
                out.append((*[r[k] for k in keys], (np.asarray(r["mean"], float) + gain).tolist(), (0.5 * (cov + cov.T)).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*keys, "mean", "cov"])

    return j.mapInPandas(run, schema)


def query_distortion(pairs: DataFrame, keys: Sequence[str], q: int, limits: Mapping[str, float], tolerance: float = 1e-10) -> DataFrame:
    """Reference vs candidate query covariance (arrays ``reference``, ``candidate``)."""
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    cols = ["trace_distortion", "frobenius_distortion", "min_ratio", "mean_ratio", "max_ratio", "unsupported_fraction"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + ", ".join(f"{c} double" for c in cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                ref = np.asarray(r["reference"], float).reshape(q, q)
                cand = np.asarray(r["candidate"], float).reshape(q, q)
                w, v = np.linalg.eigh(ref)
                on = w > tolerance * max(w[-1], 0.0)
                inner = v[:, on].T @ cand @ v[:, on]
                ratio = np.maximum(np.linalg.eigvalsh(inner / np.sqrt(np.outer(w[on], w[on]))), 0.0)
                tr = np.trace(cand)
                lost = max(tr - np.trace(inner), 0.0) / tr if tr > 2.2e-16 else 0.0
                out.append((*[r[k] for k in keys], abs(tr - np.trace(ref)) / np.trace(ref), np.linalg.norm(cand - ref) / np.linalg.norm(ref), ratio.min(), ratio.mean(), ratio.max(), min(lost, 1.0)))
            yield pd.DataFrame(out, columns=[*keys, *cols])

    out = pairs.select(*keys, "reference", "candidate").mapInPandas(run, schema)
    checks = F.array(
        F.when(F.col("trace_distortion") > limits["trace"], F.lit("trace-distortion")),
        F.when(F.col("frobenius_distortion") > limits["frobenius"], F.lit("frobenius-distortion")),
        F.when(F.col("min_ratio") < limits["min_ratio"], F.lit("understatement")),
        F.when(F.col("max_ratio") > limits["max_ratio"], F.lit("overstatement")),
        F.when(F.col("unsupported_fraction") > limits["unsupported"], F.lit("unsupported-trace")),
    )
    return out.withColumn("reasons", F.array_sort(F.filter(checks, lambda c: c.isNotNull()))).withColumn("preserved", F.size("reasons") == 0)


def compress_factor(
    rows: DataFrame,
    rank: int,
    queries: Mapping[str, tuple[str, int]],
    weights: Mapping[str, float],
    observation_weight: float = 1.0,
    minimum_trace: float = 0.95,
    maximum_trace_loss: float = 0.05,
    maximum_spectral_loss: float = 0.05,
    eigenspace_tolerance: float = 1e-9,
) -> tuple[DataFrame, dict]:
    """Query-preserving rank reduction of a shared factor.

    Spark sums the R x R observation Gram and the Q x R query factors (column, Q) of every
    query in one pass; the driver solves an R x R eigenproblem; rows are projected with
    literal coefficients.  Whole eigenspaces are kept; the smallest rank meeting every
    limit wins, else the factor is returned unchanged.
    """
    def u(i: int, r: int) -> Column:
        return F.col("factor")[i * rank + r]

    aggs = [
        F.sum(sum((u(i, a) * u(i, b) for i in range(3)), F.lit(0.0))).alias(f"g{a}_{b}") for a in range(rank) for b in range(a, rank)
    ]
    for name, (col, q) in queries.items():
        for k in range(q):
            for r in range(rank):
                aggs.append(F.sum(sum((F.col(col)[3 * k + i] * u(i, r) for i in range(3)), F.lit(0.0))).alias(f"q_{name}_{k}_{r}"))
    row = rows.agg(*aggs).collect()[0].asDict()  # one row of R^2 + Q R sums
    gram = np.array([[row[f"g{min(a, b)}_{max(a, b)}"] for b in range(rank)] for a in range(rank)])
    factors = {n: np.array([[row[f"q_{n}_{k}_{r}"] for r in range(rank)] for k in range(q)]) for n, (_, q) in queries.items()}
    total = np.trace(gram)
    score = observation_weight * gram / total if total > 0 else np.zeros_like(gram)
    for n, b in factors.items():
        tr = float((b * b).sum())
        if tr > 0:
            score = score + weights.get(n, 1.0) * b.T @ b / tr
    w, v = np.linalg.eigh(score)
    w, v = w[::-1], v[:, ::-1]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(rank)])
    # what each number of leading columns keeps, as running sums over the columns
    whole = np.append(-np.diff(w) > eigenspace_tolerance * max(w[0], 0.0), True)  # no eigenspace is cut
    shares = np.cumsum(np.einsum("ac,ab,bc->c", v, gram, v)) / total if total > 0 else np.ones(rank)
    fine = whole & (shares >= minimum_trace - 1e-12)
    for b in factors.values():
        turned = b @ v
        power = (turned**2).sum(axis=0)
        if power.sum() <= 0:
            continue
        lost = 1 - np.cumsum(power) / power.sum()
        left_over = np.array([np.linalg.norm(turned[:, c:], 2) ** 2 if c < rank else 0.0 for c in range(1, rank + 1)])
        fine &= (lost <= maximum_trace_loss + 1e-12) & (left_over / np.linalg.norm(turned, 2) ** 2 <= maximum_spectral_loss + 1e-12)
    none_needed = total <= 0 and not any((b * b).sum() > 0 for b in factors.values())
    k = 0 if none_needed else int(np.flatnonzero(np.append(fine[:-1], True))[0]) + 1
    if k == rank:
        return rows, {"rank": rank, "applied": False, "trace": 1.0}
    new = F.array(*[sum((u(i, r) * F.lit(float(v[r, c])) for r in range(rank)), F.lit(0.0)) for i in range(3) for c in range(k)])
    return rows.withColumn("factor", new.cast("array<double>")), {"rank": k, "applied": True, "trace": float(shares[k - 1]) if k else 1.0}


# --- coherent bias ---------------------------------------------------------------------------


def bias_statistics(df: DataFrame, group: str, rank: int) -> DataFrame:
    """Whitened B^T B, B^T r, r^T r per group with rows scaled by 1/sqrt(n)."""
    return sufficient_statistics(df, [group], rank)


def select_bias_rank(
    stats: DataFrame,
    group: str,
    rank: int,
    ridge: float = 1e-8,
    shrinkage: float = 0.25,
    minimum_improvement: float = 1e-4,
    tolerance: float = 1e-10,
) -> tuple[DataFrame, DataFrame]:
    """Leave-one-group-out rank of a coherent bias covariance.

    Returns (rank table, one decision row with the refit covariance).  Moments of the
    other groups are the totals minus the group's own, so no group ever sees a list of
    all groups; every step is an aggregation over one row per (rank, group).
    """
    kinds = "g string" if stats.schema[group].dataType.typeName() == "string" else "g bigint"
    schema = f"{kinds}, rank int, moment array<double>, rr double, btr array<double>, btb array<double>"

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                n = float(r["n"])
                btr = np.asarray(r["wz"], float) / n
                btb = np.asarray(r["ww"], float).reshape(rank, rank) / n
                for k in range(rank + 1):
                    cov = np.linalg.inv(btb[:k, :k] + ridge * np.eye(k)) if k else np.zeros((0, 0))
                    coef = cov @ btr[:k]
                    rows.append((r[group], k, (np.outer(coef, coef) - cov).ravel().tolist(), r["zz"] / n, btr[:k].tolist(), btb[:k, :k].ravel().tolist()))
            yield pd.DataFrame(rows, columns=["g", "rank", "moment", "rr", "btr", "btb"])

    prepared = stats.mapInPandas(prepare, schema)
    exploded = prepared.select("rank", F.posexplode("moment").alias("i", "v"))
    sums = exploded.groupBy("rank", "i").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("m"))
    totals = sums.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.max("m").alias("m"))
    totals = totals.select("rank", F.transform("s", lambda e: e["v"]).alias("total"), "m")
    counts = prepared.agg(F.countDistinct("g").alias("groups"))
    joined = prepared.join(F.broadcast(totals), "rank", "left").crossJoin(F.broadcast(counts))

    def psd(raw: np.ndarray) -> np.ndarray:
        raw = 0.5 * (raw + raw.T)
        mix = (1 - shrinkage) * raw + shrinkage * np.diag(np.maximum(np.diag(raw), 0.0))
        w, v = np.linalg.eigh(0.5 * (mix + mix.T))
        return (v * np.maximum(w, 0.0)) @ v.T

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                k = int(r["rank"])
                quad, extra = r["rr"], 0.0
                if k:
                    rest = (np.asarray(r["total"], float) - np.asarray(r["moment"], float)).reshape(k, k) / (r["groups"] - 1)
                    w, v = np.linalg.eigh(psd(rest))
                    on = w > 1e-15 * max(w[-1], 1.0)
                    if on.any():
                        root = v[:, on] * np.sqrt(w[on])
                        gram = np.eye(int(on.sum())) + root.T @ np.asarray(r["btb"], float).reshape(k, k) @ root
                        proj = root.T @ np.asarray(r["btr"], float)
                        quad = max(quad - float(proj @ np.linalg.solve(gram, proj)), 0.0)
                        extra = float(np.linalg.slogdet(gram)[1])
                rows.append((r["g"], k, 0.5 * (LOG_2PI + extra + quad)))
            yield pd.DataFrame(rows, columns=["g", "rank", "nll"])

    nll = joined.mapInPandas(held_out, f"{kinds}, rank int, nll double")
    table = nll.groupBy("rank").agg(F.avg("nll").alias("mean_nll"), F.count(F.lit(1)).alias("groups"))
    best = table.agg(F.min("mean_nll").alias("low"), F.min(F.when(F.col("rank") == 0, F.col("mean_nll"))).alias("base"))
    tied = table.crossJoin(best).where(F.col("mean_nll") <= F.col("low") + tolerance)
    choice = tied.groupBy("base").agg(F.min(F.struct("rank", "mean_nll")).alias("b")).select(
        "base", F.col("b.mean_nll").alias("mean_nll"),
        F.when((F.col("b.rank") > 0) & (F.col("base") - F.col("b.mean_nll") >= minimum_improvement), F.col("b.rank")).otherwise(0).alias("selected_rank"),
    )

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                k = int(r["selected_rank"])
                cov = psd(np.asarray(r["total"], float).reshape(k, k) / r["m"]) if k else np.zeros((0, 0))
                rows.append((r["base"], r["mean_nll"], k, cov.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["baseline_nll", "best_nll", "selected_rank", "covariance"])

    decision = choice.join(totals.withColumnRenamed("rank", "selected_rank"), "selected_rank", "left").mapInPandas(
        refit, "baseline_nll double, best_nll double, selected_rank int, covariance array<double>"
    )
    return table, decision


def camera_layout(df: DataFrame, modes: int, shared: int, cameras: Sequence[str], column: str = "factor") -> DataFrame:
    """Multi-camera design: shared columns first, then mode x camera columns (zero elsewhere).

    ``column`` is 3 x (shared + modes) row-major, ``camera_id`` names the row's camera.
    """
    width = shared + modes

    def entry(i: int) -> list[Column]:
        out = [F.col(column)[i * width + s] for s in range(shared)]
        for m in range(modes):
            for c in cameras:
                out.append(F.when(F.col("camera_id") == c, F.col(column)[i * width + shared + m]).otherwise(F.lit(0.0)))
        return out

    return df.withColumn(column, F.array(*[e for i in range(3) for e in entry(i)]))


def orthogonalize_basis(df: DataFrame, keys: Sequence[str], gauge_rank: int, bias_rank: int, tolerance: float = 1e-10) -> DataFrame:
    """Remove the conditional-whitened gauge span (``gauge`` 3 x K) from ``factor`` (3 x R).

    Pass 1 sums G^T G and G^T B per key; pass 2 subtracts G (G^T G)^+ G^T B row by row.
    """
    keys = list(keys)
    both = df.withColumn(
        "__gb",
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.slice("gauge", i * gauge_rank + 1, gauge_rank), F.slice("factor", i * bias_rank + 1, bias_rank)))),
    )
    k = gauge_rank + bias_rank
    stats = sufficient_statistics(both.withColumn("factor", F.col("__gb")), keys, k)
    types = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", coef array<double>, before double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                m = np.asarray(r["ww"], float).reshape(k, k)
                gg, gb, bb = m[:gauge_rank, :gauge_rank], m[:gauge_rank, gauge_rank:], np.diag(m)[gauge_rank:]
                coef = np.linalg.pinv(gg, rcond=tolerance**2, hermitian=True) @ gb
                along = np.einsum("ij,ij->j", gb, coef)
                before = float(np.sqrt(np.max(np.where(bb > 0, along / np.where(bb > 0, bb, 1.0), 0.0))))
                rows.append((*[r[c] for c in keys], coef.ravel().tolist(), before))
            yield pd.DataFrame(rows, columns=[*keys, "coef", "before"])

    coef = stats.mapInPandas(solve, schema)
    j = attach(df, coef, keys, salt_by=["row_id"]) if keys else df.crossJoin(F.broadcast(coef))
    new = [
        F.col("factor")[i * bias_rank + r] - sum((F.col("gauge")[i * gauge_rank + g] * F.col("coef")[g * bias_rank + r] for g in range(gauge_rank)), F.lit(0.0))
        for i in range(3) for r in range(bias_rank)
    ]
    return j.withColumn("factor", F.array(*new)).select(*df.columns, F.col("before").alias("projection_before"))


