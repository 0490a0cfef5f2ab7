"""Exact ranks, running sums and order statistics that survive a hot group.

A plain ``Window.partitionBy(group).orderBy(v)`` puts a whole group into one task.
Here rows are range-partitioned by (group, v) once, every slice is scanned
independently, and a table with one row per (slice, group) carries the offsets.
Ties are collapsed before the shuffle, so the sorted data has one row per distinct
value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsfuse.runtime import durable


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums (and totals) of ``sums`` over ``order`` inside ``keys``.

    Adds ``name`` (running, inclusive) and ``name_total`` per entry.  ``order`` must
    be a total order inside a key.
    """
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    tagged = df.select(
        "*",
        *[e.alias(f"__v_{n}") for n, e in sums.items()],
        *[o.alias(f"__o{i}") for i, o in enumerate(order_cols)],
    )
    names = [f"__o{i}" for i in range(len(order_cols))]
    slices = durable(
        tagged.repartitionByRange(*keys, *names).withColumn("__slice", F.spark_partition_id())
    )
    local = W.partitionBy("__slice", *keys).orderBy(*names).rowsBetween(W.unboundedPreceding, 0)
    rows = slices.select(
        "*", *[F.sum(f"__v_{n}").over(local).alias(f"__r_{n}") for n in sums]
    )
    per_slice = slices.groupBy("__slice", *keys).agg(
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums]
    )
    # One row per (slice, key): bounded by the number of slices for any single key.
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_slice.select(
        F.col("__slice").alias("__slice_o"),
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    cond = F.col("__slice") == F.col("__slice_o")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(offsets, cond, "inner").select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__r_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums],
        *[F.col(f"{n}_total") for n in sums],
    )


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn"
) -> DataFrame:
    """1-based position inside ``keys`` (``name``) and group size (``name_total``)."""
    return with_running(df, keys, order, {name: F.lit(1).cast("bigint")})


def tie_table(
    df: DataFrame, keys: Sequence[str], value: str, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, value) with its multiplicity ``n`` and optional sums."""
    return df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in (extra or {}).items()]
    )


def ranked_ties(
    df: DataFrame, keys: Sequence[str], value: str, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Tie table plus ``cum`` (rows at or below the value) and ``cum_total``."""
    return with_running(
        tie_table(df, keys, value, extra), keys, [value], {"cum": F.col("n").cast("bigint")}
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one output column per entry."""
    ranked = ranked_ties(df.where(F.col(value).isNotNull()), keys, value)
    last = (F.col("cum_total") - 1).cast("double")
    aggs: list[Column] = []
    for name, q in probs.items():
        pos = last * F.lit(float(q))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cum") - F.col("n") <= at) & (at < F.col("cum"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{side}"))
    aggs.append(F.max("cum_total").alias("__total"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, q in probs.items():
        pos = (F.col("__total") - 1).cast("double") * F.lit(float(q))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out, F.col("__total").alias("n"))


def window_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the exact median of its group on every row, for groups that one task can sort (on disk if need be).

    Rows that lie together by ``keys`` or a part of them are not moved.
    """
    rank, total, w = f"__rank_{name}", f"__total_{name}", W.partitionBy(*keys)
    ranked = df.withColumns({rank: F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())) - 1, total: F.count(value).over(w)})
    at = (F.col(total) - 1) / F.lit(2.0)
    lo, hi = (F.max(F.when(F.col(rank) == side, F.col(value))).over(w) for side in (F.floor(at), F.ceil(at)))
    return ranked.withColumns({f"{name}__lo": lo, f"{name}__hi": hi}).withColumn(
        name, F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * (at - F.floor(at))
    ).drop(rank, total, f"{name}__lo", f"{name}__hi")


def order_statistic(
    df: DataFrame, keys: Sequence[str], value: str, rank: Column, name: str = "threshold"
) -> DataFrame:
    """Value at the 1-based ``rank`` (an expression over ``cum_total``) per group.

    A rank beyond the group size gives null.
    """
    ranked = ranked_ties(df.where(F.col(value).isNotNull()), keys, value)
    hit = (F.col("cum") - F.col("n") < rank) & (rank <= F.col("cum"))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(hit, F.col(value))).alias(name), F.max("cum_total").alias("n")
    )


def higher_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "score"
) -> DataFrame:
    """Sorted value at 0-based index ceil((n - 1) q)."""
    return order_statistic(
        df, keys, value, F.ceil((F.col("cum_total") - 1).cast("double") * F.lit(q)) + 1, name
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, value) -> 0-based rank with ties sharing their mean rank."""
    ranked = ranked_ties(df, keys, value)
    return ranked.select(
        *keys, value, (F.col("cum") - (F.col("n") + 1) / F.lit(2.0)).alias(name)
    )


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "spearman") -> DataFrame:
    """Spearman correlation per group; 0 when either rank vector is constant."""
    keys = list(keys)
    pairs = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("w"))
    ra = average_ranks(df, keys, a, "ra")
    rb = average_ranks(df, keys, b, "rb")
    joined = pairs.join(ra, [*keys, a]).join(rb, [*keys, b])
    w, x, y = F.col("w"), F.col("ra"), F.col("rb")
    sums = joined.groupBy(*keys).agg(
        F.sum(w).cast("double").alias("n"),
        F.sum(w * x).alias("sx"),
        F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
        F.sum(w * x * y).alias("sxy"),
    )
    n = F.col("n")
    vx = F.col("sxx") / n - (F.col("sx") / n) ** 2
    vy = F.col("syy") / n - (F.col("sy") / n) ** 2
    cov = F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)
    flat = (F.sqrt(F.greatest(vx, F.lit(0.0))) <= 1e-12) | (F.sqrt(F.greatest(vy, F.lit(0.0))) <= 1e-12)
    return sums.select(
        *keys, F.when(flat, F.lit(0.0)).otherwise(cov / F.sqrt(vx * vy)).alias(name)
    )


def expected_risk(
    df: DataFrame, keys: Sequence[str], risk: str, score: str, retain: float, name: str
) -> DataFrame:
    """Mean risk of the floor(q n) (at least one) lowest-score rows, ties in expectation."""
    ranked = ranked_ties(df, keys, score, {"risk_sum": F.sum(risk)})
    k = F.greatest(F.lit(1), F.floor(F.col("cum_total") * F.lit(retain)))
    kept = F.greatest(F.lit(0), F.least(F.col("n"), k - (F.col("cum") - F.col("n"))))
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col("risk_sum") * kept / F.col("n")) / F.max(k)).alias(name)
    )


def risk_coverage_auc(
    df: DataFrame, keys: Sequence[str], risk: str, score: str, name: str = "auc"
) -> DataFrame:
    """Area under expected risk versus coverage, independent of tie order.

    Within a tie of m rows that follows n0 rows with risk total s0, the j-th retained
    row contributes (s0 + j g)/(n0 + j) with g the tie's mean risk.  Summed over j this
    is m g + (s0 - n0 g) (H(n0 + m) - H(n0)); harmonic differences are exact sums for
    small ties and an asymptotic series beyond, so no tie is ever exploded.
    """
    tied = tie_table(df, keys, score, {"risk_sum": F.sum(risk)})
    ranked = with_running(
        tied, keys, [score], {"cum": F.col("n").cast("bigint"), "cum_risk": F.col("risk_sum")}
    )
    m = F.col("n").cast("double")
    n0 = F.col("cum").cast("double") - m
    s0 = F.col("cum_risk") - F.col("risk_sum")
    g = F.col("risk_sum") / m
    part = m * g + (s0 - n0 * g) * harmonic_gap(n0, m)
    return ranked.groupBy(*keys).agg((F.sum(part) / F.max("cum_total")).alias(name))


def harmonic_gap(n0: Column, m: Column) -> Column:
    """H(n0 + m) - H(n0) for non-negative integers held in doubles."""
    exact = F.aggregate(
        F.sequence(F.lit(1), F.least(m, F.lit(64.0)).cast("int")),
        F.lit(0.0),
        lambda acc, j: acc + F.lit(1.0) / (n0 + j),
    )
    return F.when(m <= 64, exact).otherwise(_harmonic(n0 + m) - _harmonic(n0))


def _harmonic(n: Column) -> Column:
    small = F.lit(0.0)
    series = (
        F.log(F.greatest(n, F.lit(1.0)))
        + F.lit(0.5772156649015329)
        + F.lit(1.0) / (F.lit(2.0) * n)
        - F.lit(1.0) / (F.lit(12.0) * n * n)
        + F.lit(1.0) / (F.lit(120.0) * n * n * n * n)
    )
    table = [sum(1.0 / i for i in range(1, k + 1)) for k in range(33)]
    lookup = F.element_at(F.array(*[F.lit(v) for v in table]), n.cast("int") + 1)
    return F.when(n == 0, small).when(n <= 32, lookup).otherwise(series)


def longest_run(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, name: str = "longest"
) -> DataFrame:
    """Longest stretch of consecutive true rows; 0 when there is none."""
    breaks = with_running(
        df, keys, order, {"__breaks": F.when(F.col(flag), 0).otherwise(1).cast("bigint")}
    )
    runs = breaks.groupBy(*keys, "__breaks").agg(
        F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("len")
    )
    return runs.groupBy(*keys).agg(F.max("len").alias(name))


def contiguous_intervals(df: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Distinct frames -> half-open intervals (start, stop, length)."""
    numbered = with_row_number(df.select(*keys, frame).distinct(), keys, [frame], "__rn")
    return (
        numbered.groupBy(*keys, (F.col(frame) - F.col("__rn")).alias("__island"))
        .agg(
            F.min(frame).alias("start"),
            (F.max(frame) + 1).alias("stop"),
            F.count(F.lit(1)).alias("length"),
        )
        .drop("__island")
    )


def interval_summary(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earliest start, latest stop, longest interval and interval count per key."""
    return intervals.groupBy(*keys).agg(
        F.min("start").alias("earliest"),
        F.max("stop").alias("latest"),
        F.max("length").alias("longest"),
        F.count(F.lit(1)).alias("intervals"),
    )


def subsample(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], size: int, seed: int = 0
) -> DataFrame:
    """At most ``size`` rows per key, chosen by a seeded hash of the row id.

    ``row_number() <= size`` lets Spark prune to ``size`` rows per key before the
    shuffle, so a hot key never moves more than that per map task.
    """
    draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])
    window = W.partitionBy(*keys).orderBy(draw, *[F.col(c) for c in ids])
    return (
        df.withColumn("__rn", F.row_number().over(window))
        .where(F.col("__rn") <= size)
        .drop("__rn")
    )


def representative_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 4096
) -> DataFrame:
    """All rows of a group up to ``size``, else ``size`` evenly spaced positions.

    Position i is floor(i (n - 1) / (size - 1)); a row at 0-based position p is kept
    when some i maps to it.
    """
    numbered = with_row_number(df, keys, order, "__rn")
    n, p = F.col("__rn_total"), (F.col("__rn") - 1).cast("double")
    span = (n - 1).cast("double")
    # smallest i with i * span / (size - 1) >= p, nudged for rounding
    i = F.ceil(p * F.lit(float(size - 1)) / span)
    hits = F.lit(False)
    for shift in (-1, 0, 1):
        j = i + shift
        hits = hits | (
            (j >= 0) & (j <= size - 1) & (F.floor(j * span / F.lit(float(size - 1))) == p)
        )
    return numbered.where((n <= size) | hits).drop("__rn", "__rn_total")


def conformal_rank(n: Column, miscoverage: float) -> Column:
    return F.ceil((n + 1).cast("double") * F.lit(1.0 - miscoverage))


def minimum_conformal_count(miscoverage: float) -> int:
    return math.ceil((1.0 - miscoverage) / miscoverage)
