"""Group and moving-block bootstraps with reproducible arithmetic draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.operators.ranking import with_row_number
from obsfuse.runtime import null_safe_on

_P = 2147483647


def draw_index(seed: int, b: Column, i: Column, n: Column) -> Column:
    """Deterministic index in [0, n) for replicate ``b`` and slot ``i``.

    Three squaring rounds modulo 2^31 - 1; integer arithmetic only, so any SQL engine
    reproduces it.
    """
    x = (b * F.lit(1000003) + i * F.lit(7919) + F.lit(seed * 104729 + 12345)) % F.lit(_P)
    for k in (48271, 69621, 16807):
        x = (x * x + x * F.lit(k) + F.lit(7)) % F.lit(_P)
    return x % n


def _replicates(count: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def group_bootstrap(
    values: DataFrame,
    keys: Sequence[str],
    group: str,
    value: str,
    resamples: int = 2000,
    seed: int = 0,
) -> DataFrame:
    """Mean of one value per group with a percentile interval over n-of-n draws.

    Slots are exploded per group row, counted per (replicate, drawn group) on the map
    side, then joined to the values by index: no product join and no driver loop.  A
    single group gives an interval equal to its mean.
    """
    keys = list(keys)
    numbered = with_row_number(values.select(*keys, group, value), keys, [group], "__i")
    # a small table is one part, its slots are ``resamples`` times as many
    slots = numbered.repartition(values.sparkSession.sparkContext.defaultParallelism, *keys, "__i").select(
        *keys,
        F.col("__i_total").alias("__n"),
        (F.col("__i") - 1).alias("__slot"),
        F.explode(_replicates(resamples)).alias("__b"),
    )
    drawn = slots.select(
        *keys, "__b", "__n", draw_index(seed, F.col("__b"), F.col("__slot"), F.col("__n")).alias("__pick")
    ).groupBy(*keys, "__b", "__pick").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    picked = numbered.select(*keys, (F.col("__i") - 1).alias("__pick"), F.col(value).alias("__v"))
    means = (
        drawn.join(picked, [*keys, "__pick"])
        .groupBy(*keys, "__b")
        .agg((F.sum(F.col("__c") * F.col("__v")) / F.max("__n")).alias("__m"))
    )
    # at most ``resamples`` values per key
    ci = means.groupBy(*keys).agg(
        F.percentile("__m", F.lit(0.025)).alias("ci_lower"),
        F.percentile("__m", F.lit(0.975)).alias("ci_upper"),
    )
    base = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("groups"))
    one = F.col("groups") == 1
    joined = (
        base.join(ci, null_safe_on(base, ci, keys)).select(base["*"], "ci_lower", "ci_upper")
        if keys
        else base.crossJoin(ci)
    )
    return joined.withColumns(
        {
            "ci_lower": F.when(one, F.col("mean")).otherwise(F.col("ci_lower")),
            "ci_upper": F.when(one, F.col("mean")).otherwise(F.col("ci_upper")),
        }
    )


def block_bootstrap(
    frames: DataFrame,
    keys: Sequence[str],
    frame: str,
    candidate_sum: str,
    baseline_sum: str,
    count: str,
    block: int = 8,
    resamples: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Circular moving-block bootstrap of (sum candidate - sum baseline) / sum count.

    ``frames`` has one row per key and frame.  Slot p of a replicate takes frame
    (start of block p // L + p % L) mod n, trimmed to n slots.
    """
    keys = list(keys)
    numbered = with_row_number(frames, keys, [frame], "__i")
    p = F.col("__i") - 1
    slots = numbered.select(
        *keys, F.col("__i_total").alias("__n"), p.alias("__p"),
        F.explode(_replicates(resamples)).alias("__b"),
    )
    start = draw_index(seed, F.col("__b"), F.floor(F.col("__p") / block).cast("bigint"), F.col("__n"))
    drawn = slots.select(
        *keys, "__b", ((start + F.col("__p") % block) % F.col("__n")).alias("__pick")
    ).groupBy(*keys, "__b", "__pick").agg(F.count(F.lit(1)).alias("__c"))
    picked = numbered.select(*keys, p.alias("__pick"), candidate_sum, baseline_sum, count)
    c = F.col("__c")
    stats = drawn.join(picked, [*keys, "__pick"]).groupBy(*keys, "__b").agg(
        ((F.sum(c * F.col(candidate_sum)) - F.sum(c * F.col(baseline_sum))) / F.sum(c * F.col(count))).alias("__d")
    )
    ci = stats.groupBy(*keys).agg(
        F.percentile("__d", F.lit(0.025)).alias("ci_lower"),
        F.percentile("__d", F.lit(0.975)).alias("ci_upper"),
        F.avg(F.when(F.col("__d") < 0, 1.0).otherwise(0.0)).alias("probability_better"),
    )
    base = frames.groupBy(*keys).agg(
        ((F.sum(candidate_sum) - F.sum(baseline_sum)) / F.sum(count)).alias("difference"),
        F.count(F.lit(1)).alias("frames"),
    )
    return base.join(ci, keys) if keys else base.crossJoin(ci)
