"""Identity hypotheses of a target: likelihood marginalisation and moment matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.runtime import attach


def posterior(df: DataFrame, power: float = 1.0, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """softmax(normalised log weight + power * log likelihood) per target.

    Power 0 returns the prior.  Two-step log-sum-exp: the maximum first, then the sum,
    both plain aggregates joined back by target.
    """
    keys = list(keys)
    lw = F.col("log_weight").cast("double")
    top = df.groupBy(*keys).agg(F.max(lw).alias("__wm"))
    a = attach(df, top, keys)
    norm = a.groupBy(*keys).agg((F.max("__wm") + F.log(F.sum(F.exp(lw - F.col("__wm"))))).alias("__z"))
    term = lw - F.col("__z") + (F.lit(power) * F.col("log_likelihood") if power else F.lit(0.0))
    b = attach(a.drop("__wm"), norm, keys).withColumn("__t", term)
    peak = b.groupBy(*keys).agg(F.max("__t").alias("__p"))
    c = attach(b, peak, keys)
    total = c.groupBy(*keys).agg((F.max("__p") + F.log(F.sum(F.exp(F.col("__t") - F.col("__p"))))).alias("log_marginal"))
    out = attach(c, total, keys)
    return out.select(*df.columns, "log_marginal", F.exp(F.col("__t") - F.col("log_marginal")).alias("probability"))


def identity_summary(post: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Log marginal, entropy (nats) and effective hypothesis count per target."""
    p = F.col("probability")
    ent = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)))
    return post.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.max("log_marginal").alias("log_marginal"), ent.alias("entropy"), F.exp(ent).alias("effective")
    )


def moment_match(post: DataFrame, size: int, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Law of total covariance over hypotheses: mean, within, between, total.

    ``mean`` is an array of ``size`` values and ``cov`` size x size.  Between-covariance is
    taken about a first-pass mean, so it does not cancel for distant targets.
    """
    keys = list(keys)
    p = F.col("probability")
    means = post.groupBy(*keys).agg(*[F.sum(p * F.col("mean")[i]).alias(f"m{i}") for i in range(size)])
    j = attach(post, means, keys)
    d = [F.col("mean")[i] - F.col(f"m{i}") for i in range(size)]
    pairs = [(i, k) for i in range(size) for k in range(size)]
    agg = j.groupBy(*keys).agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(size)],
        *[F.sum(p * F.col("cov")[i * size + k]).alias(f"w{i}_{k}") for i, k in pairs],
        *[F.sum(p * d[i] * d[k]).alias(f"b{i}_{k}") for i, k in pairs],
    )
    return agg.select(
        *keys,
        F.array(*[F.col(f"m{i}") for i in range(size)]).alias("mean"),
        F.array(*[F.col(f"w{i}_{k}") for i, k in pairs]).alias("within"),
        F.array(*[F.col(f"b{i}_{k}") for i, k in pairs]).alias("between"),
        F.array(*[F.col(f"w{i}_{k}") + F.col(f"b{i}_{k}") for i, k in pairs]).alias("covariance"),
    )
