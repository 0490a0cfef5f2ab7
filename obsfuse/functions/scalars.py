"""Scalar helpers: log-sum-exp, sigmoid, strict JSON, arrays, nanosecond time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_add_exp(a: Column, b: Column) -> Column:
    hi, lo = F.greatest(a, b), F.least(a, b)
    return hi + F.log1p(F.exp(lo - hi))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(
        F.exp(x) / (F.lit(1.0) + F.exp(x))
    )


def softmax_array(log_weights: Column) -> Column:
    top = F.array_max(log_weights)
    shifted = F.transform(log_weights, lambda v: F.exp(v - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(shifted, lambda v: v / total)


def entropy_array(p: Column) -> Column:
    return F.aggregate(
        p, F.lit(0.0), lambda acc, v: acc - F.when(v > 0, v * F.log(v)).otherwise(F.lit(0.0))
    )


def sorted_unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def strict_json(text: Column, schema: T.StructType) -> Column:
    """Parse JSON and fail the query on malformed input instead of yielding null."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def canonical_json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def exact_string(c: Column) -> Column:
    """True for a non-empty string without surrounding white space."""
    return c.isNotNull() & (F.length(c) > 0) & (F.trim(c) == c)


def ns_to_timestamp(ns: Column) -> Column:
    """Event-time column for watermarks; nanoseconds stay in their BIGINT column."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000)).cast("bigint"))


def compensated_sum(values: Column) -> Column:
    """Order-fixed compensated sum of a bounded array."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, v: Column) -> Column:
        y = v - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(values, zero, step, lambda acc: acc["s"])
