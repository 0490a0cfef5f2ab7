"""Variance-scale calibration with upper winsorisation and equal-group weighting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.functions import vec3 as v3
from obsfuse.operators import ranking as rk
from obsfuse.runtime import attach


def winsorized_mean(
    df: DataFrame, keys: Sequence[str], value: str, q: float = 0.99, minimum: float = 1e-6, name: str = "update"
) -> DataFrame:
    """Mean after clipping at the exact linear q-quantile, floored at ``minimum``."""
    keys = list(keys)
    ties = rk.tie_table(df.where(F.col(value).isNotNull()), keys, value)
    cut = rk.exact_quantiles(df, keys, value, {"__cut": q}).drop("n")
    j = attach(ties, cut, keys)
    return j.groupBy(*keys).agg(
        F.greatest(
            F.sum(F.col("n") * F.least(F.col(value), F.col("__cut"))) / F.sum("n"), F.lit(minimum)
        ).alias(name),
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias(f"{name}_raw_mean"),
    )


def structured_ratios(df: DataFrame) -> DataFrame:
    """par^2 / var_par and lat^2 / (2 var_lat) of errors e* along rays r*."""
    e, r = v3.vec("e"), v3.vec("r")
    par = v3.dot(e, r)
    lat2 = F.greatest(v3.dot(e, e) - par * par, F.lit(0.0))
    return df.where(v3.finite(*e)).select(
        "*",
        (par * par / F.col("var_par")).alias("par_ratio"),
        (lat2 / (2 * F.col("var_lat"))).alias("lat_ratio"),
    )


def pooled_calibration(df: DataFrame, q: float = 0.99) -> DataFrame:
    """One row: scale updates and normalised MSE over all rows."""
    par = winsorized_mean(df, [], "par_ratio", q, name="par_update").withColumnRenamed("par_update_raw_mean", "par_mse")
    lat = winsorized_mean(df, [], "lat_ratio", q, name="lat_update").withColumnRenamed("lat_update_raw_mean", "lat_mse")
    return par.crossJoin(lat.drop("n"))


def group_calibration(df: DataFrame, group: str = "group_id", q: float = 0.99) -> DataFrame:
    """Per-group updates, counts and normalised MSE (winsorised inside the group)."""
    par = winsorized_mean(df, [group], "par_ratio", q, name="par_update").withColumnRenamed("par_update_raw_mean", "par_mse")
    lat = winsorized_mean(df, [group], "lat_ratio", q, name="lat_update").withColumnRenamed("lat_update_raw_mean", "lat_mse")
    return par.join(lat.drop("n"), group)


def group_balanced_calibration(df: DataFrame, group: str = "group_id", q: float = 0.99) -> DataFrame:
    """Unweighted mean of the per-group updates: long groups cannot dominate."""
    return group_calibration(df, group, q).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        *[F.avg(c).alias(c) for c in ("par_update", "lat_update", "par_mse", "lat_mse")],
    )


# --- transform (7-D) inflation --------------------------------------------------------------

BLOCKS = {"scale": (0, 1), "rotation": (1, 4), "translation": (4, 7)}


def block_ratios(errors: DataFrame) -> DataFrame:
    """e^T S^-1 e / d per block; input has ``error`` (7) and ``cov`` (49) arrays."""
    schema = errors.schema.simpleString()[7:-1] + "," + ",".join(f"{b}_ratio:double" for b in BLOCKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            e = np.array(b["error"].tolist(), dtype=float).reshape(len(b), 7)
            c = np.array(b["cov"].tolist(), dtype=float).reshape(len(b), 7, 7)
            out = {}
            for name, (i, j) in BLOCKS.items():
                sub = sim3.floored_inverse(c[:, i:j, i:j]) if len(b) else c[:, i:j, i:j]
                out[f"{name}_ratio"] = np.einsum("ni,nij,nj->n", e[:, i:j], sub, e[:, i:j]) / (j - i)
            yield b.assign(**out)

    return errors.mapInPandas(run, schema)


def fit_inflation(errors: DataFrame, q: float = 0.99) -> DataFrame:
    """Winsorised mean ratio per block: the inflation of that block's variance."""
    ratios = block_ratios(errors)
    out = None
    for name in BLOCKS:
        one = winsorized_mean(ratios, [], f"{name}_ratio", q, name=f"{name}_inflation").select(f"{name}_inflation")
        out = one if out is None else out.crossJoin(one)
    assert out is not None
    return out


def ratio_quantiles(ratios: DataFrame) -> DataFrame:
    """Median, mean, q90, q95, q99 of every block ratio."""
    out = None
    for name in BLOCKS:
        q = rk.exact_quantiles(ratios, [], f"{name}_ratio", {"median": 0.5, "q90": 0.9, "q95": 0.95, "q99": 0.99})
        row = q.crossJoin(ratios.agg(F.avg(f"{name}_ratio").alias("mean"))).withColumn("block", F.lit(name))
        out = row if out is None else out.unionByName(row)
    assert out is not None
    return out


def apply_inflation(df: DataFrame, inflation: DataFrame, cov: str = "cov") -> DataFrame:
    """S C S with S the block roots of the inflation; pure array arithmetic."""
    j = df.crossJoin(F.broadcast(inflation))
    root = F.flatten(
        F.array(
            F.array(F.sqrt("scale_inflation")),
            F.array_repeat(F.sqrt("rotation_inflation"), 3),
            F.array_repeat(F.sqrt("translation_inflation"), 3),
        )
    )
    j = j.withColumn("__s", root)
    scaled = F.transform(
        F.col(cov), lambda v, k: v * F.col("__s")[F.floor(k / 7).cast("int")] * F.col("__s")[(k % 7).cast("int")]
    )
    return j.withColumn(cov, scaled).select(*df.columns)


class VarianceInflation:
    """Calibration object with ``apply``: any object with this method can be passed on."""

    def __init__(self, inflation: DataFrame) -> None:
        self.inflation = inflation

    def apply(self, df: DataFrame, cov: str = "cov") -> DataFrame:
        return apply_inflation(df, self.inflation, cov)
