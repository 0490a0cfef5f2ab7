"""Gradient-boosted trees for a two-class label: small histograms, logistic loss, second-order leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.runtime import durable, within_limit


@dataclass
class Trees:
    """Complete trees of one depth as arrays: the feature and limit of each inner node, the value of each leaf."""

    depth: int
    bias: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, weight: np.ndarray | None = None
) -> Trees:
    """Fit on all rows given, each counted ``weight`` times; every split is the best one over quantile bins of every feature."""
    model = Trees(depth)
    if not len(x):
        return model
    w = np.ones(len(y)) if weight is None else weight
    mean = ((w * y).sum() + 0.5) / (w.sum() + 1)
    model.bias = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    odds = np.full(len(x), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for j, cut in enumerate(edges):
                if not len(cut):
                    continue
                cell = (node - first) * bins + binned[:, j]
                g = np.bincount(cell, slope, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(cell, curve, count * bins).reshape(count, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                g, h = g[:, : len(cut)], h[:, : len(cut)]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best = np.where(better, gain[np.arange(count), top], best)
                at = first + np.flatnonzero(better)
                feature[at], limit[at] = j, cut[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, curve, 2**depth) + ridge)
        odds = odds + value[leaf]
        model.feature.append(feature)
        model.limit.append(limit)
        model.value.append(value)
    return model


#: Bins of a counted feature: 0, 1, ... and one for all larger values.
BINS = 32
#: Slopes and curves are summed as multiples of this, so that no order of the rows changes a sum.
_UNIT = 2.0**-20


def codes(x: np.ndarray) -> np.ndarray:
    """Counts and flags as bins of one byte."""
    return np.clip(x, 0, BINS - 1).astype(np.uint8)


def _decoded(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = batch.column("code").to_pylist()
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return x, np.asarray(batch.column("label")), np.asarray(batch.column("weight"))


def _histogram(model: Trees, feature: np.ndarray, limit: np.ndarray, level: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slopes and curves by node of ``level``, feature and bin, in units."""
    p = 1 / (1 + np.exp(-model.odds(x)))
    node = np.zeros(len(x), np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
    node -= 2**level - 1
    out = np.zeros((2, 2**level, x.shape[1], BINS))
    for k, of in enumerate((w * (p - y), w * np.maximum(p * (1 - p), 1e-6))):
        units = np.rint(of / _UNIT)
        for j in range(x.shape[1]):
            out[k, :, j] = np.bincount(node * BINS + x[:, j], units, 2**level * BINS).reshape(-1, BINS)
    return out


def fit_counted(cells: DataFrame, features: int, rounds: int = 50, depth: int = 3, rate: float = 0.25, ridge: float = 1.0) -> Trees:
    """Fit on all rows of ``cells`` (code, label, weight): distinct `codes` with the weight of their examples.

    Every split is the best one over all bins of every feature, in the middle of a gap.  Each level is one aggregation of histograms, of a size
    that does not depend on the rows; few cells are aggregated in place, with the same sums.
    """
    model = Trees(depth)
    total = cells.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("h")).first()
    if total["w"] is None:
        return model
    mean = (total["h"] + 0.5) / (total["w"] + 1)
    model.bias = float(np.log(mean / (1 - mean)))
    shape = lambda level: (2, 2**level, features, BINS)
    if within_limit(cells):
        known = _decoded(cells.toArrow().combine_chunks())

        def histogram(level: int) -> np.ndarray:
            return _histogram(model, feature, limit, level, *known)
    else:
        cells = durable(cells)

        def histogram(level: int) -> np.ndarray:
            now = (model, feature, limit, level)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums = np.zeros(shape(level))
                for batch in batches:
                    if batch.num_rows:
                        sums += _histogram(*now, *_decoded(batch))
                flat = sums.ravel()
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "units"])

            out = np.zeros(shape(level))
            for r in cells.mapInArrow(run, "at bigint, units double").groupBy("at").agg(F.sum("units").alias("units")).collect():
                out.flat[r["at"]] = r["units"]
            return out

    for _ in range(rounds):
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            sums = histogram(level) * _UNIT
            g, h = sums.cumsum(axis=3)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            left_g, left_h = g[:, :, :-1], h[:, :, :-1]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain = gain.reshape(len(gain), -1)
            leaves = []
            for k, top in enumerate(gain.argmax(axis=1)):
                j, cut = divmod(int(top), BINS - 1)
                parts = [(all_g[k, 0, 0], all_h[k, 0, 0]), (0.0, 0.0)]
                if gain[k, top] > 1e-9:
                    last = int(np.searchsorted(left_h[k, j], left_h[k, j, cut], "right")) - 1  # no example lies between the two
                    feature[2**level - 1 + k], limit[2**level - 1 + k] = j, (cut + last) // 2
                    parts = [(left_g[k, j, cut], left_h[k, j, cut]), (all_g[k, 0, 0] - left_g[k, j, cut], all_h[k, 0, 0] - left_h[k, j, cut])]
                leaves += [-rate * a / (b + ridge) for a, b in parts]
        model.feature.append(feature)
        model.limit.append(limit)
        model.value.append(np.array(leaves))
    return model
