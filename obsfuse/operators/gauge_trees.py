"""Causal gauge trees as tables: gauges by pointer doubling, covariance as blocks.

No case is ever one group.  Windows follow their parent pointers, which double in every
round, so a chain of K windows takes log2(K) joins; joint covariance is made of 7 x 7 blocks
for the window pairs that a consumer names, never as one dense matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.functions import sim3
from obsfuse.operators.gauges import START, parent_edges
from obsfuse.runtime import attach, attach_few, durable

_KEY = ["case_id", "window_id"]
_ALL = range(49)
#: copies of a table of windows that is joined to windows, paths or pairs: a window that many of these share is spread over as many tasks.
SALT = 4


def _composed(outer: str, inner: str) -> list[Column]:
    """Gauge columns of (outer inner), both given by column prefixes."""
    o, i = ({c: F.col(f"{p}{c}") for c in sim3.GAUGE_COLUMNS} for p in (outer, inner))
    out = [(o["scale"] * i["scale"]).alias("scale")]
    out += [sum((o[f"r{a}{k}"] * i[f"r{k}{b}"] for k in (2, 3)), o[f"r{a}1"] * i[f"r1{b}"]).alias(f"r{a}{b}") for a in (1, 2, 3) for b in (1, 2, 3)]
    turned = [o[f"r{a}1"] * i["tx"] + o[f"r{a}2"] * i["ty"] + o[f"r{a}3"] * i["tz"] for a in (1, 2, 3)]
    return out + [(o["scale"] * t + o[n]).alias(n) for t, n in zip(turned, ("tx", "ty", "tz"), strict=True)]


def tree_gauges(edges: DataFrame) -> DataFrame:
    """One row per window: parent, root, depth, status, gauge in the frame of its root, and the edge's covariance.

    ``edges`` are fits with positions (`gauges.with_positions`).  The parent of a window is its best edge from
    an earlier one (`gauges.parent_edges`).  The first window of a case is its root; a later window
    without causal edge is a root of its own with status ``no-causal-overlap``, and the windows below
    it have status ``detached``: nothing raises.
    """
    good = edges.where("status = 'ok'")
    ends = [good.select("case_id", F.col(f"{s}_id").alias("window_id"), F.col(f"{s}_position").alias("position")) for s in ("reference", "moving")]
    windows = ends[0].unionByName(ends[1]).distinct()
    best = parent_edges(good.where("reference_position < moving_position"))
    best = best.select("case_id", F.col("moving_id").alias("window_id"), F.col("reference_id").alias("parent_id"), *sim3.GAUGE_COLUMNS, F.col("cov").alias("edge_cov"))
    same = {c: 1.0 if c in {"scale", "r11", "r22", "r33"} else 0.0 for c in sim3.GAUGE_COLUMNS}
    start = durable(windows.join(best, _KEY, "left"))
    hops = start.select(
        *_KEY, F.coalesce("parent_id", "window_id").alias("root_id"), F.col("parent_id").isNotNull().cast("bigint").alias("depth"),
        *[F.coalesce(c, F.lit(v)).alias(c) for c, v in same.items()],
    )
    hops, moving = durable(hops.withColumn("done", F.col("depth") == 0)), True
    while moving:
        ahead = hops.select("case_id", F.col("root_id").alias("next_id"), F.col("depth").alias("more"), F.col("window_id").alias("root_id"), *[F.col(c).alias(f"up_{c}") for c in sim3.GAUGE_COLUMNS])
        step = attach(hops.where("NOT done"), ahead, ["case_id", "root_id"], "inner", salt=SALT, salt_by=_KEY)
        step = step.select(*_KEY, F.col("next_id").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), *_composed("up_", ""), (F.col("more") == 0).alias("done"))
        hops = durable(hops.where("done").unionByName(step))
        moving = not hops.where("NOT done").isEmpty()
    first = start.groupBy("case_id").agg(F.min_by("window_id", "position").alias("first_id"))
    out = attach(hops.drop("done").join(start.select(*_KEY, "position", "parent_id", "edge_cov"), _KEY), first, ["case_id"], salt_by=_KEY)
    status = F.when(F.col("root_id") == F.col("first_id"), "ok").when(F.col("depth") == 0, "no-causal-overlap").otherwise("detached")
    return durable(out.withColumn("status", status).drop("first_id"))  # read by paths, steps and sums


def ancestors(tree: DataFrame) -> DataFrame:
    """``(case, window, ancestor, steps)``: every window with itself (0 steps) and all windows above it."""
    known = durable(tree.where("parent_id IS NOT NULL").select(*_KEY, F.col("parent_id").alias("ancestor_id"), F.lit(1).cast("bigint").alias("steps")))
    reach, last = 1, known
    while not last.isEmpty():  # last: the pairs at exactly ``reach`` steps
        above = known.select("case_id", F.col("window_id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id"), F.col("steps").alias("more"))
        more = attach(last, above, ["case_id", "ancestor_id"], "inner", salt=SALT, salt_by=_KEY)
        more = more.select(*_KEY, F.col("next_id").alias("ancestor_id"), (F.col("steps") + F.col("more")).alias("steps"))
        known = durable(known.unionByName(more))
        reach *= 2
        last = known.where(F.col("steps") == reach)
    own = tree.select(*_KEY, F.col("window_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("steps"))
    return known.unionByName(own)


# --- Jacobians of a batch -----------------------------------------------------------------------


def _right_jacobians(w: np.ndarray) -> np.ndarray:
    return np.array([sim3.right_jacobian(v) for v in w]).reshape(-1, 3, 3)


def _transforms(b: pd.DataFrame, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = b[[f"{prefix}{c}" for c in sim3.ROT]].to_numpy(float).reshape(-1, 3, 3)
    return b[f"{prefix}scale"].to_numpy(float), r, b[[f"{prefix}t{a}" for a in "xyz"]].to_numpy(float)


def _carry(at: tuple[np.ndarray, ...], to: tuple[np.ndarray, ...]) -> np.ndarray:
    """Derivative of vector(``to``) by vector(``at``), with the transform between the two held fixed."""
    _, ra, ta = at
    _, rt, tt = to
    out = np.zeros((len(ta), 7, 7))
    turn = _right_jacobians(sim3.so3_logs(ra))
    out[:, 0, 0] = 1.0
    back = np.linalg.inv(_right_jacobians(sim3.so3_logs(rt))) if len(ta) else turn
    out[:, 1:4, 1:4] = back @ np.swapaxes(rt, 1, 2) @ ra @ turn
    gap = tt - ta
    cross = np.zeros((len(ta), 3, 3))
    for i, j, k, sign in ((0, 1, 2, -1), (0, 2, 1, 1), (1, 0, 2, 1), (1, 2, 0, -1), (2, 0, 1, -1), (2, 1, 0, 1)):
        cross[:, i, j] = sign * gap[:, k]
    out[:, 4:7, 0] = gap
    out[:, 4:7, 1:4] = -cross @ ra @ turn
    out[:, 4:7, 4:7] = np.eye(3)
    return out


def _edge_steps(tree: DataFrame) -> DataFrame:
    """``(case, window, step)``: the covariance that a window's own edge adds (a root: the start covariance)."""
    edge = tree.select(*_KEY, "parent_id", "edge_cov", *sim3.GAUGE_COLUMNS)
    up = tree.select("case_id", F.col("window_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in sim3.GAUGE_COLUMNS])
    joined = attach(edge.where("parent_id IS NOT NULL"), up, ["case_id", "parent_id"], "inner", salt=SALT, salt_by=_KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, rp, _ = _transforms(b, "p_")
            _, rw, _ = _transforms(b, "")
            j = np.zeros((len(b), 7, 7))
            j[:, 0, 0] = 1.0
            # the parent's rotation and this window's give the edge's
            turn = _right_jacobians(sim3.so3_logs(np.swapaxes(rp, 1, 2) @ rw))
            j[:, 1:4, 1:4] = np.linalg.solve(_right_jacobians(sim3.so3_logs(rw)), turn)
            j[:, 4:7, 4:7] = s[:, None, None] * rp
            c = np.array([np.asarray(v, float) for v in b["edge_cov"]]).reshape(-1, 7, 7)
            yield b[_KEY].assign(step=list((j @ c @ np.swapaxes(j, 1, 2)).reshape(-1, 49)))

    types = {f.name: f.dataType.simpleString() for f in tree.schema.fields}
    steps = joined.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in _KEY) + ", step array<double>")
    roots = tree.where("parent_id IS NULL").select(*_KEY, F.array(*[F.lit(float(v)) for v in START.ravel()]).alias("step"))
    return steps.unionByName(roots)


def tree_covariances(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """``tree`` with ``cov``, 49 values: every edge on a window's path, carried to the window and summed.

    ``paths`` are the `ancestors` of the same tree.  The sums combine before the shuffle.
    """
    at = tree.select("case_id", F.col("window_id").alias("ancestor_id"), *[F.col(c).alias(f"a_{c}") for c in sim3.GAUGE_COLUMNS])
    at = at.join(_edge_steps(tree).withColumnRenamed("window_id", "ancestor_id"), ["case_id", "ancestor_id"])
    rows = attach(paths, tree.select(*_KEY, *sim3.GAUGE_COLUMNS), _KEY, "inner", salt=SALT, salt_by=[*_KEY, "ancestor_id"])
    rows = attach(rows, at, ["case_id", "ancestor_id"], "inner", salt=SALT, salt_by=[*_KEY, "ancestor_id"])  # the wide rows come last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            j = _carry(_transforms(b, "a_"), _transforms(b, ""))
            c = np.array([np.asarray(v, float) for v in b["step"]]).reshape(-1, 7, 7)
            m = (j @ c @ np.swapaxes(j, 1, 2)).reshape(-1, 49)
            yield b[_KEY].assign(**{f"c{i}": m[:, i] for i in _ALL})

    types = {f.name: f.dataType.simpleString() for f in tree.schema.fields}
    parts = rows.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in _KEY) + "".join(f", c{i} double" for i in _ALL))
    cov = parts.groupBy(*_KEY).agg(F.array(*[F.sum(f"c{i}") for i in _ALL]).alias("cov"))
    return tree.join(cov, _KEY)


def tree_blocks(solved: DataFrame, paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(case, window_i, window_j, block)`` for the named ``pairs`` (case_id, window_i, window_j).

    What two windows share goes through their lowest common ancestor, so a block is that window's
    covariance carried to both.  Pairs below different roots have no block.  ``solved`` is from
    `tree_covariances`; the blocks feed `gaussian.gauge_query` and `tracks.joint_link_evidence`.
    """
    # a window's path is one array, from itself upwards, so a pair stays one row and moves once for each of its ends
    path = F.transform(F.array_sort(F.collect_list(F.struct("steps", "ancestor_id"))), lambda s: s["ancestor_id"])
    ends = durable(solved.select(*_KEY, *sim3.GAUGE_COLUMNS).join(paths.groupBy(*_KEY).agg(path.alias("path")), _KEY))
    meet = pairs.select("case_id", "window_i", "window_j").distinct()
    for s in "ij":
        side = ends.select("case_id", F.col("window_id").alias(f"window_{s}"), F.col("path").alias(f"path_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in sim3.GAUGE_COLUMNS])
        meet = attach(meet, side, ["case_id", f"window_{s}"], "inner", salt=SALT, salt_by=["window_i", "window_j"])
    meet = meet.withColumn("ancestor_id", F.get(F.array_intersect("path_i", "path_j"), F.lit(0))).drop("path_i", "path_j")
    # two windows meet in one that has others below it, unless they are one and the same
    above = solved.where("parent_id IS NOT NULL").select("case_id", F.col("parent_id").alias("window_id"))
    same = pairs.where("window_i = window_j").select("case_id", F.col("window_i").alias("window_id"))
    tops = solved.select(*_KEY, "cov", *sim3.GAUGE_COLUMNS).join(above.unionByName(same).distinct(), _KEY, "left_semi")
    tops = tops.select("case_id", F.col("window_id").alias("ancestor_id"), "cov", *[F.col(c).alias(f"a_{c}") for c in sim3.GAUGE_COLUMNS])
    meet = attach_few(meet.where("ancestor_id IS NOT NULL"), durable(tops), ["case_id", "ancestor_id"], "inner", salt_by=["window_i", "window_j"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = _transforms(b, "a_")
            c = np.array([np.asarray(v, float) for v in b["cov"]]).reshape(-1, 7, 7)
            m = _carry(at, _transforms(b, "i_")) @ c @ np.swapaxes(_carry(at, _transforms(b, "j_")), 1, 2)
            yield b[["case_id", "window_i", "window_j"]].assign(block=list(m.reshape(-1, 49)))

    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in ("case_id", "window_i", "window_j")) + ", block array<double>"
    return meet.mapInPandas(run, schema)
