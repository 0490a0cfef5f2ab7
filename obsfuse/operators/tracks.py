"""Track building inside a window, linking between windows, point-set matching."""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from obsfuse.functions import vec3 as v3
from obsfuse.operators.joins import spatial_pairs
from obsfuse.operators.project import link_likelihood
from obsfuse.runtime import attach, durable, maybe_broadcast, violations

WINDOW = ["case_id", "window_id"]
PIXEL = [*WINDOW, "frame", "row", "col"]
NODE = [*WINDOW, "local", "row", "col"]
#: Pixels of the largest image whose cells `spatial_seeds` takes in one group.
GROUP_PIXELS = 65_536


# --- seeds ---------------------------------------------------------------------------------


def spatial_seeds(
    df: DataFrame,
    height: int,
    width: int,
    stride: int = 8,
    grid: tuple[int, int] = (4, 4),
    maximum_per_cell: int | None = None,
    regular: bool = False,
    keys: Sequence[str] = tuple(WINDOW),
) -> DataFrame:
    """Seed pixels per window with image-cell stratification.

    ``df`` holds the admissible pixels of the seed frame.  Regular: every stride-th pixel,
    optionally the first few per cell.  Stratified: in each cell anchors (centre first)
    take their nearest unused pixel in turn; a group is a small image or a cell, a bounded piece of a large one.
    """
    keys = list(keys)
    gr, gc = min(height, grid[0]), min(width, grid[1])
    rb = np.linspace(0, height, gr + 1, dtype=np.int64)
    cb = np.linspace(0, width, gc + 1, dtype=np.int64)

    def cell(c: str, bounds: np.ndarray) -> Column:
        return sum((F.when(F.col(c) >= int(b), 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))

    pix = df.select(*keys, "row", "col").distinct()
    pix = pix.withColumns({"cell_row": cell("row", rb), "cell_col": cell("col", cb)})
    pix = pix.withColumn("cell_id", F.col("cell_row") * gc + F.col("cell_col"))
    if regular:
        kept = pix.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
        if maximum_per_cell is not None:
            w = W.partitionBy(*keys, "cell_id").orderBy("row", "col")
            kept = kept.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= maximum_per_cell)
        return kept.select(*keys, "row", "col", "cell_id")

    def anchors(lo: int, hi: int) -> list[int]:
        mid = lo + (hi - lo - 1) // 2
        first = lo + min(stride // 2, max(hi - lo - 1, 0))
        return [mid, *[v for v in range(first, hi, stride) if v != mid]]

    types = {f.name: f.dataType.simpleString() for f in pix.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", row int, col int, cell_id int"

    def pick(table: pa.Table) -> pa.Table:
        # the rows of a group in scan order of each cell: the first minimum is the tie rule
        spot = np.column_stack([table.column(c).to_numpy() for c in ("cell_id", "row", "col")]).astype(np.int64)
        spot = spot[np.lexsort(spot.T[::-1])]
        starts = np.flatnonzero(np.diff(spot[:, 0], prepend=-1))
        out = []
        for pts in np.split(spot, starts[1:]):
            i, j = divmod(int(pts[0, 0]), gc)
            # squares up to the largest image are exact; a pixel that was taken is beyond all of them
            left, found = len(pts), 0
            taken = np.zeros(len(pts))
            for r, c in itertools.product(anchors(int(rb[i]), int(rb[i + 1])), anchors(int(cb[j]), int(cb[j + 1]))):
                if not left or (maximum_per_cell is not None and found >= maximum_per_cell):
                    break
                k = int(np.argmin((pts[:, 1] - r) ** 2 + (pts[:, 2] - c) ** 2 + taken))
                taken[k] = np.inf
                left, found = left - 1, found + 1
                out.append(pts[k])
        rows = np.array(out, dtype=np.int64).reshape(-1, 3)
        names = [table.column(k).take(pa.array(np.zeros(len(rows), dtype=np.int64))) for k in keys]
        return pa.table([*names, *[pa.array(rows[:, n].astype(np.int32)) for n in (1, 2, 0)]], names=[*keys, "row", "col", "cell_id"])

    # small images are one group, so that a group is worth its call; pieces of larger ones are
    group = keys if height * width <= GROUP_PIXELS else [*keys, "cell_id"]
    return pix.select(*keys, "row", "col", "cell_id").groupBy(*group).applyInArrow(pick, schema)


# --- causal linking -----------------------------------------------------------------------------


@dataclass(frozen=True)
class LinkConfig:
    radius: int = 4
    maximum_error: float = 0.05
    sigma: float | None = None
    minimum_link: float = 0.05
    minimum_length: int = 2
    require_target_deform: bool = False


def pixel_links(pix: DataFrame, config: LinkConfig) -> DataFrame:
    """The successor of every usable pixel in the next frame of its window, for all frames at once.

    ``pix``: one row per pixel with its frame number ``local`` inside the window.  Pixels meet their candidates in
    square tiles: a pixel of the next frame goes to every tile that it can be reached from, and the join tells the
    distance on both axes.  So each pixel is shuffled once, a target twice or thrice, whatever the radius.  ``why``
    is null where the pixel links to (``to_row``, ``to_col``).
    """
    sigma = config.sigma if config.sigma is not None else config.maximum_error / 3.0
    r = config.radius
    side = max(4, 4 * r)

    def tile(c: Column) -> Column:
        return F.floor(c / F.lit(side)).cast("int")

    here = pix.where("valid AND deform")
    ahead = here.select(
        *NODE, *[(F.col(c) + F.col(f"f{c}")).alias(f"p{c}") for c in "xyz"], (F.col("local") + 1).alias("to_local"), tile(F.col("row")).alias("__tr"), tile(F.col("col")).alias("__tc")
    )
    target = pix.where("valid").select(
        *WINDOW, F.col("local").alias("to_local"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), "x", "y", "z", F.col("deform").alias("nd")
    )
    target = target.select("*", F.explode(F.sequence(tile(F.col("to_row") - r), tile(F.col("to_row") + r))).alias("__tr"))
    target = target.select("*", F.explode(F.sequence(tile(F.col("to_col") - r), tile(F.col("to_col") + r))).alias("__tc"))
    near = ahead.join(target, [*WINDOW, "to_local", "__tr", "__tc"]).where((F.abs(F.col("to_row") - F.col("row")) <= r) & (F.abs(F.col("to_col") - F.col("col")) <= r))
    error = v3.norm(v3.sub(v3.vec(), v3.vec("p")))  # type: ignore[arg-type]
    usable = F.col("nd") if config.require_target_deform else F.lit(True)
    found = near.groupBy(*NODE).agg(
        F.array_sort(F.collect_list(F.when(usable, F.struct(error.alias("error"), F.col("to_row"), F.col("to_col"))))).alias("c")
    )
    out = here.select(*NODE).join(found, NODE, "left")
    out = out.withColumns({"best": F.get("c", F.lit(0)), "second": F.get("c", F.lit(1))["error"]})
    out = out.withColumn("link", link_likelihood(F.col("best.error"), F.col("second"), sigma))
    why = (
        F.when(F.col("c").isNull(), "no-candidate")
        .when(F.col("best").isNull(), "target-mask")
        .when(F.col("best.error") > config.maximum_error, "step-error")
        .when(F.col("link") < config.minimum_link, "low-probability")
    )
    return out.select(*NODE, "best.error", "best.to_row", "best.to_col", "link", why.alias("why"))


def _chains(start: DataFrame, links: DataFrame, frames: int) -> DataFrame:
    """``(window, track_id, local, row, col)``: the successors of every start pixel, by doubled pointers.

    Round k appends to the first 2^k pixels of each chain the 2^k behind them, so ``frames`` frames take
    log2(frames) rounds.  Chains that meet are not parted here.
    """
    at = start.select(*WINDOW, "track_id", "local", "row", "col")
    jump = links.where("why IS NULL").select(*NODE, "to_row", "to_col")
    width = 1
    while width < frames:
        ahead = at.join(jump, NODE).select(*WINDOW, "track_id", (F.col("local") + width).alias("local"), F.col("to_row").alias("row"), F.col("to_col").alias("col"))
        at = durable(at.unionByName(ahead))
        width *= 2
        if width < frames:
            far = jump.select(*WINDOW, (F.col("local") - width // 2).alias("local"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("r2"), F.col("to_col").alias("c2"))
            jump = durable(jump.join(far, [*WINDOW, "local", "to_row", "to_col"]).select(*NODE, F.col("r2").alias("to_row"), F.col("c2").alias("to_col")))
    return at


def _claims(moves: DataFrame) -> DataFrame:
    """Moves of chains with ``loss``: the frame at which the track gave way to another one, null for never.

    Several pixels may link to one; the pixel with the likeliest, then closest link keeps it, then the one
    of the track with the least number.  A chain that gave way runs along the pixels of the other from there on,
    so it only has to be told from the live ones where two links are exactly equal.
    """
    node = [*WINDOW, "local", "to_row", "to_col"]
    ties = moves.groupBy(*node, "link", "error").agg(F.count_distinct(F.struct("row", "col")).alias("n")).where("n > 1")
    tied, live = not ties.isEmpty(), moves
    while True:
        mine = F.struct((-F.col("link")).alias("l"), F.col("error"), F.col("track_id"), F.col("row"), F.col("col"))
        claim = live.groupBy(*node).agg(F.min(mine).alias("w"))
        judged = moves.join(claim, node).withColumn("lost", (F.col("row") != F.col("w.row")) | (F.col("col") != F.col("w.col")))
        loss = judged.groupBy(*WINDOW, "track_id").agg(F.min(F.when(F.col("lost"), F.col("local"))).alias("loss"))
        judged = durable(judged.drop("w", "lost").join(loss, [*WINDOW, "track_id"]))
        now = judged.where("loss IS NULL OR local <= loss")
        if not tied or now.drop("loss").exceptAll(live.select(now.drop("loss").columns)).isEmpty() and live.count() == now.count():
            return judged
        live = now.drop("loss")


def causal_tracklets(
    samples: DataFrame, causal_stop: int, seeds: DataFrame, config: LinkConfig = LinkConfig()  # noqa: B008
) -> tuple[DataFrame, DataFrame]:
    """Prefix-only tracks from scene flow; returns (track rows, termination counts).

    All frames are linked in one pass; tracks are chains of these links, laid out by pointer doubling, and
    end where another track has the better claim to a pixel.  No step depends on the number of frames but the
    log2 rounds of the doubling.  Track numbers count the kept tracks of a window by seed row and column.
    """
    elig = samples.where(F.col("frame") < causal_stop)
    frames = elig.select(*WINDOW, "frame").distinct()
    order = W.partitionBy(*WINDOW).orderBy("frame")  # one row per frame of a window
    frames = frames.withColumn("local", F.row_number().over(order) - 1)
    pix = durable(
        attach(elig, frames, [*WINDOW, "frame"], salt_by=["row", "col"]).select(
            *WINDOW, "frame", "local", "row", "col", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "fx", "fy", "fz")],
            F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("deform", F.lit(False)).alias("deform"),
        )
    )
    start = pix.where("local = 0 AND valid AND deform").join(seeds.select(*WINDOW, "row", "col"), [*WINDOW, "row", "col"])
    number = W.partitionBy(*WINDOW).orderBy("row", "col")
    start = durable(start.select(*WINDOW, (F.row_number().over(number) - 1).cast("bigint").alias("track_id"), "local", "row", "col"))
    if start.isEmpty():
        raise ValueError("no valid deforming seed in the first retained frame")
    last = frames.groupBy(*WINDOW).agg(F.max("local").alias("last"))
    links = durable(pixel_links(pix, config))
    chains = _chains(start, links, int(last.agg(F.max("last")).first()[0]) + 1)
    moves = durable(chains.join(links.where("why IS NULL").drop("why"), NODE))
    judged = _claims(moves)
    went = judged.where("loss IS NULL OR local < loss").select(
        *WINDOW, "track_id", (F.col("local") + 1).alias("local"), F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("link").alias("link_probability")
    )
    rows = start.withColumn("link_probability", F.lit(1.0)).unionByName(went)
    so_far = W.partitionBy(*WINDOW, "track_id").orderBy("local")  # the frames of one track
    whole = W.partitionBy(*WINDOW, "track_id")
    rows = rows.withColumns({
        "association_probability": F.exp(F.sum(F.log("link_probability")).over(so_far)), "length": F.count(F.lit(1)).over(whole), "end": F.max("local").over(whole)
    })
    rows = durable(rows)
    # why tracks end: at a claim, at a pixel without successor, or with the window
    ends = rows.where("local = end").join(links.select(*NODE, "why"), NODE, "left")
    ends = ends.join(judged.where("local = loss").select(*WINDOW, "track_id", F.lit(True).alias("beaten")), [*WINDOW, "track_id"], "left").join(last, WINDOW)
    usable = pix.where("valid AND deform").select(*NODE, F.lit(True).alias("usable"))
    ends = ends.join(usable, NODE, "left")
    reason = (
        F.when(F.col("beaten"), "collision")
        .when(F.col("local") == F.col("last"), None)
        .when(F.col("usable").isNull(), "invalid-source")
        .otherwise(F.col("why"))
    )
    short = F.when(F.col("length") < config.minimum_length, "short")
    report = ends.select(*WINDOW, F.explode(F.array_compact(F.array(reason, short))).alias("reason"))
    kept = rows.where(F.col("length") >= config.minimum_length)
    names = kept.where("local = 0").select(*WINDOW, "track_id", (F.row_number().over(W.partitionBy(*WINDOW).orderBy("track_id")) - 1).cast("bigint").alias("number"))
    out = kept.join(names, [*WINDOW, "track_id"]).join(pix.select(*NODE, "frame", "x", "y", "z"), NODE)
    out = out.select(*WINDOW, F.col("number").alias("track_id"), "frame", F.col("local").alias("local_frame"), "row", "col", "x", "y", "z", "link_probability", "association_probability")
    return out, report.groupBy(*WINDOW, "reason").agg(F.count(F.lit(1)).alias("tracks"))


def track_probability(tracks: DataFrame, keys: Sequence[str] = (*WINDOW, "track_id")) -> DataFrame:
    """Length-neutral geometric mean of link probabilities per track."""
    return tracks.groupBy(*keys).agg(F.exp(F.avg(F.log("link_probability"))).alias("geometric_mean"), F.count(F.lit(1)).alias("length"))


# --- cross-window linking ------------------------------------------------------------------------


@dataclass(frozen=True)
class AssociationConfig:
    distance: float | None = 0.10
    minimum_shared_frames: int = 2
    minimum_support: float = 1.0
    distance_scale: float = 0.02
    maximum_rms: float = 0.05
    minimum_score: float = 0.05
    minimum_margin: float = 0.05
    #: Refuse more gated pairs than this; None takes any number.
    maximum_pairs: int | None = None


#: tracks of one side that meet in one task, and of one side that are compared at once.
PAIR_TRACKS, PAIR_BLOCK = 8192, 1024


def _crowded(left: DataFrame, right: DataFrame, distance: float) -> tuple[bool, int, int]:
    """Whether a grid would meet a good part of all pairs of tracks, and the tracks of both sides."""
    cell = [F.floor(F.col(c) / F.lit(distance)).cast("bigint").alias(f"g{c}") for c in "xyz"]
    a, b = (df.groupBy("frame", *cell).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "a"), (right, "b")))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    for c in "xyz":
        b = b.withColumn("__o", step).withColumn(f"g{c}", F.col(f"g{c}") + F.col("__o")).drop("__o")
    met = a.join(b, ["frame", "gx", "gy", "gz"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0.0
    n, m = (df.select("track_id").distinct().count() for df in (left, right))
    return 8.0 * met >= float(n) * m, n, m


def _track_layers(ids: np.ndarray, frames: np.ndarray, cols: list[np.ndarray], lo: int, hi: int) -> dict:
    """Frame -> layers of one row per track, for the tracks from ``lo`` to ``hi``: presence, weight, weight known, point, point known."""
    out: dict = {}
    mine = np.flatnonzero((ids >= lo) & (ids < hi))
    mine = mine[np.lexsort((ids[mine], frames[mine]))]
    at, when = ids[mine], frames[mine]
    again = np.zeros(len(mine), dtype=np.int64)  # rows of one track and frame lie in layers of their own
    for i in range(1, len(mine)):
        if at[i] == at[i - 1] and when[i] == when[i - 1]:
            again[i] = again[i - 1] + 1
    for key in np.unique(np.stack([when, again], axis=1), axis=0).tolist():
        sel = (when == key[0]) & (again == key[1])
        rows, place = mine[sel], at[sel] - lo
        here, weighed, known = (np.zeros(hi - lo) for _ in range(3))
        here[place], weighed[place] = 1.0, ~np.isnan(cols[3][rows])
        point, weight = np.zeros((3, hi - lo)), np.zeros(hi - lo)
        xyz = np.stack([c[rows] for c in cols[:3]])
        fine = ~np.isnan(xyz).any(axis=0)
        known[place] = fine
        point[:, place] = np.where(fine, xyz, 0.0)
        weight[place] = np.nan_to_num(cols[3][rows])
        out.setdefault(key[0], []).append((here, weight, weighed, point, known))
    return out


def _pair_blocks(
    left: DataFrame, right: DataFrame, config: AssociationConfig, n: int, m: int, best: bool, gauge_blocks: DataFrame | None = None, packed: bool = False
) -> DataFrame:
    """Scores of all gated pairs, compared in blocks of tracks: every pair of tracks meets in exactly one task.

    Rows are copied once for each block of the other side, pairs are never shuffled.  With ``best`` only pairs stay that
    are among the two best of a track (equal scores included) within their block.  With ``gauge_blocks`` rows carry what
    :func:`joint_link_evidence` takes, and pairs get their ``normalized_rms``.  ``packed`` gives them as arrays, one row for
    each left track and block compared, without the score and the largest distance.
    """
    parts = [max(-(-k // PAIR_TRACKS), min(10, -(-k // 256)), 1) for k in (n, m)]
    cols = ["x", "y", "z", "association_probability"]

    def side(df: DataFrame, own: int, is_left: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("track_id"), F.lit(parts[own])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(parts[1 - own] - 1)))
        more = [] if gauge_blocks is None else ["case_id", "window_id", F.col("window_id").alias("__with"), F.concat("jacobian", F.array(*[f"k_{s}" for s in v3.SYM])).alias("__joint")]
        rows = df.where("track_id IS NOT NULL AND frame IS NOT NULL").select(F.lit(is_left).alias("__left"), "track_id", "frame", *[F.col(c).cast("double").alias(c) for c in cols], *more, mine.alias("__m")).select("*", other.alias("__o"))
        names = ("__i", "__j") if is_left else ("__j", "__i")
        return rows.withColumnsRenamed(dict(zip(("__m", "__o"), names, strict=True)))

    kind = left.schema["track_id"].dataType.simpleString()
    schema = f"left_id {kind}, right_id {kind}, shared_frames bigint, support double, maximum_distance double, rms double, score double"
    judged = gauge_blocks is not None
    if judged:
        schema += ", normalized_rms double"
    if packed:
        schema = schema.replace(", maximum_distance double", "").replace(", score double", "")
        schema = ", ".join(f"{c} {t}" if c == "left_id" else f"{c} array<{t}>" for c, t in (part.split() for part in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        gauge = table.filter(pc.is_null(table["__left"]))
        table = table.filter(pc.is_valid(table["__left"])).sort_by("track_id")
        frames = table["frame"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        isl = table["__left"].to_numpy()
        sides = []
        for sel in (isl, ~isl):
            part = table.filter(pa.array(sel))
            code = part["track_id"].combine_chunks().dictionary_encode()
            values = [part[c].to_numpy().astype(float) for c in cols]
            sides.append((code.dictionary, code.indices.to_numpy(zero_copy_only=False), frames[sel], values))
        (lid, lc, lf, lv), (rid, rc, rf, rv) = sides
        evidence = None if not judged else _Evidence(*[table.filter(pa.array(sel)) for sel in (isl, ~isl)], gauge, sides)
        rights = [(c, min(c + PAIR_BLOCK, len(rid))) for c in range(0, len(rid), PAIR_BLOCK)]
        right_layers = [_track_layers(rc, rf, rv, *r) for r in rights]
        for lo in range(0, len(lid), PAIR_BLOCK):
            hi = min(lo + PAIR_BLOCK, len(lid))
            here = _track_layers(lc, lf, lv, lo, hi)
            for (c0, c1), there in zip(rights, right_layers, strict=True):
                found = _compare(here, there, hi - lo, c1 - c0, config, best)
                if not len(found[0]):
                    continue
                i, j, *values = found
                if evidence is not None:
                    values.append(evidence.of(lo, hi, c0, c1, i, j))
                values = [v if isinstance(v, pa.Array) else pa.array(v) for v in values]
                if packed:  # pairs come in the order of their left tracks
                    del values[4], values[2]
                    starts = np.flatnonzero(np.diff(i, prepend=-1))
                    ends = pa.array(np.append(starts, len(i)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, v) for v in (rid.take(pa.array(c0 + j)), *values)]
                    yield pa.RecordBatch.from_arrays([lid.take(pa.array(lo + i[starts])), *lists], schema_names)
                else:
                    yield pa.RecordBatch.from_arrays([lid.take(pa.array(lo + i)), rid.take(pa.array(c0 + j)), *values], schema_names)

    schema_names = [part.split()[0] for part in schema.split(", ")]
    both = side(left, 0, True).unionByName(side(right, 1, False))
    if gauge_blocks is not None:
        at = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c) for c, k in zip(("__i", "__j"), parts, strict=True)]
        known = gauge_blocks.select("case_id", F.col("window_i").alias("window_id"), F.col("window_j").alias("__with"), F.col("block").alias("__joint"))
        both = both.unionByName(known.select("*", at[0]).select("*", at[1]), allowMissingColumns=True)
    return both.groupBy("__i", "__j").applyInArrow(run, schema)


class _Evidence:
    """Normalised RMS of pairs of tracks in a block under the covariance of their gauges, by frames.

    The parts of a residual's covariance that one side gives are computed once for each row, those of both sides from
    the left Jacobian times the shared gauge block.  Rows whose windows have no such block count nowhere.
    """

    def __init__(self, left: pa.Table, right: pa.Table, gauge: pa.Table, sides: list, floor: float = 1e-12) -> None:
        self.floor, self.sides = floor, []
        names = [gauge[c].to_pylist() for c in ("case_id", "window_id", "__with")]
        values = np.array(gauge["__joint"].to_pylist(), float).reshape(-1, 7, 7)
        self.blocks = dict(zip(zip(*names, strict=True), values, strict=True))
        sym, upper = [0, 1, 2, 1, 3, 4, 2, 4, 5], [0, 1, 2, 4, 5, 8]
        for table, (_, code, frame, cols) in zip((left, right), sides, strict=True):
            flat = table["__joint"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 27)
            jac, spread = flat[:, :21].reshape(-1, 3, 7), flat[:, 21:][:, sym].reshape(-1, 3, 3)
            places = list(zip(table["case_id"].to_pylist(), table["window_id"].to_pylist(), strict=True))
            known = {p: k for k, p in enumerate(dict.fromkeys(places))}
            place = np.array([known[p] for p in places], dtype=np.int64)
            for (case, window), k in known.items():
                own = self.blocks.get((case, window, window))
                rows = place == k
                spread[rows] = np.nan if own is None else spread[rows] + jac[rows] @ own @ np.swapaxes(jac[rows], 1, 2)
            order = np.lexsort((frame, code))
            again = np.zeros(len(code), dtype=np.int64)  # rows of one track and frame lie in layers of their own
            for i in np.flatnonzero((np.diff(code[order]) == 0) & (np.diff(frame[order]) == 0)) + 1:
                again[order[i]] = again[order[i - 1]] + 1
            self.sides.append((code, frame, again, np.stack(cols[:3], axis=1), cols[3], spread.reshape(-1, 9)[:, upper], jac, place, list(known)))
        self.turned: dict = {}

    def _layers(self, side: int, lo: int, hi: int) -> dict:
        code, frame, again = self.sides[side][:3]
        out: dict = {}
        mine = np.flatnonzero((code >= lo) & (code < hi))
        for key in np.unique(np.stack([frame[mine], again[mine]], axis=1), axis=0).tolist():
            rows = mine[(frame[mine] == key[0]) & (again[mine] == key[1])]
            at = np.full(hi - lo, -1, dtype=np.int64)
            at[code[rows] - lo] = rows
            out.setdefault(key[0], []).append(at)
        return out

    def of(self, lo: int, hi: int, c0: int, c1: int, i: np.ndarray, j: np.ndarray) -> pa.Array:
        here, there = self._layers(0, lo, hi), self._layers(1, c0, c1)
        meets = [(a, b) for f in sorted(here.keys() & there.keys()) for a in here[f] for b in there[f]]
        top, total, some = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i), dtype=bool)
        for start in range(0, len(i), 32_768):
            s = slice(start, start + 32_768)
            for a, b in meets:
                x, y = a[i[s]], b[j[s]]
                k = np.flatnonzero((x >= 0) & (y >= 0))
                w, q = self._rows(x[k], y[k])
                fine, k = ~np.isnan(w), start + k
                total[k[fine]] += w[fine]
                fine &= ~np.isnan(q)
                top[k[fine]] += (w * q)[fine]
                some[k[fine]] = True
        none = ~some | (total == 0)
        return pa.array(np.sqrt(np.divide(top, total, out=np.zeros(len(i)), where=~none)), mask=none)

    def _rows(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and normalised squared residual of pairs of rows; a pair without its gauge blocks has no weight."""
        (_, _, _, lp, lw, ls, lj, lk, lnames), (_, _, _, rp, rw, rs, rj, rk, rnames) = self.sides
        w, q = np.full(len(x), np.nan), np.full(len(x), np.nan)
        both = lk[x] * len(rnames) + rk[y]
        for at in np.unique(both).tolist():
            (case, one), (other_case, two) = lnames[at // len(rnames)], rnames[at % len(rnames)]
            block = self.blocks.get((case, one, two))
            if case != other_case or block is None or not {(case, one, one), (case, two, two)} <= self.blocks.keys():
                continue
            if at not in self.turned:
                self.turned[at] = lj @ block
            k = np.flatnonzero(both == at)
            a, b = self.turned[at][x[k]], rj[y[k]]
            xx, xy, xz, yy, yz, zz = ls[x[k]].T + rs[y[k]].T

            def cross(m: int, n: int, a: np.ndarray = a, b: np.ndarray = b) -> np.ndarray:
                return np.einsum("ij,ij->i", a[:, m], b[:, n])

            xx, yy, zz = (v - 2 * cross(m, m) + self.floor for m, v in enumerate((xx, yy, zz)))
            xy, xz, yz = (v - cross(m, n) - cross(n, m) for (m, n), v in (((0, 1), xy), ((0, 2), xz), ((1, 2), yz)))
            d = lp[x[k]] - rp[y[k]]
            e, f, g = d.T
            c0, c1, c2 = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
            c3, c4, c5 = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
            det = xx * c0 + xy * c1 + xz * c2
            bad = ~((xx > 0) & (c5 > 0) & (det > 1e-6 * (np.abs(xx + yy + zz) / 3) ** 3))
            value = (c0 * e * e + c3 * f * f + c5 * g * g + 2 * (c1 * e * f + c2 * e * g + c4 * f * g)) / np.where(bad, 1.0, det) / 3.0
            if bad.any():  # nearly singular: by eigenvalues, not below the floor
                full = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1)[bad].reshape(-1, 3, 3)
                sound = np.isfinite(full).all(axis=(1, 2))
                size, axes = np.linalg.eigh(full[sound])
                turned = np.einsum("nji,nj->ni", axes, d[bad][sound])
                part = np.full(len(full), np.nan)
                part[sound] = (turned * turned / np.maximum(size, self.floor)).sum(axis=1) / 3.0
                value[bad] = part
            w[k], q[k] = lw[x[k]] * rw[y[k]], value
        return w, q


def _compare(here: dict, there: dict, n: int, m: int, config: AssociationConfig, best: bool) -> tuple[np.ndarray, ...]:
    """Gated pairs of two blocks of tracks with their sums over shared frames."""
    limit = config.distance * config.distance
    meets = [(a, b) for f in sorted(here.keys() & there.keys()) for a in here[f] for b in there[f]]

    def products(k: int) -> np.ndarray:
        total = np.zeros((n, m))
        if meets:
            total += np.stack([a[k] for a, _ in meets], axis=1) @ np.stack([b[k] for _, b in meets])
        return total

    shared, support = products(0), products(1)
    weighed = products(2) if any((p != c).any() for pair in meets for p, _, c, _, _ in pair) else None
    wd2, peak, gate = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m), dtype=bool)
    buffers = [np.empty((128, m)) for _ in range(2)]
    near = np.empty((128, m), dtype=bool)
    for lo in range(0, n, 128):
        s = slice(lo, min(lo + 128, n))
        (d2, t), hit = (b[: s.stop - lo] for b in buffers), near[: s.stop - lo]
        for (_, lw, _, lx, lk), (_, rw, _, rx, rk) in meets:
            np.subtract(lx[0][s, None], rx[0], out=d2)
            np.multiply(d2, d2, out=d2)
            for c in (1, 2):
                np.subtract(lx[c][s, None], rx[c], out=t)
                np.multiply(t, t, out=t)
                np.add(d2, t, out=d2)
            np.less_equal(d2, limit, out=hit)
            hit &= lk[s, None] > 0
            hit &= rk > 0
            gate[s] |= hit
            np.multiply(lk[s, None], rk, out=t)
            np.multiply(d2, t, out=d2)
            np.maximum(peak[s], d2, out=peak[s])
            np.multiply(lw[s, None], rw, out=t)
            np.multiply(d2, t, out=d2)
            np.add(wd2[s], d2, out=wd2[s])
    sound = gate & (support > 0)
    rms = np.full((n, m), np.nan)
    np.sqrt(np.divide(wd2, support, out=rms, where=sound), out=rms, where=sound)
    score = _score(support, rms, config)
    if best:
        able = np.where(sound & (shared >= config.minimum_shared_frames), score, -1.0)
        kept = np.zeros((n, m), dtype=bool)
        for axis in (0, 1):
            second = np.partition(able, -2, axis=axis).take([-2], axis=axis) if able.shape[axis] > 1 else -1.0
            kept |= (able > -1.0) & (able >= second)
        gate = kept
    i, j = np.nonzero(gate)
    no_weight = weighed[i, j] == 0 if weighed is not None else None
    values = [shared[i, j].astype(np.int64), pa.array(support[i, j], mask=no_weight), np.sqrt(peak[i, j])]
    null = ~sound[i, j]
    return i, j, *values, *[pa.array(v[i, j], mask=null) for v in (rms, score)]


def _score(support: np.ndarray, rms: np.ndarray, config: AssociationConfig) -> np.ndarray:
    return np.minimum(1.0, support / config.minimum_support) * np.exp(-0.5 * (rms / config.distance_scale) ** 2)


def candidate_scores(left: DataFrame, right: DataFrame, config: AssociationConfig = AssociationConfig(), best: bool = False) -> DataFrame:  # noqa: B008
    """Score every spatially gated pair over all its shared frames (world coordinates).

    Where a grid would meet a good part of all pairs, blocks of tracks are compared instead (:func:`_pair_blocks`);
    ``best`` then leaves out pairs that :func:`mutual_links` cannot choose.
    """
    if config.distance is None:
        raise ValueError("an exhaustive pairing is not built; give a gating distance")
    crowded, n, m = _crowded(left, right, config.distance)
    if crowded and config.maximum_pairs is None:
        pairs = _pair_blocks(left, right, config, n, m, best)
        return durable(pairs) if best else pairs  # both sides of the links read the few pairs that are left
    gate = spatial_pairs(left, right, config.distance)
    if config.maximum_pairs is not None:
        gate = durable(gate)
        if gate.limit(config.maximum_pairs + 1).count() > config.maximum_pairs:
            raise ValueError("spatial candidate count exceeds the configured maximum")
    cols = ["frame", "x", "y", "z", "association_probability"]
    l = left.select(F.col("track_id").alias("left_id"), "frame", *[F.col(c).alias(f"l{c}") for c in cols[1:]])  # noqa: E741
    r = right.select(F.col("track_id").alias("right_id"), "frame", *[F.col(c).alias(f"r{c}") for c in cols[1:]])
    j = gate.join(l, "left_id").join(r, ["right_id", "frame"])
    d = v3.sub(v3.vec("l"), v3.vec("r"))
    d2 = v3.dot(d, d)  # type: ignore[arg-type]
    w = F.col("lassociation_probability") * F.col("rassociation_probability")
    agg = j.withColumns({"d2": d2, "w": w}).groupBy("left_id", "right_id").agg(
        F.count(F.lit(1)).alias("shared_frames"), F.sum("w").alias("support"),
        F.sum(F.col("w") * F.col("d2")).alias("wd2"), F.sqrt(F.max("d2")).alias("maximum_distance"),
    )
    rms = F.sqrt(F.col("wd2") / F.col("support"))
    score = F.least(F.lit(1.0), F.col("support") / config.minimum_support) * F.exp(
        F.lit(-0.5) * F.pow(F.col("rms") / config.distance_scale, F.lit(2.0))
    )
    return agg.withColumn("rms", F.when(F.col("support") > 0, rms)).withColumn("score", F.when(F.col("support") > 0, score))


def gated_pairs(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """:func:`joins.spatial_pairs` of tracks; crowded ones are compared in blocks, so that no pair is shuffled."""
    crowded, n, m = _crowded(left, right, distance)
    if not crowded:
        return spatial_pairs(left, right, distance)
    return _pair_blocks(left, right, AssociationConfig(distance=distance), n, m, False).select("left_id", "right_id")


def mutual_links(candidates: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:  # noqa: B008
    """Mutual best candidates with both margins and the gate verdict.

    Ranking is (score desc, rms, support desc, other id); ``row_number <= 2`` per side is
    pruned before the shuffle, so a track with many candidates stays cheap.
    """
    usable = candidates.where((F.col("shared_frames") >= config.minimum_shared_frames) & (F.col("support") > 0))

    def side(own: str, other: str) -> DataFrame:
        w = W.partitionBy(own).orderBy(F.col("score").desc(), "rms", F.col("support").desc(), other)
        top = usable.withColumn("k", F.row_number().over(w)).where("k <= 2")
        pick = F.struct(other, "score", "rms", "support", "shared_frames", "maximum_distance")
        g = top.groupBy(own).agg(F.max(F.when(F.col("k") == 1, pick)).alias("b"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("s"))
        return g.select(own, "b.*", F.greatest(F.lit(0.0), F.col("b.score") - F.coalesce("s", F.lit(0.0))).alias("margin"))

    left = side("left_id", "right_id").withColumnRenamed("margin", "left_margin")
    right = side("right_id", "left_id").select("right_id", F.col("left_id").alias("best_left"), F.col("margin").alias("right_margin"))
    j = left.join(right, "right_id", "left")
    verdict = (
        F.when(~F.col("best_left").eqNullSafe(F.col("left_id")), "non-mutual")
        .when((F.col("left_margin") < config.minimum_margin) | (F.col("right_margin") < config.minimum_margin), "ambiguous")
        .when(
            (F.col("support") < config.minimum_support) | (F.col("rms") > config.maximum_rms) | (F.col("score") < config.minimum_score),
            "below-threshold",
        )
        .otherwise("linked")
    )
    return j.withColumn("verdict", verdict)


def link_accounting(candidates: DataFrame, links: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:  # noqa: B008
    """Counts of gated, insufficient, zero- and low-support pairs and of verdicts."""
    few = F.col("shared_frames") < config.minimum_shared_frames

    def n(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)

    a = candidates.agg(
        F.count(F.lit(1)).alias("gated_pairs"),
        n(few, "insufficient_shared_frames"),
        n(~few & (F.col("support") <= 0), "zero_support"),
        n(~few & (F.col("support") > 0) & (F.col("support") < config.minimum_support), "low_support"),
    )
    b = links.agg(*[n(F.col("verdict") == v, v.replace("-", "_")) for v in ("linked", "non-mutual", "ambiguous", "below-threshold")])
    return a.crossJoin(b)


def joint_covariance_evidence(pairs: DataFrame, blocks: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Normalised RMS of candidate pairs with shared gauge covariance (diagnostic only).

    ``pairs``: left_id, right_id, case_id, left_window, right_window, residual d*, weight w,
    conditional covariances a_c_*/b_c_* and Jacobians jl, jr (21).  Uses the three gauge
    blocks of the two windows; score and ranking stay geometric.
    """
    b = blocks.select("case_id", "window_i", "window_j", "block")

    def block(i: str, j: str, name: str) -> DataFrame:
        return b.withColumnsRenamed({"window_i": i, "window_j": j, "block": name})

    j = pairs.join(block("left_window", "right_window", "plr"), ["case_id", "left_window", "right_window"])
    for side, name in (("left_window", "pll"), ("right_window", "prr")):
        own = b.where("window_i = window_j").select("case_id", F.col("window_i").alias(side), F.col("block").alias(name))
        j = j.join(own, ["case_id", side])
    cov = [f"{p}_c_{s}" for p in "ab" for s in v3.SYM]
    need = ["left_id", "right_id", "dx", "dy", "dz", "w", "jl", "jr", "pll", "prr", "plr", *cov]
    kinds = {f.name: f.dataType.simpleString() for f in j.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            jl = np.array(p["jl"].tolist(), float).reshape(-1, 3, 7)
            jr = np.array(p["jr"].tolist(), float).reshape(-1, 3, 7)
            ll, rr, lr = (np.array(p[c].tolist(), float).reshape(-1, 7, 7) for c in ("pll", "prr", "plr"))
            sym = [0, 1, 2, 1, 3, 4, 2, 4, 5]
            base = sum(p[[f"{s}_c_{n}" for n in v3.SYM]].to_numpy(float)[:, sym].reshape(-1, 3, 3) for s in "ab")
            cross = jl @ lr @ np.swapaxes(jr, 1, 2)
            total = base + jl @ ll @ np.swapaxes(jl, 1, 2) + jr @ rr @ np.swapaxes(jr, 1, 2) - cross - np.swapaxes(cross, 1, 2)
            w, v = np.linalg.eigh(total + floor * np.eye(3))
            d = np.einsum("nji,nj->ni", v, p[["dx", "dy", "dz"]].to_numpy(float))
            yield pd.DataFrame(
                {"left_id": p["left_id"], "right_id": p["right_id"], "w": p["w"], "q": (d * d / np.maximum(w, floor)).sum(axis=1) / 3.0}
            )

    out = j.select(*need).mapInPandas(run, f"left_id {kinds['left_id']}, right_id {kinds['right_id']}, w double, q double")
    return out.groupBy("left_id", "right_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("q")) / F.sum("w")).alias("normalized_rms"), F.count(F.lit(1)).alias("frames")
    )


def joint_link_evidence(left: DataFrame, right: DataFrame, blocks: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:  # noqa: B008
    """Candidates of :func:`candidate_scores` with ``normalized_rms`` under the joint gauge covariance.

    Track rows carry case_id, window_id, world points, their conditional covariance k_* and the 3 x 7 ``jacobian`` of
    the gauge (as :func:`stack_factors` gives them).  ``blocks`` is the covariance of all gauges, one row for each
    ordered pair of windows: a candidate meets the blocks (left, left), (right, right) and (left, right).  Support,
    score and ranking stay geometric; the covariance only normalises the residuals.
    """
    crowded, n, m = _crowded(left, right, config.distance) if config.distance is not None else (False, 0, 0)
    if crowded and config.maximum_pairs is None:
        return _pair_blocks(left, right, config, n, m, False, blocks)
    candidates = durable(candidate_scores(left, right, config))

    def side(rows: DataFrame, name: str, cov: str) -> DataFrame:
        return rows.select(
            F.col("track_id").alias(f"{name}_id"), "case_id", F.col("window_id").alias(f"{name}_window"), "frame", *[F.col(c).alias(f"{name[0]}{c}") for c in "xyz"],
            F.col("association_probability").alias(f"{name[0]}p"), F.col("jacobian").alias(f"j{name[0]}"), *[F.col(f"k_{s}").alias(f"{cov}_c_{s}") for s in v3.SYM],
        )

    pairs = candidates.select("left_id", "right_id").join(side(left, "left", "a"), "left_id").join(side(right, "right", "b"), ["right_id", "case_id", "frame"])
    gap = v3.named(v3.sub(v3.vec("l"), v3.vec("r")), ["dx", "dy", "dz"])  # type: ignore[arg-type]
    pairs = pairs.select("*", *gap, (F.col("lp") * F.col("rp")).alias("w"))
    return candidates.join(joint_covariance_evidence(pairs, blocks).drop("frames"), ["left_id", "right_id"], "left")


#: pairs of tracks whose candidates may meet in one task to be ranked.
RANKED_PAIRS = 1 << 23


def ranked_link_evidence(
    left: DataFrame, right: DataFrame, blocks: DataFrame, config: AssociationConfig = AssociationConfig(), digits: int = 9  # noqa: B008
) -> DataFrame:
    """:func:`joint_link_evidence` with ``place``: 1 for the candidate of a left track with the highest score, rounded to ``digits``; the smaller right id on ties; without ``maximum_distance``.

    Candidates from blocks of tracks go to their ranks as one row of arrays for each left track and block, without the score, which
    follows from support and RMS; a task gets at most ``RANKED_PAIRS`` of them, so none is sorted on disk.
    """
    crowded, n, m = _crowded(left, right, config.distance) if config.distance is not None else (False, 0, 0)
    if not (crowded and config.maximum_pairs is None):
        order = W.partitionBy("left_id").orderBy(F.round("score", digits).desc(), "right_id")
        return joint_link_evidence(left, right, blocks, config).drop("maximum_distance").withColumn("place", F.row_number().over(order))
    packed = _pair_blocks(left, right, config, n, m, False, blocks, packed=True)
    one, two = (df.schema["track_id"].dataType.simpleString() for df in (left, right))
    schema = f"left_id {one}, right_id {two}, shared_frames bigint, support double, rms double, score double, normalized_rms double, place bigint"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        values = {c: table[c].combine_chunks().flatten() for c in table.column_names if c != "left_id"}
        support, rms = (np.asarray(values[c].to_numpy(zero_copy_only=False), float) for c in ("support", "rms"))
        values["score"] = pa.array(_score(support, rms, config), mask=pc.is_null(values["rms"]).to_numpy(zero_copy_only=False))
        found = pa.table(values)
        order = pa.table({"score": pc.round(found["score"], digits), "right_id": found["right_id"]})
        found = found.take(pc.sort_indices(order, [("score", "descending"), ("right_id", "ascending")], null_placement="at_end"))
        here = pa.nulls(found.num_rows, table.schema.field("left_id").type).fill_null(table["left_id"][0])
        found = found.append_column("left_id", here).append_column("place", pa.array(np.arange(1, found.num_rows + 1)))
        yield from found.select(names).to_batches(max_chunksize=100_000)

    parts = max(-(-n * m // RANKED_PAIRS), left.sparkSession.sparkContext.defaultParallelism)
    return packed.repartition(parts, "left_id").groupBy("left_id").applyInArrow(run, schema)


# --- nearest points --------------------------------------------------------------------------


#: Sources of one tile that a task compares at once; a tile with more of them is copied.
_TILE_SOURCES = 65_536


def nearest_points(
    sources: DataFrame, targets: DataFrame, keys: Sequence[str], source_id: str = "point_id", target_id: str = "point_id", tile: int = 2048, squared: bool = False
) -> DataFrame:
    """Exact nearest target (distance, then id) of every source point within its key.

    With ``squared`` targets are ranked by their squared distance: roots of different squares may be equal.

    The places of a key's targets are cut into tiles of at most ``tile`` (more above 32 million places, so that the
    boxes of all tiles stay a small table), along their widest side.  A source meets the tile whose box is nearest, then
    only the tiles whose box is no farther than what it found.  A source without finite coordinates, or whose key has no
    target with them, gets the smallest id.
    """
    keys = list(keys)

    def finite(side: str) -> Column:
        return functools.reduce(operator.and_, [F.coalesce(F.abs(F.col(f"{side}{c}")) < F.lit(math.inf), F.lit(False)) for c in "xyz"])

    def rank(a: list[Column], b: list[Column]) -> Column:
        square = sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0))
        return square if squared else F.sqrt(square)

    s = sources.select(*keys, F.col(source_id).alias("source_id"), *[F.col(c).cast("double").alias(f"s{c}") for c in "xyz"])
    t = durable(targets.select(*keys, F.col(target_id).alias("target_id"), *[F.col(c).cast("double").alias(f"t{c}") for c in "xyz"]).dropna(subset=keys))
    known = durable(t.groupBy(*keys).agg(F.min(F.struct("target_id", "tx", "ty", "tz")).alias("first"), F.count(F.when(finite("t"), 1)).alias("n")))
    places, boxes = _tiles(t.where(finite("t")).groupBy(*keys, "tx", "ty", "tz").agg(F.min("target_id").alias("target_id")), keys, tile)
    s = s.join(maybe_broadcast(known), keys)
    plain = finite("s") & (F.col("n") > 0)
    odd = s.where(~plain).select(*keys, "source_id", rank([F.col(f"s{c}") for c in "xyz"], [F.col(f"first.t{c}") for c in "xyz"]).alias("rank"), "first.target_id")

    columns = [*keys, "source_id", "sx", "sy", "sz"]
    numbers = {key: i for i, key in enumerate(boxes)}
    fields = [s.schema[k] for k in keys]
    table = s.sparkSession.createDataFrame([(*key, i) for key, i in numbers.items()], StructType([*fields, StructField("number", LongType())]))
    start = s.where(plain).select(*columns).join(F.broadcast(table), keys, "left").withColumns({"tile": F.lit(0).cast("long"), "rank": F.lit(None).cast("double")})
    visits = _visits(list(boxes.values()), squared)
    first = durable(_meet_tiles(durable(start.mapInArrow(visits, start.schema)), places, keys, squared))
    more = first.where("number IS NOT NULL").drop("target_id").select(*start.columns)
    found = first.unionByName(_meet_tiles(durable(more.mapInArrow(visits, start.schema)), places, keys, squared))
    found = found.groupBy(*keys, "source_id").agg(F.min(F.struct("rank", "target_id")).alias("m")).select(*keys, "source_id", "m.rank", "m.target_id")
    return found.unionByName(odd).select(*keys, "source_id", (F.sqrt("rank") if squared else F.col("rank")).alias("distance"), "target_id")


def _tiles(places: DataFrame, keys: list[str], tile: int) -> tuple[DataFrame, dict[tuple, tuple[np.ndarray, ...]]]:
    """``places`` with their ``tile``, and tiles with their boxes of each key that has several.

    A tile with too many places is cut at up to 16 quantiles of its widest side, and half way along it, until none is left.
    """
    places = durable(places.withColumn("tile", F.lit(0).cast("long")))
    size = max(tile, -(-places.count() // 16_384))
    side = [F.min(f"t{c}").alias(f"low_{c}") for c in "xyz"] + [F.max(f"t{c}").alias(f"high_{c}") for c in "xyz"]
    while True:
        crowded = places.groupBy(*keys, "tile").agg(F.count(F.lit(1)).alias("n"), *side, *[F.percentile_approx(f"t{c}", [i / 16 for i in range(1, 16)]).alias(f"q_{c}") for c in "xyz"])
        crowded = crowded.where(F.col("n") > size)
        wide = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in "xyz"])
        axis = F.when(F.col("high_x") - F.col("low_x") == wide, "x").when(F.col("high_y") - F.col("low_y") == wide, "y").otherwise("z")
        low, high, q = (_of_axis(F.col("axis"), name) for name in ("low_", "high_", "q_"))
        middle = low / 2 + high / 2
        ways = F.least(F.lit(16), F.ceil(F.col("n") / F.lit(size)))
        some = F.transform(F.sequence(F.lit(1), ways - 1), lambda i: F.element_at(q, F.least(F.lit(15), F.greatest(F.lit(1), F.round(i * 16 / ways)).cast("int"))))
        cuts = F.array_distinct(F.concat(some, F.array(F.when(middle < high, middle).otherwise(low))))
        cut = durable(crowded.withColumn("axis", axis).select(*keys, "tile", "axis", cuts.alias("cuts")))
        if cut.isEmpty():
            break
        # equal hashes would only make one tile of two
        part = F.size(F.filter("cuts", lambda c: c < _of_axis(F.col("axis"), "t")))
        places = places.join(F.broadcast(cut), [*keys, "tile"], "left").withColumn("tile", F.when(F.col("cuts").isNull(), F.col("tile")).otherwise(F.xxhash64("tile", part)))
        places = durable(places.drop("axis", "cuts"))
    boxes: dict[tuple, list[tuple]] = {}
    for r in places.where("tile <> 0").groupBy(*keys, "tile").agg(*side).collect():
        boxes.setdefault(tuple(r[: len(keys)]), []).append(tuple(r[len(keys) :]))
    return places, {k: (np.array([b[0] for b in v], np.int64), np.array([b[1:4] for b in v]), np.array([b[4:] for b in v])) for k, v in boxes.items()}


def _of_axis(axis: Column, prefix: str) -> Column:
    return F.when(axis == "x", F.col(f"{prefix}x")).when(axis == "y", F.col(f"{prefix}y")).otherwise(F.col(f"{prefix}z"))


def _visits(boxes: list[tuple[np.ndarray, ...]], squared: bool):
    """Rows of sources with the tile to visit: without a rank the nearest one, with a rank all others that may hold a better target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch["number"].fill_null(-1).to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False).astype(float)
            point = np.column_stack([batch[f"s{c}"].to_numpy(zero_copy_only=False) for c in "xyz"])
            small = np.flatnonzero(number < 0)
            rows, tiles = [small], [np.zeros(len(small), np.int64)]
            for i in np.unique(number[number >= 0]):
                own, low, high = boxes[i]
                of = np.flatnonzero(number == i)
                step = max(1, 1_000_000 // len(own))
                for at in range(0, len(of), step):
                    k = of[at : at + step]
                    gap = sum(np.maximum(np.maximum(low[:, c] - point[k, c, None], point[k, c, None] - high[:, c]), 0.0) ** 2 for c in range(3))
                    near = gap.argmin(axis=1)
                    seen = ~np.isnan(rank[k])
                    bound = rank[k] if squared else rank[k] ** 2
                    with np.errstate(invalid="ignore"):
                        visit = gap <= (bound * (1 + 1e-12) + 1e-300)[:, None]
                    visit[~seen] = False
                    visit[np.arange(len(k)), near] = ~seen
                    r, c = np.nonzero(visit)
                    rows.append(k[r])
                    tiles.append(own[c])
            out = batch.take(pa.array(np.concatenate(rows), pa.int64()))
            out = out.set_column(out.schema.get_field_index("tile"), "tile", pa.array(np.concatenate(tiles), pa.int64()))
            out = out.set_column(out.schema.get_field_index("rank"), "rank", pa.nulls(out.num_rows, pa.float64()))
            for at in range(0, out.num_rows, 10_000):
                yield out.slice(at, 10_000)

    return run


def _meet_tiles(visits: DataFrame, places: DataFrame, keys: list[str], squared: bool) -> DataFrame:
    """The nearest target of each visiting source in its tile, as ``rank`` and ``target_id``."""
    many = visits.groupBy(*keys, "tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(_TILE_SOURCES)).cast("int").alias("parts")).where("parts > 1")
    many = F.broadcast(durable(many))
    left = visits.join(many, [*keys, "tile"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("source_id", "sx", "sy", "sz"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    right = places.join(many, [*keys, "tile"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    schema = StructType([*visits.schema.fields, StructField("target_id", places.schema["target_id"].dataType)])

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({f.name: mine[f.name][:0] if f.name != "target_id" else theirs["target_id"][:0] for f in schema})
        theirs = theirs.sort_by("target_id")
        x, y, z = (theirs[f"t{c}"].to_numpy() for c in "xyz")
        at = [mine[f"s{c}"].to_numpy()[:, None] for c in "xyz"]
        best, rank = np.empty(mine.num_rows, np.int64), np.empty(mine.num_rows)
        step = max(1, 131_072 // len(x))
        for k in range(0, mine.num_rows, step):
            e = slice(k, k + step)
            d = at[0][e] - x
            d *= d
            for other, c in ((at[1], y), (at[2], z)):
                g = other[e] - c
                g *= g
                d += g
            if not squared:
                np.sqrt(d, out=d)
            best[e] = d.argmin(axis=1)
            rank[e] = d[np.arange(len(d)), best[e]]
        new = {"rank": pa.array(rank), "target_id": theirs["target_id"].take(pa.array(best))}
        return pa.table({f.name: new.get(f.name, mine[f.name] if f.name in mine.column_names else None) for f in schema})

    by = [*keys, "tile", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def point_set_metrics(a: DataFrame, b: DataFrame, keys: Sequence[str], near: Sequence[float] = (0.01, 0.02)) -> DataFrame:
    """Directed and symmetric mean distances, p95 and coverage at fixed distances."""
    from obsfuse.operators.ranking import exact_quantiles

    keys = list(keys)
    ab, ba = durable(nearest_points(a, b, keys)), nearest_points(b, a, keys)
    f = ab.groupBy(*keys).agg(
        F.avg("distance").alias("forward_mean"), F.count(F.lit(1)).alias("points"),
        *[F.avg(F.when(F.col("distance") <= n, 1.0).otherwise(0.0)).alias(f"coverage_{i}") for i, n in enumerate(near)],
    )
    r = ba.groupBy(*keys).agg(F.avg("distance").alias("backward_mean"))
    p = exact_quantiles(ab, keys, "distance", {"forward_p95": 0.95}).drop("n")
    return f.join(r, keys).join(p, keys).withColumn("symmetric_mean", (F.col("forward_mean") + F.col("backward_mean")) / 2.0)


# --- forecasts and ensembles -------------------------------------------------------------------


def anchored_rollout(
    points: DataFrame, nodes: DataFrame, endpoint: int, keys: Sequence[str] = ("case_id",), offset: bool = True
) -> DataFrame:
    """Attach points to their nearest trajectory node at ``endpoint`` and follow it.

    Position(t) = node(t) + (point - node(endpoint)), or node(t) without offset.
    """
    keys = list(keys)
    at = nodes.where(F.col("frame") == endpoint)
    near = nearest_points(points, at, keys, "point_id", "node_id", squared=True)
    base = at.select(*keys, F.col("node_id").alias("target_id"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    own = points.select(*keys, F.col("point_id").alias("source_id"), "x", "y", "z")
    off = near.join(base, [*keys, "target_id"]).join(own, [*keys, "source_id"])
    k = 1.0 if offset else 0.0
    off = off.select(*keys, "source_id", "target_id", *[(F.lit(k) * (F.col(c) - F.col(f"n{c}"))).alias(f"o{c}") for c in "xyz"])
    path = nodes.select(*keys, F.col("node_id").alias("target_id"), "frame", "x", "y", "z")
    j = path.join(off, [*keys, "target_id"])
    return j.select(*keys, F.col("source_id").alias("point_id"), "frame", *[(F.col(c) + F.col(f"o{c}")).alias(c) for c in "xyz"])


def flow_methods(samples: DataFrame, fit_end: int) -> DataFrame:
    """Zero, visual, physics, fixed half mix and inverse-training-MSE mix on test frames.

    ``samples``: frame, truth flow t*, visual flow v*, physics flow p*.  The scalar weight
    comes from one aggregation over training frames and is attached as one broadcast row.
    """
    def sq(a: str) -> Column:
        d = v3.sub(v3.vec(a), v3.vec("t"))
        return v3.dot(d, d)  # type: ignore[arg-type]

    mse = samples.where(F.col("frame") < fit_end).agg((F.avg(sq("v")) / 3).alias("mv"), (F.avg(sq("p")) / 3).alias("mp"))
    weight = mse.select((F.col("mp") / F.greatest(F.col("mv") + F.col("mp"), F.lit(2.220446049250313e-16))).alias("wv"))
    test = samples.where(F.col("frame") >= fit_end).crossJoin(F.broadcast(weight))
    v, p, z = v3.vec("v"), v3.vec("p"), (F.lit(0.0),) * 3
    k = F.col("wv")
    methods = {
        "zero": z, "visual": v, "physics": p,
        "fixed_mix": tuple(0.5 * (a + b) for a, b in zip(v, p, strict=True)),
        "calibrated_mix": tuple(k * a + (1 - k) * b for a, b in zip(v, p, strict=True)),
    }
    entries = F.array(
        *[F.struct(F.lit(n).alias("method_id"), v3.norm(v3.sub(f, v3.vec("t"))).alias("error")) for n, f in methods.items()]  # type: ignore[arg-type]
    )
    return test.select("wv", F.inline(entries)).groupBy("method_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_epe"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.max("wv").alias("visual_weight")
    )


def ensemble_covariance(members: DataFrame, keys: Sequence[str], shrinkage: float = 0.2, floor: float = 6.25e-8) -> DataFrame:
    """Sample mean and shrunk covariance over stochastic members per key."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    a = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(c) for c in "xyz"],
        *[F.covar_samp(i, j).alias(f"q_{s}") for s, (i, j) in zip(v3.SYM, pairs, strict=True)],
    ).where("members >= 2")
    iso = (F.col("q_xx") + F.col("q_yy") + F.col("q_zz")) / 3.0
    diag = {"xx", "yy", "zz"}
    return a.select(
        *keys, "members", "x", "y", "z",
        *[((1 - shrinkage) * F.col(f"q_{s}") + ((shrinkage * iso + floor) if s in diag else F.lit(0.0))).alias(f"c_{s}") for s in v3.SYM],
    )


def error_moment(errors: DataFrame, keys: Sequence[str] = (), shrinkage: float = 0.2, floor: float = 6.25e-8) -> DataFrame:
    """Second moment about zero (keeps systematic bias), shrunk to isotropic."""
    e = v3.vec("e")
    a = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"q_{s}") for c, s in zip(v3.outer_sym(e), v3.SYM, strict=True)])
    iso = (F.col("q_xx") + F.col("q_yy") + F.col("q_zz")) / 3.0
    diag = {"xx", "yy", "zz"}
    return a.select(*keys, "n", *[((1 - shrinkage) * F.col(f"q_{s}") + ((shrinkage * iso + floor) if s in diag else F.lit(0.0))).alias(f"c_{s}") for s in v3.SYM])


def nis_scale(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Covariance scale that brings the mean normalised squared error to 3."""
    return rows.groupBy(*keys).agg(F.greatest(F.avg(v3.mahalanobis2(v3.sym(), v3.vec("e"))) / 3.0, F.lit(2.220446049250313e-16)).alias("scale"))


def forecast_comparison(truth: DataFrame, forecasts: DataFrame, visible: str = "visible") -> DataFrame:
    """Error summary of forecast methods on visible and on all tracks, per method and scope."""
    from obsfuse.operators.scores import error_summary

    t = truth.select("case_id", "point_id", "frame", visible, *[F.col(c).alias(f"t{c}") for c in "xyz"])
    j = forecasts.join(t, ["case_id", "point_id", "frame"])
    j = j.withColumn("error", v3.norm(v3.sub(v3.vec(), v3.vec("t"))))  # type: ignore[arg-type]
    scope = F.explode(F.when(F.col(visible), F.array(F.lit("visible"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    return error_summary(j.withColumn("scope", scope), ["method_id", "scope"], "error")


def assert_unique_tracks(tracks: DataFrame) -> None:
    violations(tracks.groupBy("window_id", "track_id", "frame").count().where("count > 1"), "repeated track frame")
