"""Support of target units by calibration units: quantile embeddings and neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsfuse.operators import ranking as rk
from obsfuse.runtime import attach, durable

#: normal-consistency factors of the MAD and the inter-quartile range; fixed values.
MAD_SCALE, IQR_SCALE = 1.4826022185056018, 1.3489795003921634

#: most centres of `source_cells` (bounds the broadcast), and the room left for rounding in distance bounds.
CENTRES, SLACK = 4096, 1e-9


def unit_embeddings(rows: DataFrame, size: int, levels: Sequence[float] = (0.1, 0.5, 0.9), unit: str = "unit_id") -> DataFrame:
    """Per unit: exact quantile levels of every feature, feature-major, plus row count."""
    long = rows.select(unit, F.posexplode("features").alias("f", "v"))
    q = rk.exact_quantiles(long, [unit, "f"], "v", {f"q{i}": p for i, p in enumerate(levels)})
    item = F.struct("f", F.array(*[F.col(f"q{i}") for i in range(len(levels))]).alias("q"))
    return q.groupBy(unit).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["q"])).alias("embedding"),
        F.max("n").alias("rows"),
    )


def robust_scale(embeddings: DataFrame, absolute_floor: float = 1e-6, relative_floor: float = 1e-3) -> DataFrame:
    """One row: centre (median), scale max(MAD, IQR, floor), minimum and maximum per entry."""
    long = embeddings.select("unit_id", F.posexplode("embedding").alias("i", "v"))
    q = rk.exact_quantiles(long, ["i"], "v", {"med": 0.5, "q1": 0.25, "q3": 0.75}).drop("n")
    ext = long.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.abs("v")).alias("peak"))
    dev = long.join(F.broadcast(q), "i").withColumn("a", F.abs(F.col("v") - F.col("med")))  # one row per embedding entry
    mad = rk.exact_quantiles(dev, ["i"], "a", {"mad": 0.5}).drop("n")
    j = q.join(ext, "i").join(mad, "i")
    ref = F.greatest(F.abs("med"), F.col("peak"), F.lit(1.0))
    scale = F.greatest(
        MAD_SCALE * F.col("mad"), (F.col("q3") - F.col("q1")) / IQR_SCALE, F.lit(absolute_floor) + relative_floor * ref
    )
    item = F.array_sort(F.collect_list(F.struct("i", F.col("med").alias("c"), scale.alias("s"), "lo", "hi")))
    p = j.agg(item.alias("p"))
    # arrays of structs expose their fields as arrays
    return p.select(F.col("p.c").alias("center"), F.col("p.s").alias("scale"), F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))


def _distance(a: Column, b: Column, scale: Column) -> Column:
    z = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scale, lambda d, s: d / s)
    return F.sqrt(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(a))


def source_cells(sources: DataFrame, scale: DataFrame, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Sources around centres: (one row of cells with centre, radius, size and parts; sources packed by cell and part).

    Centres are the sources with the smallest hash, at most ``CENTRES`` of them.  A cell of many sources (near
    or equal ones) has several parts, so no packed array holds much more than ``block`` units.
    """
    cells = min(CENTRES, max(1, math.ceil(sources.count() / block)))
    chosen = sources.orderBy(F.xxhash64("unit_id"), "unit_id").limit(cells)
    centres = chosen.agg(F.array_sort(F.collect_list(F.struct("unit_id", F.col("embedding").alias("centre")))).alias("__p"))
    centres = centres.crossJoin(scale.select(F.col("scale").alias("__scale")))  # two one-row tables
    away = F.transform("__p", lambda p: _distance(F.col("embedding"), p["centre"], F.col("__scale")))
    homes = durable(
        sources.crossJoin(F.broadcast(centres)).withColumn("__away", away)
        .select("unit_id", "embedding", F.array_min("__away").alias("__d"), (F.array_position("__away", F.array_min("__away")) - 1).alias("__b"))
    )
    sizes = homes.groupBy("__b").agg(F.max("__d").alias("radius"), F.count(F.lit(1)).alias("n"))
    table = sizes.crossJoin(F.broadcast(centres)).select(
        F.struct("__b", F.col("__p")[F.col("__b").cast("int")]["centre"].alias("centre"), "radius", "n", F.ceil(F.col("n") / block).alias("parts")).alias("c"), "__scale"
    )
    table = table.groupBy().agg(F.array_sort(F.collect_list("c")).alias("__cells"), F.first("__scale").alias("__scale"))  # at most CENTRES entries
    parts = sizes.select("__b", F.ceil(F.col("n") / block).alias("parts"))
    packed = homes.join(F.broadcast(parts), "__b")  # at most CENTRES rows
    packed = packed.withColumn("__part", F.pmod(F.xxhash64("unit_id", F.lit("part")), F.col("parts")))
    return table, packed.groupBy("__b", "__part").agg(F.collect_list(F.struct("unit_id", "embedding")).alias("__s"))


def cell_visits(targets: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """A row per target and cell part that may hold one of its ``k`` nearest sources.

    The k-th distance is at most the bound at which cells, nearest far side first, hold ``k`` sources; a
    cell whose near side lies beyond it is not visited.
    """
    t = targets.crossJoin(F.broadcast(table))
    near = F.transform(
        "__cells",
        lambda c: F.struct((_distance(F.col("embedding"), c["centre"], F.col("__scale")) + c["radius"]).alias("far"), c["n"].alias("n"), c["__b"].alias("__b"), c["radius"].alias("radius"), c["parts"].alias("parts")),
    )
    t = t.withColumn("__near", F.array_sort(near))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("far"))
    bound = F.aggregate("__near", start, lambda a, c: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + c["n"]).alias("n"), c["far"].alias("far"))))
    t = t.withColumn("__bound", bound["far"] * (1 + SLACK) + SLACK)
    t = t.select(*targets.columns, "__scale", F.explode(F.filter("__near", lambda c: c["far"] - 2 * c["radius"] <= F.col("__bound"))).alias("c"))
    return t.select(*targets.columns, "__scale", F.col("c.__b").alias("__b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c.parts") - 1)).alias("__part"))


def nearest_units(
    targets: DataFrame, sources: DataFrame, scale: DataFrame, k: int, exclude_self: bool = False, block: int = 2048
) -> DataFrame:
    """k nearest source units per target by RMS standardised distance, ties by id.

    Sources lie in cells around centres (`source_cells`); a target visits the cells that the triangle
    inequality leaves (`cell_visits`), keeps the k best of each part, and a final top-k merges
    them.  Exact for any number of sources; no target-source pair is ever a row.
    """
    table, packed = source_cells(sources, scale, block)
    j = attach(cell_visits(targets, table, k + int(exclude_self)), packed, ["__b", "__part"], "inner", salt=8, salt_by=["unit_id"])
    pairs = F.transform(
        F.col("__s"), lambda s: F.struct(_distance(s["embedding"], F.col("embedding"), F.col("__scale")).alias("distance"), s["unit_id"].alias("source_id"))
    )
    if exclude_self:
        pairs = F.filter(pairs, lambda p: p["source_id"] != F.col("unit_id"))
    best = j.select("unit_id", F.explode(F.slice(F.array_sort(pairs), 1, k)).alias("p")).select(
        "unit_id", F.col("p.source_id").alias("source_id"), F.col("p.distance").alias("distance")
    )
    w = W.partitionBy("unit_id").orderBy("distance", "source_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fit_transport(sources: DataFrame, k: int = 3, miscoverage: float = 0.1) -> dict[str, DataFrame]:
    """Support model: scale, leave-one-out scores and the threshold over source units."""
    scale = robust_scale(sources)
    loo = nearest_units(sources, sources, scale, k, exclude_self=True).groupBy("unit_id").agg(F.avg("distance").alias("score"))
    rank = F.least(F.col("cum_total"), F.ceil((F.col("cum_total") + 1).cast("double") * F.lit(1.0 - miscoverage)))
    threshold = rk.order_statistic(loo, [], "score", rank, "threshold")
    return {"sources": sources, "scale": scale, "scores": loo, "threshold": threshold}


def evaluate_transport(targets: DataFrame, model: dict[str, DataFrame], k: int, features: int, levels: int) -> DataFrame:
    """Per target: score, p-value (1 + #source >= score)/(M + 1), support, feature distances."""
    near = nearest_units(targets, model["sources"], model["scale"], k)
    score = near.groupBy("unit_id").agg(F.avg("distance").alias("score"))
    # sources at or above a score, from running counts over the distinct scores of both sides
    both = model["scores"].select("score", F.lit(1).alias("m")).unionByName(score.select("score", F.lit(0).alias("m")))
    ranked = rk.with_running(both.groupBy("score").agg(F.sum("m").alias("m")), [], ["score"], {"cum": F.col("m")})
    ranked = ranked.select("score", (F.col("cum_total") - F.col("cum") + F.col("m")).alias("__above"), F.col("cum_total").alias("__all"))
    j = attach(score, ranked, ["score"], "inner", salt_by=["unit_id"]).crossJoin(F.broadcast(model["threshold"].select("threshold")))
    j = j.select(
        "unit_id", "score", "threshold",
        ((1 + F.col("__above")) / (F.col("__all") + 1)).alias("p_value"),
        (F.col("score") <= F.col("threshold")).alias("supported"),
    )
    t = targets.select("unit_id", F.col("embedding").alias("te"), "rows")
    s = model["sources"].select(F.col("unit_id").alias("source_id"), F.col("embedding").alias("se"))
    sc = F.broadcast(model["scale"].select("scale", "lo", "hi"))
    d = near.join(t, "unit_id").join(s, "source_id").crossJoin(sc)
    z2 = F.zip_with(F.zip_with("te", "se", lambda a, b: a - b), F.col("scale"), lambda a, b: (a / b) * (a / b))
    per = d.groupBy("unit_id").agg(*[F.sqrt(F.avg(sum((z2[f * levels + q] for q in range(levels)), F.lit(0.0)) / levels)).alias(f"distance_{f}") for f in range(features)])
    out = t.crossJoin(sc)
    excess = F.transform(
        F.sequence(F.lit(0), F.size("te") - 1),
        lambda i: F.greatest(F.col("lo")[i] - F.col("te")[i], F.col("te")[i] - F.col("hi")[i], F.lit(0.0)) / F.col("scale")[i],
    )
    outside = out.select("unit_id", "rows", *[F.array_max(F.slice(excess, f * levels + 1, levels)).alias(f"outside_{f}") for f in range(features)])
    return j.join(per, "unit_id").join(outside, "unit_id")


def transport_decision(evaluated: DataFrame, maximum_groups: float = 0.0, maximum_rows: float = 0.0) -> DataFrame:
    """Reject when the unsupported group or row fraction exceeds its limit (one row)."""
    bad = ~F.col("supported")
    a = evaluated.agg(
        F.count(F.lit(1)).alias("units"),
        F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("unsupported_unit_fraction"),
        (F.sum(F.when(bad, F.col("rows")).otherwise(0)) / F.sum("rows")).alias("unsupported_row_fraction"),
        F.min("p_value").alias("minimum_p_value"),
    )
    ok = (F.col("unsupported_unit_fraction") <= maximum_groups) & (F.col("unsupported_row_fraction") <= maximum_rows)
    return a.withColumn("accepted", ok)
