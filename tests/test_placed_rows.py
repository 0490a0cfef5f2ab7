"""Samples that lie together by frame stay there: pairs, medians, tiles and neighbours move no row."""

import pytest
from pyspark.sql import functions as F

from obsfuse.operators import disagreement as dis
from obsfuse.operators import joins, project
from obsfuse.runtime import placed


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def samples(spark):
    df = spark.range(3 * 2 * 2 * 16 * 16).selectExpr(
        "concat('c', id div 1024) AS case_id", "concat('w', id div 512 % 2) AS window_id", "id div 256 % 2 AS frame",
        "cast(id div 16 % 16 AS int) AS row", "cast(id % 16 AS int) AS col", "id % 7 + 0.5D AS x", "id % 5 + 0.25D AS y", "id % 11 + 1D AS z", "id % 13 <> 0 AS valid",
    )
    return placed(df.repartition(5, "case_id", "frame"))


def test_rows_stay_where_they_were_written(spark, samples):
    assert "Exchange" not in plan_of(samples.groupBy("case_id", "frame", "row", "col").count())
    both = placed(samples.join(samples.groupBy(*project_key()).agg(F.max("x").alias("m")), project_key()))
    assert both.count() == samples.count() and "Exchange" not in plan_of(both.groupBy(*project_key()).count())
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert "Exchange" not in plan_of(joins.overlap_correspondences(samples, 4)).replace("BroadcastExchange", "")


def project_key() -> list[str]:
    return ["case_id", "window_id", "frame", "row", "col"]


def test_tiles_and_neighbours(spark, samples):
    rows = dis.prior_reliability(dis.point_variances(samples, None))
    picked = project.tile_argmax(rows, 8, digits=9)
    assert "Exchange" not in plan_of(picked)
    found = {}
    frames = {}
    for r in rows.where("valid").collect():
        frames.setdefault((r.case_id, r.window_id, r.frame), []).append((r, (r.x**2 + r.y**2 + r.z**2) ** 0.5, r.var_par + 2 * r.var_lat))
    for key, all_ in frames.items():
        middle = [(sorted(m[k] for m in all_)[(len(all_) - 1) // 2] + sorted(m[k] for m in all_)[len(all_) // 2]) / 2 for k in (1, 2)]
        for r, depth, var in all_:
            score = round(r.prior_reliability * (1 + (depth / middle[0]) ** 2) * middle[1] / var, 9)
            at = (*key, r.row // 8, r.col // 8)
            found[at] = min(found.get(at, (9.0, 0, 0)), (-score, r.row, r.col))
    got = {(r.case_id, r.window_id, r.frame, r.row // 8, r.col // 8): (r.row, r.col) for r in picked.collect()}
    assert got == {k: v[1:] for k, v in found.items()}
    there = {(*k, r.row, r.col) for k, all_ in frames.items() for r, *_ in all_}
    for r in dis.reliability_features(rows).collect():
        around = sum((r.case_id, r.window_id, r.frame, r.row + i, r.col + j) in there for i in (-1, 0, 1) for j in (-1, 0, 1))
        assert r.validity_deficit == pytest.approx(1 - around / 9)


def test_pairs_are_read_once_for_their_fits(spark, monkeypatch):
    """Edges with more pairs than a group may hold say so themselves: no count of the pairs goes ahead."""
    from obsfuse.operators import align

    pairs = spark.range(600).selectExpr("'c' AS case_id", "'w0' AS reference_id", "if(id < 500, 'w1', 'w2') AS moving_id", "id % 9 AS cluster", *[f"sin(id * {i + 2}) AS p{c}" for i, c in enumerate("xyz")])
    pairs = pairs.selectExpr("*", "2 * px + 1 AS sx", "2 * py AS sy", "2 * pz AS sz")
    keys = ["case_id", "reference_id", "moving_id"]
    monkeypatch.setattr(align, "GROUP_PAIRS", 200)
    monkeypatch.setattr(align, "fit_edges_distributed", lambda rest, keys, **o: align.fit_edges(rest, keys, **o).withColumn("iterations", F.lit(-rest.count())))
    got = {r.moving_id: r for r in align.fit_whole_edges(pairs, keys).collect()}
    assert {k: (r.status, r.n) for k, r in got.items()} == {"w1": ("ok", 500), "w2": ("ok", 100)}
    assert got["w1"].iterations == -500 and got["w2"].iterations >= 0
    monkeypatch.setattr(align, "GROUP_PAIRS", 1000)
    monkeypatch.setattr(type(pairs), "groupBy", (lambda real: lambda self, *c: real(self.select("*", F.lit(seen.append(1)).alias("__")).drop("__"), *c))(type(pairs).groupBy))
    seen: list = []
    assert align.fit_whole_edges(pairs, keys).count() == 2 and len(seen) == 1
