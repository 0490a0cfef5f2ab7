"""Seeds come from groups that are worth a call, whole images where these are small, and are the same from cells."""

from obsfuse.operators import tracks


def test_small_images_are_one_group_and_cells_give_the_same_seeds(spark, monkeypatch):
    df = spark.range(3 * 20 * 30).selectExpr(
        "concat('c', floor(id / 600)) AS case_id", "'w' AS window_id", "cast(floor(id % 600 / 30) AS int) AS row", "cast(id % 30 AS int) AS col"
    ).where("(row * 7 + col * 5) % 3 <> 0")

    def seeds():
        out = tracks.spatial_seeds(df, 20, 30, 4, (3, 2), 4)
        groups = out._jdf.queryExecution().analyzed().toString()
        return sorted(tuple(r) for r in out.collect()), groups.split("FlatMapGroupsInArrow")[1].split("]")[0]

    whole, by_image = seeds()
    monkeypatch.setattr(tracks, "GROUP_PIXELS", 0)
    pieces, by_cell = seeds()
    assert whole == pieces and len(whole) == 3 * 6 * 4
    assert "cell_id" not in by_image and "cell_id" in by_cell
