"""The finder learns from every row and every example of a row; few and many cells give the same trees."""

import numpy as np

from obsfuse.llm import boosting, pii


def test_every_example_of_every_row_counts(spark):
    rows = [(i, f"call +1 (487) 555-{1000 + i % 7919} or ab{i}c, id {i * 7919}-{i}") for i in range(5000)]
    rows += [(5001, "mail jane@example.org, 4111 1111 1111 1111; " * 100), (5002, None), (5003, "no digits")]
    cells = pii.example_cells(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()
    want = sum(weight for _, text in rows for _, _, weight in pii.examples(text or ""))
    assert sum(c.weight for c in cells) == want  # before: 4,096 rows, 256 examples of each
    assert len({(bytes(c.code), c.label, c.test) for c in cells}) == len(cells) < 5000


def test_histograms_in_tasks_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, size=(2000, 4))
    y = ((x[:, 0] > 20) ^ (x[:, 2] > 9)).astype(float)
    rows = [(bytearray(boosting.codes(v).tobytes()), float(t), 0.5 + (i % 2)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    cells = spark.createDataFrame(rows, "code binary, label double, weight double")
    here = boosting.fit_counted(cells, 4, rounds=8)
    assert ((here.score(x) > 0.5) == y).mean() > 0.97
    monkeypatch.setattr(boosting, "within_limit", lambda df: False)
    there = boosting.fit_counted(cells.repartition(3), 4, rounds=8)
    assert all((a == b).all() for m in ("feature", "limit", "value") for a, b in zip(getattr(here, m), getattr(there, m), strict=True))
