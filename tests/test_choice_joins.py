"""Joins by example are planned without a broadcast, since examples grow with the rows."""

from __future__ import annotations

import numpy as np

from obsfuse.operators import regress


def test_no_table_of_examples_is_broadcast(spark):
    rows = [(i % 3, f"e{i}", c, [float(i + c), float(c)], "null" if c == 0 else "linked", c == i % 2 + 1) for i in range(12) for c in range(3)]
    df = spark.createDataFrame(rows, "group_id long, example_id string, candidate_id long, features array<double>, kind string, is_true boolean")
    model = regress.ChoiceModel(regress.Standardiser([0.0, 0.0], [1.0, 1.0]), np.array([0.1, 0.2, 0.3]), 1, True)
    out = regress.choice_probabilities(regress.example_weights(df), model)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "example_id" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    got = out.toPandas()
    assert len(got) == 36 and np.allclose(got["w"], 1 / 12)
    assert np.allclose(got.groupby("example_id")["probability"].sum(), 1.0)
