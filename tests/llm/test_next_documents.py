"""The next document in the order of ids, over many parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from obsfuse.llm import fingerprints


@pytest.mark.parametrize(("chars", "ranges"), [(1 << 20, 1000), (40, 1000), (40, 3)])
@pytest.mark.parametrize("kind", ["mixed", "one id", "one row", "null ids", "far apart"])
def test_next_document(spark, monkeypatch, chars, ranges, kind):
    monkeypatch.setattr(fingerprints, "RANGES", ranges)
    rng = random.Random(3)
    texts = ["t" * rng.randint(0, 9) + str(i) for i in range(60)]
    ids = {
        "mixed": [rng.choice([None, 7, 7, 7, rng.randint(-50, 5000)]) for _ in texts],
        "one id": [5] * 60,
        "one row": [4],
        "null ids": [None] * 60,
        "far apart": [rng.choice([-(1 << 63), (1 << 63) - 1, i]) for i in range(60)],
    }[kind]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=False)), "doc_id long, text string").repartition(4)
    rows, order = fingerprints.with_next(docs, chars)
    got = rows.withColumn("next", F.lead("text").over(order)).where("NOT guest").collect()
    known = [(r.doc_id, r.text, r.h) for r in docs.withColumn("h", F.xxhash64("text")).collect()]
    known.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = [(r[0], r[1], n[1]) for r, n in zip(known, known[1:] + known[:1], strict=True)]
    assert sorted(((r.doc_id, r.text, r.next) for r in got), key=str) == sorted(want, key=str)
    if chars == 40 and kind in ("mixed", "one id", "null ids"):
        assert len({r.part for r in got}) > 3
