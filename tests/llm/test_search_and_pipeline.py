"""Vector search against brute force, the registered queries, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from common import rows, words
from pyspark.sql import functions as F

from obsfuse.llm import queries, vector_search


@pytest.mark.parametrize("k", [1, 20])
def test_top_k_equals_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(vector_search, "VECTORS", 60)
    rng = np.random.default_rng(k)
    data = [(i, [float(x) for x in rng.integers(-30, 30, 8)]) for i in range(300)]
    data += [(1000 + i, data[7][1]) for i in range(40)]  # one vector many times: ties
    odd = [(2000, None), (2020, [1.0, None]), (2040, [float("nan")]), (2060, [float("inf")]), (None, [1.0]), (2080, [3.0])]
    table = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vector_search.top_k(table, table.where("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    all_ = {i: np.pad(v, (0, 8 - len(v))) for i, v in [*data, (2080, [3.0])]}
    for q in [i for i in all_ if i % 20 == 0]:
        scored = sorted(((-int(v @ all_[q]), i) for i, v in all_.items() if i != q))[:k]
        assert got.pop(q) == [(i, -s) for s, i in scored]
    assert not got
    assert vector_search.top_k(table.limit(0), table.limit(0), k).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(12)
    data = [r[:5] for r in rows(n=40)]
    labels = []
    for i in range(120):  # labelled rows: toxic ones hold one of two words
        toxic = i % 3 == 0
        data.append((4000 + i, " ".join([*words(rng, 30), *(["zargh", "plonk"] if toxic else [])]), "en", "t", 1))
        labels.append((4000 + i, 1, int(toxic)))
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = docs.collect()
        assert all(r.n_chars == len(r.text) for r in left if r.text is not None and r.text != texts.get(r.doc_id))
        if name == "toxicity":
            held = [i for i, _, t in labels if t]
            assert sum(r.doc_id in held for r in left) <= 0.1 * len(held)
            assert sum(r.doc_id is not None and r.doc_id >= 4000 for r in left) >= 0.95 * (len(labels) - len(held))
    assert docs.count() < before
    ids = [r.doc_id for r in left if r.doc_id is not None]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces if p.doc_id is not None} == set(ids)
    assert corpus_pipeline.ORACLE_SQL is None


def test_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in np.floor(8 * rng.standard_normal(32))]) for i in range(3000)]
    data += [(5000 + i, data[3][1]) for i in range(300)] + [(9000, data[4][1])] * 50
    base = spark.createDataFrame(data, "id long, v array<double>")
    left = vector_search.without_surplus(base, 5)
    assert {r["id"] for r in left.where("id >= 5000").collect()} == {5000, 5001, 5002, 5003, 5004, 9000}
    assert left.where("id = 9000").count() == 5
    grid = vector_search.Grid.of(left, 16)
    file = vector_search.approximation_file(left, grid)
    asked = file.where("id % 100 = 0").select(F.col("key").alias("query"), "id", "v")
    read = vector_search.exact_reads(vector_search.scan(file, asked, grid, 5), file, asked, 5)
    assert read.count() < 0.2 * file.count() * asked.count()


def test_fractions_and_large_vectors_are_refused(spark):
    for bad in (0.5, 2.0**40):
        table = spark.createDataFrame([(0, [1.0, bad]), (20, [2.0, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="fractions|exact"):
            vector_search.top_k(table, table)
