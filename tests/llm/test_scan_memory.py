"""The scan of op7 gives up what it finds: a task never holds all bounds that a block leaves."""

import tracemalloc

import numpy as np
import pyarrow as pa

from obsfuse.llm import vector_search


def test_a_block_is_scanned_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(vector_search, "BOUNDS", 20_000)
    rng = np.random.default_rng(3)
    vectors = np.floor(8 * rng.standard_normal((2000, 8)))
    grid = vector_search.Grid(vectors.min(axis=0), vectors.max(axis=0), 2)
    ids = np.arange(2000)
    asked = pa.table({"query": ids[:1500], "id": ids[:1500], "v": list(vectors[:1500])})
    rows, largest = 0, 0
    tracemalloc.start()
    for batch in vector_search._left_of_block(grid.quantised(vectors), ids, ids, asked, grid, 5):
        rows, largest = rows + batch.num_rows, max(largest, batch.num_rows)
        scores = vectors[batch["query"].to_numpy()] * vectors[batch["key"].to_numpy()]
        assert (batch["lower"].to_numpy() <= scores.sum(axis=1)).all() and (scores.sum(axis=1) <= batch["upper"].to_numpy()).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000 and largest <= 20_000
    assert peak < 8 * rows  # the four columns of all rows take 32 bytes each
