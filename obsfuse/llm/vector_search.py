"""Exact top-k search by inner product with a vector-approximation file.

The file holds one byte for each dimension of a vector, the number of its quantisation cell, beside
the vector itself, and is written once. A search scans the bytes alone, which bound each score from
both sides, in blocks of rows and of queries. Only what the k-th best lower bound of a query leaves
is looked at again: exact vectors are read for the k highest upper bounds first, and then for every
other row whose upper bound reaches the k-th of those scores, so that no unread row can be among the
best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsfuse.llm.store import kept
from obsfuse.runtime import violations

#: Rows of a block of the file and of a block of queries.
VECTORS, QUERIES = 65536, 8192
#: Cells of a dimension.
CELLS = 32
#: Bounds that a task holds at once.
BOUNDS = 1 << 22


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and all its components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(column), size))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def without_surplus(rows: DataFrame, k: int) -> DataFrame:
    """``rows(id, v)`` without copies that no list of ``k`` can hold.

    Equal vectors have equal scores, so only the ``k + 1`` smallest ids of a vector (one may be the
    query's own) and ``k`` repeats of each can be listed. Both ranks are limited before rows move.
    """
    repeat = F.row_number().over(Window.partitionBy("id", "v").orderBy(F.lit(0)))
    rows = rows.withColumn("n", repeat).where(F.col("n") <= k).drop("n")
    return rows.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")


class Grid:
    """Start and width of the cells of each dimension: whole numbers, so that bounds are exact."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> None:
        self.low, self.width = low, np.maximum(np.ceil((high - low + 1) / cells), 1.0)

    @classmethod
    def of(cls, rows: DataFrame, cells: int = CELLS) -> Grid:
        """The grid over all rows; one row for each dimension comes to the driver."""
        seen = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at")
        seen = seen.agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
        shortest = rows.agg(F.min(F.size("v"))).first()[0] or 0  # behind the end of a vector it has zeros
        low = np.array([min(r.low, 0.0) if r["at"] >= shortest else r.low for r in seen])
        return cls(low, np.array([max(r.high, 0.0) if r["at"] >= shortest else r.high for r in seen]), cells)

    def quantised(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores; a cell holds the whole numbers from its start to start + width - 1."""
        weight = queries * self.width
        # single precision where all partial sums are whole numbers below 2**24
        small = len(weight) and np.abs(weight).sum(axis=1).max(initial=0) * 256 < 2**24
        base = (weight.astype(np.float32) @ cells.T.astype(np.float32)).astype(float) if small else weight @ cells.T.astype(float)
        base += (queries @ self.low)[:, None]
        reach = queries * (self.width - 1)
        return base + np.minimum(reach, 0).sum(axis=1)[:, None], base + np.maximum(reach, 0).sum(axis=1)[:, None]


def approximation_file(rows: DataFrame, grid: Grid) -> DataFrame:
    """``(key, id, cells, v)`` of ``rows(id, v)``, written as Parquet: a number, the cell bytes, the vector."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = grid.quantised(_matrix(batch["v"], len(grid.low)))
            yield batch.assign(cells=[c.tobytes() for c in cells])[["key", "id", "cells", "v"]]

    numbered = rows.withColumn("key", F.monotonically_increasing_id())
    return kept(numbered.mapInPandas(written, "key bigint, id bigint, cells binary, v array<double>"))


def _left_of_block(cells: np.ndarray, keys: np.ndarray, ids: np.ndarray, asked: pa.Table, grid: Grid, k: int) -> Iterator[pa.RecordBatch]:
    """What a block of the file leaves for a block of queries, ``BOUNDS`` bounds at a time: nothing is held beyond them."""
    step = max(1, BOUNDS // max(len(cells), 1))
    for first in range(0, asked.num_rows if len(cells) else 0, step):
        part = asked.slice(first, step).to_pandas()
        lower, upper = grid.bounds(cells, _matrix(part["v"], len(grid.low)))
        same = ids[None, :] == part["id"].to_numpy()[:, None]
        lower[same], upper[same] = -np.inf, -np.inf
        least = np.partition(lower, len(keys) - k, axis=1)[:, len(keys) - k] if len(keys) > k else np.full(len(part), -np.inf)
        q, at = np.nonzero((upper >= least[:, None]) & ~same)
        columns = (part["query"].to_numpy()[q], keys[at], lower[q, at], upper[q, at])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query", "key", "lower", "upper"])


def scan(file: DataFrame, asked: DataFrame, grid: Grid, k: int) -> DataFrame:
    """``(query, key, lower, upper)``: rows of another id that the bytes of their block leave for a query.

    A block of the file meets each block of queries; a row stays where its upper bound reaches the
    ``k``-th lower bound of its block. What is left leaves the task as it is found.
    """
    blocks, parts = (int(t.count() // size + 1) for t, size in ((file, VECTORS), (asked, QUERIES)))

    def dealt(column: str, number: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(number))

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint")))

    here = file.select("key", "id", "cells", dealt("key", blocks).alias("block"), every(parts).alias("part"))
    # columns of their own names and numbers: the queries may be rows of the same file
    there = asked.select(*[F.col(c).alias(c) for c in ("query", "id", "v")], dealt("query", parts).alias("part"), every(blocks).alias("block"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right = table.filter(pc.is_valid(table["key"])), table.filter(pc.is_valid(table["query"]))
        cells = np.frombuffer(b"".join(left["cells"].to_pylist()), np.uint8).reshape(left.num_rows, len(grid.low))
        yield from _left_of_block(cells, left["key"].to_numpy(), left["id"].to_numpy(), right.select(["query", "id", "v"]), grid, k)

    both = here.unionByName(there, allowMissingColumns=True)
    return both.groupBy("block", "part").applyInArrow(scanned, "query bigint, key bigint, lower bigint, upper bigint")


def _read(wanted: DataFrame, file: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact scores of ``wanted(query, key)``."""
    rows = wanted.select("query", "key").join(file.select("key", F.col("id").alias("vec_id"), "v"), "key")
    rows = rows.join(asked.select("query", F.col("id").alias("query_id"), F.col("v").alias("q")), "query")
    product = F.zip_with("v", "q", lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)))
    score = F.aggregate(product, F.lit(0.0), lambda s, x: s + x).cast("bigint")
    return rows.select("query", "query_id", "vec_id", score.alias("score"))


def _kth(rows: DataFrame, column: str, k: int) -> DataFrame:
    """``(query, least)``: the ``k``-th largest value of the queries that have as many."""
    order = Window.partitionBy("query").orderBy(F.desc(column))
    ranked = rows.select("query", column, F.row_number().over(order).alias("n")).where(F.col("n") <= k)
    return ranked.where(F.col("n") == k).select("query", F.col(column).alias("least"))


def exact_reads(bounds: DataFrame, file: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query, query_id, vec_id, score)`` of the rows that ``bounds`` does not rule out, in two steps by upper bound."""

    def reach(rows: DataFrame, least: DataFrame) -> DataFrame:
        out = rows.join(least, "query", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
        return out.drop("least")

    left = reach(bounds, _kth(bounds, "lower", k))
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "key")
    left = kept(left.withColumn("n", F.row_number().over(order)))
    first = kept(_read(left.where(F.col("n") <= k), file, asked))
    # a query without k rows in the first step has no others
    rest = reach(left.where(F.col("n") > k), _kth(first, "score", k))
    return first.unionByName(_read(rest, file, asked))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query with all vectors of
    another id, ties to the smaller id; all of them if there are fewer.

    Both tables hold an id and an array of whole numbers as doubles; shorter vectors count as
    followed by zeros. Vectors with fractions, or so large that a score might reach 2**53, raise.
    Rows with a null id, a null vector or a null or non-finite component take no part; repeated
    rows are candidates of their own, queries of one id share one list. Other columns are not read;
    an empty table gives no rows.
    """

    def rows(table: DataFrame) -> DataFrame:
        out = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        return out.where(F.col("id").isNotNull() & usable(F.col("v")))

    base, asked = rows(vectors), rows(queries)
    largest = [t.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("x")).first() for t in (base, asked)]
    if max(t.d or 0 for t in largest) * (largest[0].x or 0) * (largest[1].x or 0) >= 2**53:
        raise ValueError("scores of these vectors are not exact as doubles")
    for table in (base, asked):
        violations(table.where(F.exists("v", lambda x: x != F.floor(x))).select("id"), "vector with fractions")
    grid = Grid.of(base.unionByName(asked))
    file = approximation_file(without_surplus(base, k), grid)
    asked = kept(asked.withColumn("query", F.monotonically_increasing_id()))
    scored = exact_reads(kept(scan(file, asked, grid, k)), file, asked, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
