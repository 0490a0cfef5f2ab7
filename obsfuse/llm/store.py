"""Small helpers the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.runtime import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on; bounds the temporary arrays of a task.
SLICE_BYTES = 2 << 20


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but stores columns compressed; the table stays
    until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(*tables: DataFrame | None) -> None:
    """Delete tables that `kept` has written and that nothing reads any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in (table.inputFiles() if table is not None else [])}:
            if "/kept-" in path:
                where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, a null text as the empty one; every other column is left behind."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


#: Bits of the filter of `likely`: 65,536 numbers, whatever the size of the table.
FILTER_BITS = 1 << 22


def likely(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """``rows`` with a boolean ``__likely``: false where ``key`` is surely not among the keys of ``chosen``.

    A bit filter of fixed size is broadcast; rows that it lets through still need an exact join.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = chosen.where(F.col(key).isNotNull()).select(at.alias("__at")).groupBy(F.expr("__at div 64").alias("__word"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(__at % 64 AS int)))").alias("__bits"))
    out = rows.withColumn("__at", at).withColumn("__word", F.expr("__at div 64")).join(F.broadcast(bits), "__word", "left")
    hit = F.expr("coalesce(shiftright(__bits, cast(__at % 64 AS int)) & 1L, 0L) = 1L")
    out = out.withColumn("__likely", F.col(key).isNotNull() & hit)
    return out.select(*[f"`{c}`" for c in rows.columns], "__likely")


def split_likely(docs: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows that may be among ``chosen``, and those that surely are not.

    Only the first ones need to meet ``chosen`` in a join, so most texts are not shuffled.
    """
    marked = likely(docs, chosen, key)
    return marked.where("__likely").drop("__likely"), marked.where("NOT __likely").drop("__likely")


def text_batches(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of ``rows`` rows, each with its column of texts, a null text as the empty one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(part.schema.get_field_index(column)).fill_null("")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and the offsets of its rows (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or one row that alone is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def long_list(values: Sequence[np.ndarray]) -> pa.Array:
    """``array<bigint>`` from one integer array per row."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if len(values) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
