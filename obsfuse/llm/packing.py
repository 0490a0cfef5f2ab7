"""Harmonic packing of token sequences.

Lengths are put into reciprocal-capacity classes: class k holds pieces of at most capacity / k
tokens, and k of them fill a sequence, whatever their exact lengths. A document is cut so that its
pieces nearly reach the bound of their class: full sequences first, then the largest reciprocal
part that fits, until the rest is within ``slack`` of its own class. Every class, and every share
of a large class, is filled on its own; nothing but class counts passes between workers. The less
than k pieces that each share leaves over meet in blocks, where they are packed best-fit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsfuse.llm.bpe import Merges, word_pattern
from obsfuse.llm.store import kept, texts

#: Pieces of a class that are numbered in one task.
SHARE = 50_000
#: Words that a worker remembers; more are encoded again (this changes speed only).
REMEMBERED = 600_000

_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: Words that the library itself encodes: special strings, odd spaces, letters beyond Latin (their normal forms).
_RARE = re.compile("[^!-~\xa1-\u024f]|<\\|")


class WordIds:
    """Token ids of texts, word by word, for tokenizer files that never cross white space."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.split = Merges(path), word_pattern().findall
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        rare = [w for w in words if _RARE.search(w)] if _RARE.search("".join(words)) else []
        if rare:
            for word, got in zip(rare, self.tokenizer.encode_batch(rare, add_special_tokens=False), strict=True):
                self.known[word] = np.array(got.ids, "<u4").tobytes()
            words = list(set(words).difference(rare))
        if not words:
            return
        small = "\n".join(words).lower().split("\n")
        parts = [[w] if w.isalpha() else self.split(w) for w in small]
        flat, count = self.merges.encode_lines([p for part in parts for p in part])
        raw = flat.astype("<u4").tobytes()
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = (4 * np.concatenate([[0], np.cumsum(count)])[np.cumsum(size)]).tolist()
        self.known.update(zip(words, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))

    def ids(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        listed = [_SPACE.split(t) if _ODD_SPACE.search(t) else t.split() for t in batch]
        new = set().union(*listed).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*listed)
        self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in listed]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cuts(length: int, capacity: int, slack: float) -> Iterator[tuple[int, int]]:
    """``(piece length, class)`` of a document of ``length`` tokens, in order."""
    while length >= capacity:
        yield capacity, 1
        length -= capacity
    while length:
        k = capacity // length
        if length >= (1 - slack) * (capacity // k):
            yield length, k
            return
        yield capacity // (k + 1), k + 1
        length -= capacity // (k + 1)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    slack: float = 0.02,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, and
    the ``ids`` themselves if ``with_ids``.

    The ids of a whole text come from the tokenizer file (no special tokens added), with
    ``end_id`` behind them; a null or empty text is that id alone. Each id lies in exactly one
    piece, a sequence holds at most ``capacity`` ids without gaps from offset 0. Rows with a null
    id, repeated rows and repeated ids are documents of their own. An empty table gives no rows.
    Columns beside id and text are not read.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, rows, pieces = [], [], []
                for i, ids in enumerate(words.ids(part.column(1).to_pylist())):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length, k in cuts(total, capacity, slack):
                        piece = ids[4 * start : 4 * (start + length)]
                        of.append(i)
                        rows.append((start, length, zlib.crc32(piece), total, k))
                        if with_ids:
                            pieces.append(np.frombuffer(piece, "<u4").astype(np.int32))
                        start += length
                flat = np.array(rows, np.int64).reshape(-1, 5)
                columns = [part.column(0).take(pa.array(of, pa.int64())), *(pa.array(flat[:, c]) for c in range(5))]
                columns += [pa.array(pieces, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k bigint"
    pieces = kept(texts(docs, id_col, text_col).mapInArrow(cut, schema + ", ids array<int>" * with_ids))  # encoded once
    # full sequences need no company; the others are numbered inside the shares of their class
    share = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(1 << 20))
    pieces = pieces.withColumn("share", share)
    sizes = pieces.groupBy("k").agg(F.count("*").alias("count"))  # at most `capacity` rows
    sizes = sizes.select("k", F.ceil(F.col("count") / SHARE).alias("shares"))
    placed = pieces.join(F.broadcast(sizes), "k").withColumn("share", F.col("share") % F.col("shares"))
    inside = Window.partitionBy("k", "share")
    number = F.row_number().over(inside.orderBy("doc_id", "start", "doc_tokens", "ids_crc32")) - 1
    placed = placed.withColumn("number", number).withColumn("size", F.count("*").over(inside))
    placed = placed.withColumn("bin", F.expr("number div k")).withColumn("full", F.expr("number < size div k * k"))
    before = Window.partitionBy("k", "share", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    out = [F.col(c) for c in names if c != "k"]
    whole = placed.withColumn("offset", offset).where("full")
    whole = whole.select(*out, F.expr("k * (1L << 48) + share * (1L << 20) + bin").alias("sequence_id"), "offset")

    # what is left of each share: less than one sequence
    rest = placed.where("NOT full")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=False)
        room: list[tuple[int, int]] = []  # free space and number of the open sequences, ascending
        where, opened = [], 0
        for length in part["length"].tolist():
            best = bisect_left(room, (length, -1))
            if best < len(room):
                free, at = room.pop(best)
            else:
                free, at = capacity, opened
                opened += 1
            where.append((at, capacity - free))
            insort(room, (free - length, at))
        at = np.array(where, np.int64).reshape(-1, 2)
        return part.assign(sequence_id=part["share"] * (1 << 20) + at[:, 0], offset=at[:, 1])[[*(c for c in names if c != "k"), "sequence_id", "offset"]]

    schema = schema.replace(", k bigint", "") + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    rest = rest.select(*out, "share").groupBy("share").applyInPandas(fitted, schema)
    return whole.union(rest).withColumnRenamed("doc_id", id_col)
