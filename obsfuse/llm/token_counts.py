"""Token counts of whole texts by rank-synchronous merging (`bpe.py`)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from obsfuse.llm.bpe import Merges, byte_pattern
from obsfuse.llm.store import texts

#: Pre-tokens that a worker remembers, and the longest one that it does; this changes speed only.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64


class TokenCounter:
    """Counts for a byte-level tokenizer file, with the special strings of the file as one token each."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.split = byte_pattern().findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[str, int] = {}

    def counts(self, batch: list[str]) -> list[int]:
        """Tokens of each text; new pre-tokens of the whole batch are merged together."""
        parts, extra = [], []
        for text in batch:
            pieces = self.special.split(text) if "<|" in text else [text]
            extra.append(len(pieces) - 1)
            parts.append([w for p in pieces for w in self.split(p)])
        new = set().union(*parts).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*parts)
        listed = list(new)
        got = self.merges.encode([w.encode("utf-8", "surrogatepass") for w in listed])[1].tolist() if listed else []
        self.known.update(zip(listed, got, strict=True))
        out = [sum(map(self.known.__getitem__, words)) + n for words, n in zip(parts, extra, strict=True)]
        for word in listed:
            if len(word) > REMEMBERED_BYTES:
                del self.known[word]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row, as the tokenizer's library counts the
    whole text without added tokens; special strings in a text count as one token each.

    Null and empty texts have no bytes and no tokens; null ids stay null; repeated rows get equal
    counts; very long pre-tokens are merged like short ones. Columns beside id and text are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                size = pa.compute.binary_length(part.column(1)).cast(pa.int64())
                n = np.array(tool.counts(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    out = texts(docs, id_col, text_col).mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("doc_id", id_col)
