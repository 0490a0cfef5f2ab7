"""Toxicity: a second-order factorization machine over hashed terms.

A term is a word (letters and digits, lower case) or one of its prefixes; terms are hashed to
2**22 numbers. The machine sums a weight for each term of a text and the product of the factors of
each pair of its terms, so that a pair may say what neither term says alone. Terms are chosen by
their chi-squared statistic with the label; texts are scored whole, slice by slice, with NumPy
inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.llm.shingles import word_hashes
from obsfuse.llm.store import kept, long_list, slices, text_batches, texts, utf8

#: Numbers that terms are hashed to.
SPACE = 1 << 22
#: Prefixes of a word that are terms, in bytes of UTF-8.
PREFIXES = (4, 5, 6, 7, 8)

_KIND = np.zeros(256, bool)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Machine:
    """Chosen terms, a weight and a factor vector for each, and the bias (log odds)."""

    terms: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        at = np.full(SPACE, -1, np.int32)
        at[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return at

    def odds(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Log odds of ``n`` texts; ``row`` (ascending) and ``term`` list their distinct terms."""
        total = np.bincount(row, self.weight[term], n)
        pairs = np.zeros(n)
        for k in range(self.factor.shape[1]):
            v = self.factor[term, k]
            pairs += np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)
        return self.bias + total + pairs / 2


def term_numbers(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, last row, and the terms as (row in the slice, number)."""
    for a, b in slices(offsets):
        part = _LOWER[data[offsets[a] : offsets[b]]]
        if len(part) > 1:  # capital letters of the Latin-1 block are two bytes, C3 80 to C3 9E
            high = (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)
            part[1:][high] += 32
        at = offsets[a : b + 1] - offsets[a]
        inside = np.concatenate([[False], _KIND[part], [False]])
        edge = inside[1:] != inside[:-1]
        cuts = at[1:-1]
        first, last = edge & inside[1:], edge & inside[:-1]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]
        first[cuts] = last[cuts] = True
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        row = np.repeat(np.arange(b - a), np.diff(np.searchsorted(starts, at)))
        rows, numbers = [row], [word_hashes(part, starts, ends)]
        for size in PREFIXES:
            long = ends - starts > size
            rows.append(row[long])
            numbers.append(word_hashes(part, starts[long], starts[long] + size) + np.uint64(size))
        yield a, b, np.concatenate(rows), (np.concatenate(numbers) >> np.uint64(40)).astype(np.int64) & (SPACE - 1)


def _distinct(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * SPACE + term)
    return both // SPACE, both % SPACE


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 16384,
    terms: int = 2048,
    factors: int = 8,
    epochs: int = 12,
    seed: int = 7,
) -> Machine:
    """Fit on at most ``sample`` labelled rows, those with the smallest hash of their id.

    Null labels and ids are left out; several labels of one id count as the largest. Without
    labelled texts the machine has no terms and a bias of zero (score 0.5).
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = chosen.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SPACE), np.int32)
        texts_ = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(2).to_numpy()
            texts_ += np.bincount(label > 0, minlength=2)
            for a, b, row, term in term_numbers(*utf8(batch.column(1))):
                row, term = _distinct(row, term)
                toxic = label[a:b][row] > 0
                for k in (0, 1):
                    seen[k] += np.bincount(term[toxic == k], minlength=SPACE).astype(np.int32)
        at = np.flatnonzero(seen.any(axis=0))
        term = np.concatenate([[-1], at])  # the row -1 counts the texts
        columns = [term, np.concatenate([texts_[:1], seen[0, at]]), np.concatenate([texts_[1:], seen[1, at]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "clean", "toxic"])

    counts = rows.mapInArrow(counted, "term bigint, clean bigint, toxic bigint")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = kept(counts.where("term < 0 OR clean + toxic >= 4"))
    total = counts.where("term < 0").first()
    clean, toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    if not clean or not toxic:
        bias = float(np.log((toxic + 1e-3) / (clean + 1e-3)))
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), bias)
    expected = (F.col("clean") + F.col("toxic")) * F.lit(toxic / (clean + toxic))
    gain = F.pow(F.col("toxic") - expected, 2) / (expected + 1)
    best = counts.where("term >= 0").orderBy(gain.desc(), "term").limit(terms).select("term").collect()
    machine = Machine(np.array([r["term"] for r in best]), np.zeros(len(best)), np.zeros((len(best), factors)), 0.0)
    lookup_terms = machine.terms

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Machine(lookup_terms, machine.weight, machine.factor, 0.0).lookup()
        for batch in batches:
            found = []
            for a, b, row, term in term_numbers(*utf8(batch.column(1))):
                hit = at[term] >= 0
                row, term = _distinct(row[hit], at[term[hit]])
                found += np.split(term, np.searchsorted(row, np.arange(1, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), long_list(found)], ["doc_id", "label", "terms"])

    known = rows.mapInArrow(reduced, "doc_id bigint, label int, terms array<bigint>").toPandas()  # at most `sample` rows
    known = known.sort_values(["doc_id", "label"])
    _train(machine, [np.asarray(t, np.int64) for t in known["terms"]], (known["label"].to_numpy() > 0).astype(float), epochs, seed)
    return machine


def _train(machine: Machine, lists: list[np.ndarray], label: np.ndarray, epochs: int, seed: int) -> None:
    """Adaptive gradient steps on the logistic loss with small quadratic penalties."""
    rng = np.random.default_rng(seed)
    machine.bias = float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
    machine.factor = rng.normal(0, 0.02, machine.factor.shape)
    w, v = machine.weight, machine.factor
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for epoch in range(epochs):
        rate = 0.15 / (1 + 0.2 * epoch)
        order = rng.permutation(len(lists))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            row = np.repeat(np.arange(len(pick)), [len(lists[i]) for i in pick])
            term = np.concatenate([lists[i] for i in pick])
            odds = np.clip(machine.odds(row, term, len(pick)), -30, 30)
            slope = 1 / (1 + np.exp(-odds)) - label[pick]
            each = slope[row]
            d = np.bincount(term, each, len(w)) / len(pick) + 1e-4 * w
            gw += d * d
            w -= rate * d / np.sqrt(gw)
            sums = np.stack([np.bincount(row, v[term, k], len(pick)) for k in range(v.shape[1])], axis=1)
            pull = each[:, None] * (sums[row] - v[term])
            d = np.stack([np.bincount(term, pull[:, k], len(w)) for k in range(v.shape[1])], axis=1) / len(pick) + 1e-3 * v
            gv += d * d
            v -= 0.2 * rate * d / np.sqrt(gv)
            d = slope.mean()
            gb += d * d
            machine.bias -= rate * d / np.sqrt(gb)


def _scores(at: np.ndarray, machine: Machine, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for a, b, row, term in term_numbers(*utf8(column)):
        hit = at[term] >= 0
        row, term = _distinct(row[hit], at[term[hit]])
        out[a:b] = machine.odds(row, term, b - a)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row: the probability of the label for the whole text.

    Null and empty texts have no terms and get the score of the bias alone; null ids stay null;
    repeated rows get equal scores. Columns beside id and text are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = machine.lookup()
        for batch in batches:
            score = _scores(at, machine, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(scored, "doc_id bigint, score double")
    return out.withColumnRenamed("doc_id", id_col)


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores below ``threshold``; nothing is shuffled."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = machine.lookup()
        for batch, column in text_batches(batches, text_col):
            yield batch.filter(pa.array(_scores(at, machine, column) < threshold))

    return docs.mapInArrow(clean, docs.schema)
