"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of up to ``order`` bytes holds how often each byte
followed. A byte costs -log2 of its share in the longest context that the language knows; where the
context has not seen the byte, an escape is paid (its share: distinct followers / (occurrences +
distinct followers)) and the next shorter context is asked, down to one of 256 bytes. The statistics
are frozen, so the cost of a byte is a function of the bytes before it: it is computed once for
every context and byte that any language has seen, for all languages side by side, and a text's
code lengths are sums over a table, slice by slice. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsfuse.llm.store import kept, slices, texts, utf8
from obsfuse.runtime import maybe_broadcast

#: Texts of no known language.
UNKNOWN = "und"

# letters stay (capital ones become small), all other ASCII bytes become a space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letters with single spaces between them; every row starts with a space."""
    out = _FOLD[data]
    if len(out) > 1:  # capital letters of the Latin-1 block are two bytes, C3 80 to C3 9E
        high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][high] += 32
    n = len(offsets) - 1
    begins = offsets[:-1] + np.arange(n)  # places of the added spaces
    both = np.full(len(out) + n, 32, np.uint8)
    rest = np.ones(len(both), bool)
    rest[begins] = False
    both[rest] = out
    stay = np.ones(len(both), bool)
    stay[1:] = (both[1:] != 32) | (both[:-1] != 32)
    stay[begins] = True
    before = np.concatenate([[0], np.cumsum(stay)])
    return both[stay], before[np.append(begins, len(both))]


def grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and packed bytes of all runs of ``size`` bytes inside a row."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(size):
        packed = (packed << np.uint64(8)) | data[k : n + k]
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    ends = np.arange(size - 1, len(data))
    inside = ends - (size - 1) >= begin[ends]
    return ends[inside], packed[inside]


class Table:
    """Packed byte runs -> row number; open addressing in an array twice as large as the keys or more."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        self.steps = 1
        while len(left):
            at = self._at(keys[left], step)
            free = self.rows[at] < 0
            at, put = at[free], left[free]
            self.rows[at] = put  # of several for one place the last stays
            won = self.rows[at] == put
            self.keys[at[won]] = keys[put[won]]
            placed = np.zeros(len(left), bool)
            placed[np.flatnonzero(free)[won]] = True
            left, step = left[~placed], step + 1
            self.steps = step

    def _at(self, keys: np.ndarray, step: int) -> np.ndarray:
        at = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (at.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys, 0)
        out = np.where(self.keys[at] == keys, self.rows[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        for step in range(1, self.steps):
            if not len(open_):
                break
            at = self._at(keys[open_], step)
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            open_ = open_[~hit & (self.rows[at] >= 0)]
        return out


@dataclass
class Trees:
    """Frozen statistics: for each run length the known runs, their costs, and escapes of contexts."""

    languages: list[str]
    order: int
    runs: list[Table]
    cost: list[np.ndarray]  # bits of the last byte of a run, a column for each language
    contexts: list[Table]
    escape: list[np.ndarray]  # bits of leaving a context, 0 where a language does not know it

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row in each language, without the space in front."""
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        todo = np.ones(len(data), bool)
        todo[offsets[:-1][np.diff(offsets) > 0]] = False
        for size in range(self.order + 1, 0, -1):
            ends, packed = grams(data, offsets, size)
            ask = todo[ends]
            ends, packed = ends[ask], packed[ask]
            row = self.runs[size - 1].find(packed)
            hit = row >= 0
            bits[ends[hit]] += self.cost[size - 1][row[hit]]
            todo[ends[hit]] = False
            ends, packed = ends[~hit], packed[~hit]
            row = self.contexts[size - 1].find(packed >> np.uint64(8))
            known = row >= 0
            bits[ends[known]] += self.escape[size - 1][row[known]]
        bits[todo] += 8.0
        bits[offsets[:-1][np.diff(offsets) > 0]] = 0
        sums = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def _frozen(languages: list[str], order: int, lang: np.ndarray, size: np.ndarray, packed: np.ndarray, count: np.ndarray) -> Trees:
    width = len(languages)
    runs, cost, contexts, escape = [], [], [], []
    for k in range(1, order + 2):
        mine = size == k
        keys, row = np.unique(packed[mine], return_inverse=True)
        seen = np.zeros((len(keys), width))
        np.add.at(seen, (row, lang[mine]), count[mine])
        above, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(above), width)), np.zeros((len(above), width))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            stay = -np.log2(seen / (total + kinds)[of])
        if k == 1:
            shorter = np.full((len(keys), width), 8.0)
        else:  # every shorter run of a known run is known
            shorter = cost[-1][runs[-1].find(keys & np.uint64((1 << (8 * (k - 1))) - 1))]
        runs.append(Table(keys))
        contexts.append(Table(above))
        escape.append(leave.astype(np.float32))
        cost.append(np.where(seen > 0, stay, leave[of] + shorter).astype(np.float32))
    return Trees(languages, order, runs, cost, contexts, escape)


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, sample: int = 1500
) -> Trees:
    """Count the whole texts of at most ``sample`` rows for each language, those with the smallest hash of their id.

    Rows with a null id, text or language are left out; an empty table gives no languages.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    # about twice as many as wanted by a bound on the hash, then exactly the smallest ones
    keyed = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit("sample")).alias("h"))
    size = kept(keyed.groupBy("lang").agg(F.count("*").alias("n")))
    share = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * sample + 64
    near = keyed.join(maybe_broadcast(size), "lang").where(share)  # one row for each language, so few rows are dealt by it
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = kept(near.withColumn("place", place).where(F.col("place") <= sample).select("doc_id").distinct())
    languages = sorted(r["lang"] for r in size.select("lang").collect())  # one row for each language

    number = {name: i for i, name in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                text, at = folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = np.repeat(lang[a:b], np.diff(at))
                for k in range(1, order + 2):
                    ends, packed = grams(text, at, k)
                    for which in np.unique(lang[a:b]):
                        keys, n = np.unique(packed[of[ends] == which], return_counts=True)
                        columns = [np.full(len(keys), which), np.full(len(keys), k), keys.view(np.int64), n]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lang", "size", "packed", "n"])

    picked = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang")  # `sample` rows a language
    counts = picked.mapInArrow(counted, "lang bigint, size bigint, packed bigint, n bigint")
    counts = counts.groupBy("lang", "size", "packed").agg(F.sum("n").alias("n")).toPandas()  # of the sample alone
    columns = [counts[c].to_numpy(np.int64) for c in ("lang", "size", "packed", "n")]
    return _frozen(languages, order, columns[0], columns[1], columns[2].view(np.uint64), columns[3])


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, bits_per_byte)`` for every row.

    ``score`` is the weight of the shortest code among all languages (each code length taken as a
    negative log probability); ties go to the first name. Null texts and texts without a letter are
    ``und`` with score 0 and no bits, as is every text where no language is known. Null ids stay
    null; repeated rows get equal results. Columns beside id and text are not read.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(trees)  # grows with the fitting sample only

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                at = offsets[a : b + 1] - offsets[a]
                plain = np.concatenate([[0], np.cumsum(((part | 32) >= 97) & ((part | 32) <= 122))])
                letters = plain[at[1:]] > plain[at[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(at) > 0)):
                    letters[i] = _has_letter(part[at[i] : at[i + 1]].tobytes())
                if model.languages:
                    text, ends = folded(part, at)
                    bits = model.code_lengths(text, ends)
                    best = bits.argmin(axis=1)
                    score = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                    rate = bits.min(axis=1) / np.maximum(np.diff(ends) - 1, 1)
                else:
                    letters[:] = False
                    best, score, rate = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
                names = np.array([*model.languages, UNKNOWN], object)[np.where(letters, best, len(model.languages))]
                columns = [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(rate, mask=~letters)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    out = texts(docs, id_col, text_col).mapInArrow(named, "doc_id bigint, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("doc_id", id_col)
