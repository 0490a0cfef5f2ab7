"""Source divergence audit: which sources of a language use its words differently, and which words.

Words are counted by sorting pointers. A shard of texts is one buffer of bytes; each word is a pointer
to its first byte. The pointers are put in order by a multikey quicksort whose character is a slice of
eight bytes: pointers are ordered by their slice, runs of equal slices go on with the next one, and a
run that has read all its bytes is one word. Rows lie in the buffer by group and the sort is stable, so
that one walk along the pointers gives, for each word and group, its occurrences and its documents.

Pairs of sources are compared in tiles: a task holds the frequencies of at most ``TILE`` sources against
``TILE`` others for about ``TILE_TERMS`` words, and the sums over all tiles are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsfuse.llm.store import kept, slices, utf8

#: Bytes of one shard that are sorted together.
SHARD_BYTES = 8 << 20
#: Sources and words of one tile.
TILE, TILE_TERMS = 64, 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Bits of a slice of eight bytes of which only the first k belong to the word.
_HEAD = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)
#: Slices after which the few words that are still equal are compared as byte strings.
_LONG = 32


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every word of the concatenated rows."""
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside & (np.concatenate([[False], ~inside[:-1]]) | edge[:-1] | (np.arange(len(data)) == 0))
    last = inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def sorted_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their words, and where in it another word begins.

    Pointers of one word keep their order.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))

    def piece(pointers: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(ends[pointers] - starts[pointers] - depth, 0, 8)
        return eight[np.minimum(starts[pointers] + depth, len(data))].astype(np.uint64) & _HEAD[left]

    keys = piece(np.arange(len(starts)), 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    at, depth = np.arange(len(order)), 0
    while True:
        tied = ~new[at]
        tied[:-1] |= tied[1:]  # `at` holds whole runs, so the row before a tied one belongs to its run
        at = at[tied & ((keys & np.uint64(255)) > 0)]
        if not len(at):
            return order, new
        depth += 8
        runs = np.cumsum(new[at])
        if depth >= 8 * _LONG:
            _by_bytes(data, starts, ends, order, new, at, runs)
            return order, new
        keys = piece(order[at], depth)
        again = np.lexsort((keys, runs))
        order[at], keys = order[at[again]], keys[again]
        new[at[1:]] |= keys[1:] != keys[:-1]


def _by_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, new: np.ndarray, at: np.ndarray, runs: np.ndarray) -> None:
    """Order the runs at ``at`` by their whole words (very long words that agree for many slices)."""
    words = [(run, data[starts[p] : ends[p]].tobytes(), p) for run, p in zip(runs.tolist(), order[at].tolist(), strict=True)]
    words.sort()
    order[at] = [p for _, _, p in words]
    for i in range(1, len(words)):
        if words[i][:2] != words[i - 1][:2]:
            new[at[i]] = True


def shard_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, groups, occurrences and documents of each word in each group; rows lie by ``group``."""
    data = _LOWER[data]
    starts, ends, rows = word_pointers(data, offsets)
    order, new = sorted_words(data, starts, ends)
    starts, ends, rows = starts[order], ends[order], rows[order]
    groups = group[rows]
    change = new.copy()
    change[1:] |= groups[1:] != groups[:-1]
    other = change.copy()
    other[1:] |= rows[1:] != rows[:-1]
    first = np.flatnonzero(change)
    counts = np.diff(np.append(first, len(order)))
    docs = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    size = ends[first] - starts[first]
    ends_at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(size, out=ends_at[1:])
    letters = data[np.repeat(starts[first] - ends_at[:-1], size) + np.arange(ends_at[-1])]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends_at), pa.py_buffer(letters))
    return words, groups[first], counts, docs


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pd.DataFrame({c: batch.column(c).to_pandas() for c in ("lang", "source")})
        numbers = names.groupby(["lang", "source"], sort=True).ngroup().to_numpy()
        order = np.argsort(numbers, kind="stable")
        batch, numbers = batch.take(pa.array(order)), numbers[order]
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets, SHARD_BYTES):
            words, group, counts, docs = shard_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], numbers[a:b])
            row = pa.array(np.searchsorted(numbers, group))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(row), batch.column("source").take(row), words.cast(pa.string()), pa.array(counts), pa.array(docs)],
                ["lang", "source", "term", "n", "docs"],
            )


def count_terms(docs: DataFrame, by: tuple[str, str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each word in each group of ``by``.

    Words are runs of ASCII letters and other code points above 127; A to Z are lower-cased. Nulls
    count as ''; each row is a document, repeated ones too. Groups without words have no row here.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in zip((*by, text_col), ("lang", "source", "text"), strict=True)]
    shards = docs.select(*said).mapInArrow(_shards, "lang string, source string, term string, n bigint, docs bigint")
    return shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), exact; 0 where no word is kept."""
    share = f"1 + (cast({n} + 5 AS decimal(20, 0)) * 1000000000) div cast({total} + 5 * terms AS decimal(20, 0))"
    return F.expr(f"CASE WHEN terms > 0 THEN {share} ELSE 0 END")


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Differences of all pairs of one tile, summed over its words; a row without a word names a source
    and holds the share of words that it does not use.
    """
    known = rows[rows["term"].isna()].sort_values("source").reset_index(drop=True)
    said = rows[rows["term"].notna()]
    place, words = pd.factorize(said["term"])
    none = known["p"].to_numpy(np.int64)
    table = np.repeat(none[None, :], len(words), axis=0)
    table[place, pd.Index(known["source"]).get_indexer(said["source"])] = said["p"].to_numpy(np.int64)
    one, two = int(rows["one"].iloc[0]), int(rows["two"].iloc[0])
    tiles, names = known["tile"].to_numpy(), known["source"].to_numpy()
    everything = int(known["terms"].iloc[0]) if rows["bucket"].iloc[0] == 0 else 0  # the words of all buckets, once
    parts = [pd.DataFrame({"source": [], "item": [], "value": []})]
    for i in np.flatnonzero(tiles == one):
        js = np.flatnonzero(tiles == two)
        js = js[js > i] if one == two else js
        value = np.abs(table[:, js] - table[:, i : i + 1]).sum(axis=0) + (everything - len(words)) * np.abs(none[js] - none[i])
        parts.append(pd.DataFrame({"source": names[i], "item": names[js], "value": value}))
    out = pd.concat(parts[1:] or parts).assign(lang=rows["lang"].iloc[0])
    return out[["lang", "source", "item", "value"]]


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: every two sources of a language, both ways."""
    buckets, tiles = F.ceil(F.col("terms") / TILE_TERMS), F.max("tile").over(Window.partitionBy("lang")) + 1
    groups = groups.withColumn("buckets", F.greatest(F.lit(1), buckets).cast("int")).withColumn("tiles", tiles)
    named = groups.withColumn("bucket", F.expr("explode(sequence(0, buckets - 1))"))
    named = named.select("lang", "source", F.lit(None).cast("string").alias("term"), "tile", "tiles", "terms", F.col("none").alias("p"), "bucket")
    used = shares.join(groups.select("lang", "source", "tiles", "buckets"), ["lang", "source"])
    used = used.withColumn("bucket", F.expr("cast(pmod(xxhash64(term), buckets) AS int)")).select(named.columns)
    rows = named.union(used).withColumn("other", F.expr("explode(sequence(0, tiles - 1))")).drop("tiles")
    rows = rows.withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other")).drop("other")
    parts = rows.groupBy("lang", "one", "two", "bucket").applyInPandas(_tile, "lang string, source string, item string, value bigint")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return _ranked(sums.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    """Part ``term``: the words that a source uses most above its language."""
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    return _ranked(above).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(
    docs: DataFrame, least_docs: int = 30, top_terms: int = 50, by: tuple[str, str] = ("lang", "source"), text_col: str = "text"
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of ``by``.

    A language keeps the words of at least ``least_docs`` of its documents. The share of a kept word
    in a group or a language is ``1 + floor(10**9 * (n + 5) / (N + 5 * V))`` with its count n, the sum N
    of these counts and the number V of kept words. Part ``pair``: the summed differences of these
    shares to each other source of the language (0 where nothing is kept). Part ``term``: the
    ``top_terms`` words that the group uses most above its language. Ranks go by value, then item.

    Nulls are ''; a language of one source has no pairs; an empty table gives no rows; repeated rows are
    documents of their own; texts of any length are read whole. All numbers are exact integers. Other
    columns are left behind.
    """
    counts = kept(count_terms(docs, by, text_col))
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in zip(by, ("lang", "source"), strict=True)]
    groups = docs.select(*said).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = kept(terms.where(F.col("docs") >= least_docs).drop("docs"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = kept(counts.drop("docs").join(terms, ["lang", "term"]))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total", "lang_total"])
    groups = kept(groups.withColumn("none", _share("0", "total")).withColumn("tile", F.floor(place / TILE).cast("int")))
    shares = used.join(groups.drop("lang_total"), ["lang", "source"]).join(langs.select("lang", "lang_total"), "lang")
    shares = shares.select("lang", "source", "term", "tile", "terms", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    shares = kept(shares)
    return _pairs(shares, groups).union(_terms(shares, top_terms))
