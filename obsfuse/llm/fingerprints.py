"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ``k`` smallest distinct hashes of a text's shingles. Sketches of parts merge to the
sketch of the whole; from two sketches follow resemblance and containment, from one the number of
distinct shingles.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsfuse.llm.store import kept, likely, texts

#: Hashes in a sketch: standard error of a resemblance at most 1 / (2 * sqrt(K)).
K = 128
#: Sketches that one step of a merge holds together.
MERGE = 256
#: Quantiles of the ids at which ranges begin; ranges have parts of their own, so this bounds no part.
RANGES = 1000


def sketch(text: Column, k: int = K, width: int = 5) -> Column:
    """The sketch of a text: ascending ``array<bigint>``.

    Words lie between ASCII white space, A-Z count as a-z; fewer than ``width`` words are one
    shingle; no words give an empty sketch, a null text a null one.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        # shifted copies side by side: one struct of `width` hashes for each start
        n = F.size(h) - (width - 1)
        beside = F.arrays_zip(*[F.slice(h, F.lit(i + 1), n).alias(f"w{i}") for i in range(width)])
        long = F.transform(beside, lambda s: F.xxhash64(s))
        return F.when(n >= 1, long).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # the hashes are an array of one array, so that they are computed once and not once for each use
    each = F.transform(F.array(hashed), shingles)[0]
    return F.slice(F.sort_array(F.array_distinct(each)), 1, k)


def shown(sketched: Column) -> Column:
    """A sketch as a string: its hashes, eight bytes each from the highest on, in base 64."""
    digits = F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.base64(F.unhex(digits))


def distinct_shingles(sketched: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, then from the k-th smallest hash."""
    top = (F.element_at(sketched, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketched) < k, F.size(sketched).cast("double")).otherwise(F.lit(k - 1.0) / top)


def _common(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), both)).cast("double"), F.size(both).cast("double")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection / union of two texts' shingles; two empty sketches are alike (1)."""
    same, both = _common(a, b, k)
    return F.when(both == 0, F.lit(1.0)).otherwise(same / both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has (an empty one has all)."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    share = resemblance(a, b, k) * distinct_shingles(union, k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merged(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """``(key, sketch)``: the sketch of all parts of a key together, whatever their number.

    At most about ``MERGE`` sketches of a key meet in one row; large keys take several rounds.
    Null sketches are left out; a null key is a key; an empty table gives no rows.
    """
    rows = parts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("s")).where("s IS NOT NULL")
    largest = rows.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    joined = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))), 1, k).alias("s")
    while largest > MERGE:
        shares = -(-largest // MERGE)
        rows = rows.groupBy("key", F.pmod(F.xxhash64("s"), F.lit(shares)).alias("share")).agg(joined).drop("share")
        largest = min(shares, largest // 2)
    return rows.groupBy("key").agg(joined).select(F.col("key").alias(key), F.col("s").alias(column))


def _ranges(docs: DataFrame, chars_per_task: int) -> DataFrame:
    """``docs`` with ``range`` and ``part``, both ascending in the order by id (nulls first), then ``hash``.

    At most about ``2 * RANGES`` ranges are cut at quantiles of the ids. Each has as many parts as it takes for
    about ``chars_per_task`` code points in a part: ids are dealt by their place between the ends of their range,
    an id that fills whole ranges, and null ids, by the hash of the text.
    """
    ids = F.col("doc_id")
    size = docs.agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("rows"), F.count(ids).alias("ids"), F.min(ids).alias("lo"), F.max(ids).alias("hi")).first()
    parts = (size["n"] or 0) // chars_per_task + 1
    number = min(parts, RANGES)
    each = -(-parts // number)
    shares = [i / number for i in range(1, number)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * number)).first()[0] if shares and size["ids"] else []
    # (start, parts, dealt by hash); the first one holds null ids
    table = [(0, -(-parts * (size["rows"] - size["ids"]) // max(1, size["rows"])) or 1, True)]
    if size["ids"]:
        often = Counter(cuts)
        ends = {size["lo"]: each} | {v + 1: each for v, n in often.items() if n > 1 and v < size["hi"]} | {v: n * each for v, n in often.items()}
        table += [(v, n, often[v] > 1) for v, n in sorted(ends.items())]
    start, count, hashed = (np.array(c, np.int64) for c in zip(*table, strict=True))
    stop = np.append(start[1:], min((size["hi"] or 0) + 1, (1 << 63) - 1))
    before = np.cumsum(count) - count
    at = F.size(F.filter(F.lit(start[1:]), lambda c: c <= ids)) if size["ids"] else F.lit(0)

    def of(values: np.ndarray) -> Column:
        return F.element_at(F.lit(values), F.col("range") + 1)

    low, high = of(start).cast("double"), of(stop).cast("double")
    share = F.when(of(hashed) == 1, F.col("hash").cast("double") / F.lit(2.0**64) + F.lit(0.5)).otherwise((ids.cast("double") - low) / F.greatest(high - low, F.lit(1.0)))
    piece = F.least(F.floor(share * of(count)), of(count) - 1)
    return docs.withColumn("range", at).withColumn("part", of(before) + piece)


def with_next(docs: DataFrame, chars_per_task: int = 4 << 20) -> tuple[DataFrame, Window]:
    """Rows of ``docs(doc_id, text)`` with ``part``, ``wrap`` and ``guest``, and the window in which the
    next row is the next document by ascending id (null ids first, equal ids by the text's hash; after
    the last: the first).

    Rows are dealt out in parts of about ``chars_per_task`` code points, whatever their number. The first row of
    a part is also a guest of the last part before it that has rows, and the very first one of the last part; guests are
    to be dropped behind the window. Only the rows that become guests are read again.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    docs = _ranges(docs, chars_per_task).withColumn("mark", F.xxhash64("doc_id", "hash"))
    firsts = docs.groupBy("range", "part").agg(F.min(F.struct("doc_id", "hash", "mark")).alias("first"))
    firsts = kept(firsts.select("range", "part", F.col("first.doc_id").alias("id"), F.col("first.hash").alias("h"), "first.mark"))
    held = sorted(firsts.groupBy("range").agg(F.max("part").alias("last")).collect())  # a row for each range
    last = held[-1]["last"] if held else 0
    ahead = {r["range"]: p["last"] for p, r in zip(held, held[1:], strict=False)}
    known = np.full(held[-1]["range"] + 1 if held else 1, last, np.int64)
    for r, p in ahead.items():
        known[r] = p
    inside = F.lag("part").over(Window.partitionBy("range").orderBy("part"))
    first_of_all = inside.isNull() & (F.col("range") == (held[0]["range"] if held else 0))
    hosts = firsts.select("id", "h", "mark", F.coalesce(inside, F.element_at(F.lit(known), F.col("range") + 1)).alias("part"), first_of_all.cast("int").alias("wrap"))
    guests = likely(docs, firsts, "mark").where("__likely").select("doc_id", "text", "hash", "mark")
    same = guests["mark"].eqNullSafe(hosts["mark"]) & guests["hash"].eqNullSafe(hosts["h"]) & guests["doc_id"].eqNullSafe(hosts["id"])
    guests = guests.join(hosts, same).groupBy("part", "wrap").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = docs.select("doc_id", "text", "part", F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    rows = rows.unionByName(guests.withColumn("guest", F.lit(True)))
    return rows, Window.partitionBy("part").orderBy("wrap", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by as many of
    the next document's first ones, or all it has. Returns ``(id, n_chars, edited_sha256, sketch,
    edited_sketch, near_edited, near_next, n_shingles)``: the likenesses are estimated resemblances,
    ``n_shingles`` the estimated number of distinct shingles. A null text counts as empty; two
    texts without words are alike (1). Null ids come first in the order, rows that repeat an id
    follow each other; the only row of a table is its own next one. Columns beside id and text are
    not read.
    """
    rows, order = with_next(texts(docs, id_col, text_col))
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    length = F.length("text")
    edit = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 4)"), F.expr("substring(next_text, 1, cast(length(text) div 4 AS int))"))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edit)).drop("next_text")
    rows = rows.select("doc_id", "guest", "part", "wrap", "text", length.alias("n_chars"), "edited")
    rows = rows.withColumn("sketch", sketch(F.col("text"), k)).withColumn("edited_sketch", sketch(F.col("edited"), k))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).where("NOT guest")
    own = F.col("sketch")
    return rows.select(
        F.col("doc_id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        resemblance(own, F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(own, F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(own, k).alias("n_shingles"),
    )
