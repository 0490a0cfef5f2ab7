"""Line dedup: later copies of repeated line runs are deleted.

The texts are one sequence of line ids per document. Their suffixes are sorted by prefix
doubling: the rank of the first 2**(k+1) lines of a suffix is the rank of the pair (rank of its
first 2**k lines, rank of the 2**k lines behind them). Only suffixes whose prefix occurs again
stay from one round to the next. Equal ranks are the intervals of the suffix array whose longest
common prefix is 2**k or more; an interval of any other depth d is the set of suffixes with equal
ranks at their start and at d - 2**k.

Of a repeated run, the shortest windows of enough words are looked at: from each line on, and up
to each line. The intervals of these windows' depths hold all their copies, the earliest one stays,
and what the later ones cover together is exactly what the maximal repeated runs of enough words
cover. Everything is DataFrame code; equal keys are combined before they are shuffled, and the joins
back to the rows can be split where a key is large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsfuse.llm.store import kept, split_likely

KEY = ["doc", "mark"]


def _ranked(names: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and ``rank``, the place of each row of ``names`` (without repeats) in the order of ``by``."""
    dealt = kept(names.select(*by).repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return dealt.withColumn("place", place).join(sizes, "part").select(*by, (F.col("place") + F.col("ahead")).alias("rank"))


def _windows(lines: DataFrame, words: int) -> DataFrame:
    """``(doc, mark, start, size)``: the shortest windows of ``words`` words or more inside runs of
    neighbouring rows of ``lines(doc, mark, line, words)``, from each line on and up to each line.
    """
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("line"))
    rows = lines.withColumn("run", F.col("line") - place)
    so_far = F.sum("words").over(Window.partitionBy(*KEY, "run").orderBy("line"))
    rows = rows.withColumn("upto", so_far).withColumn("ahead", F.col("upto") - F.col("words"))
    group = [*KEY, "run"]
    # points and questions on one axis; a running extremum answers each question by the nearest point
    forward = rows.select(
        *group, "line",
        F.expr(f"explode(array(struct(upto AS at, 0 AS ask), struct(ahead + {words} AS at, 1 AS ask))) AS x"),
    ).select(*group, "line", "x.*")
    seen = F.min(F.expr("CASE WHEN ask = 0 THEN line END"))
    seen = seen.over(Window.partitionBy(*group).orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, 0))
    forward = forward.withColumn("end", seen).where("ask = 1 AND end IS NOT NULL")
    backward = rows.select(
        *group, "line",
        F.expr(f"explode(array(struct(ahead AS at, 0 AS ask), struct(upto - {words} AS at, 1 AS ask))) AS x"),
    ).select(*group, "line", "x.*")
    seen = F.max(F.expr("CASE WHEN ask = 0 THEN line END"))
    seen = seen.over(Window.partitionBy(*group).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0))
    backward = backward.withColumn("start", seen).where("ask = 1 AND start IS NOT NULL")
    both = forward.select(*KEY, F.col("line").alias("start"), F.col("end")).union(backward.select(*KEY, "start", F.col("line").alias("end")))
    return both.distinct().select(*KEY, "start", (F.col("end") - F.col("start") + 1).alias("size"))


def repeated_lines(docs: DataFrame, words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, mark, gone)``: numbers (from 0) of the lines that later copies hold; ``mark`` hashes the text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("mark"), F.split(f"`{text_col}`", "\n", -1).alias("lines"))
    rows = rows.where("doc IS NOT NULL AND lines IS NOT NULL").select(*KEY, F.posexplode("lines").alias("line", "content"))
    counted = F.expr("CASE WHEN trim(content) = '' THEN 0 ELSE length(content) - length(replace(content, ' ', '')) + 1 END")
    rows = kept(rows.select(*KEY, "line", F.xxhash64("content").alias("id"), counted.alias("words")))

    again = rows.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    first = _ranked(again, ["id"])
    lines = kept(rows.join(first, "id").select(*KEY, "line", "words", "rank").dropDuplicates([*KEY, "line"]))
    windows = kept(_windows(lines.drop("rank"), words).withColumn("k", F.floor(F.log2("size")).cast("int")))
    deepest = windows.agg(F.max("k")).first()[0]
    if deepest is None:
        return windows.select(*KEY, F.array("start").alias("gone"))

    ranks, later = lines.select(*KEY, "line", "rank"), []
    for k in range(deepest + 1):
        width = 1 << k
        head = ranks.select(*KEY, F.col("line").alias("start"), F.col("rank").alias("r1"))
        tail = ranks.select(*KEY, F.col("line").alias("middle"), F.col("rank").alias("r2"))
        here = windows.where(F.col("k") == k).withColumn("middle", F.expr(f"start + size - {width}"))
        here = here.join(head, [*KEY, "start"]).join(tail, [*KEY, "middle"])
        here = here.select(*KEY, "start", "size", "r1", "r2")
        copies = here.groupBy("size", "r1", "r2").agg(F.count("*").alias("times"), F.min(F.struct(*KEY, "start")).alias("earliest"))
        copies = copies.where("times > 1").drop("times")
        here = here.join(copies, ["size", "r1", "r2"]).where(F.struct(*KEY, "start") != F.col("earliest"))
        later.append(kept(here.select(*KEY, "start", "size")))
        if k < deepest:
            pairs = head.join(tail.withColumn("start", F.expr(f"middle - {width}")), [*KEY, "start"]).select(*KEY, "start", "r1", "r2")
            twice = pairs.groupBy("r1", "r2").agg(F.count("*").alias("times")).where("times > 1")
            deeper = pairs.join(_ranked(twice, ["r1", "r2"]), ["r1", "r2"])
            ranks = kept(deeper.select(*KEY, F.col("start").alias("line"), "rank"))
    covered = reduce(DataFrame.union, later)
    covered = covered.select(*KEY, F.expr("explode(sequence(start, start + size - 1))").alias("line"))
    return covered.groupBy(*KEY).agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text_col``, and ``n_lines`` and
    ``n_removed`` (in place of columns of these names).

    A line ends at a line feed. A run of neighbouring lines counts when the same lines in the same
    order occur at an earlier place (smaller id, or earlier in the text; overlaps included) and it
    has at least ``words`` words (spaces plus one; blank lines have none). All lines of such runs
    go; what they say stays at the earliest place. A text that loses all lines becomes empty. Null
    texts stay null with null counts; rows with a null id are not compared and stay as they are.
    Repeated rows (one id, one text) are one place: they lose the same lines. Order of lines, other
    columns and the number of rows stay.
    """
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    gone = repeated_lines(docs, words, id_col, text_col)
    gone = kept(gone.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone")))
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_removed")])
    maybe, same = split_likely(rows.withColumn("__doc", key), gone, "__doc")
    counted = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    none = F.when(text.isNotNull(), F.lit(0)).cast("long").alias("n_removed")
    same = same.select(*[f"`{c}`" for c in rows.columns], counted, none)
    maybe = maybe.withColumn("__mark", F.xxhash64(text)).join(gone, ["__doc", "__mark"], "left")
    lines = F.split(text, "\n", -1)
    cleaned = F.expr(
        f"""CASE WHEN __gone IS NULL THEN `{text_col}` ELSE array_join(transform(
            array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i]), '\n') END"""
    )
    number = F.when(text.isNotNull(), F.coalesce(F.size("__gone"), F.lit(0))).cast("long").alias("n_removed")
    maybe = maybe.withColumn("__lines", lines)
    result = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns]
    return same.union(maybe.select(*result, counted, number))
