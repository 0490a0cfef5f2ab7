"""Secret scans over all versions of files, with an incremental ledger of contents.

Every version of a file is addressed by the SHA-256 of its text; equal texts are one blob, whatever their
paths. The ledger is a folder of Parquet tables, one for each scan, with a row for each blob that the scan
read: which rules in which versions, and what they found. A scan reads only the pairs of blob and rule
version that no earlier scan has read, and joins the findings back to all paths of a blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsfuse.llm.store import kept, likely, text_batches
from obsfuse.runtime import attach


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least``
    characters or more. A change of any field needs another ``version``.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Patterns of the base kinds (fixed values).
BASE = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),  # noqa: E501
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)
#: Further kinds: signed web tokens, keys in text form, host tokens, passwords in addresses.
MORE = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host", 1, r"(gh[opsu]_|xox[abprs]-)[A-Za-z0-9-]+", 0, 20),
    Rule("url", 1, r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20:/@]+:[^\x00-\x20/@]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

FOUND = "array<struct<rule: string, start: bigint, stop: bigint>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def spans(text: str, rule: Rule, finder: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end (exclusive) of the rule's matches, in code points."""
    for match in finder.finditer(text):
        start, stop = match.span(rule.group)
        if stop - start >= rule.least:
            yield match.span()


def _scanner(rules: Sequence[Rule]):
    finders = {r.name: (r, re.compile(r.pattern)) for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            out = []
            for text, names in zip(texts.to_pylist(), part.column("rules").to_pylist(), strict=True):
                found = []
                for name in names:
                    rule, finder = finders[name]
                    found += [{"rule": name, "start": a, "stop": b} for a, b in spans(text, rule, finder)]
                out.append(found)
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("rules"), pa.array(out, kind)], ["blob", "rules", "found"])

    return scan


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of the ledger; none where no scan has been written yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def unseen(contents: DataFrame, paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(blob, text, rules)``: once each text of ``contents(blob, text)`` that has rules it was not read with.

    A text that surely occurs once in ``paths(blob)`` and surely not in the ledger is taken where it
    lies; the others are combined by blob before they are moved.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    again = paths.groupBy("blob").agg(F.count("*").alias("n")).where("n > 1").select("blob")
    read = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("read"))
    marked = likely(contents, again.union(ledger.select("blob")), "blob")
    alone = marked.where("NOT __likely").select("blob", "text", names.alias("rules"))
    shared = marked.where("__likely").groupBy("blob").agg(F.min("text").alias("text")).join(read, "blob", "left")
    shared = shared.select("blob", "text", F.array_except(names, F.coalesce("read", F.array().cast("array<string>"))).alias("rules"))
    return alone.union(shared.where(F.size("rules") > 0))


def scan_versions(
    docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, blob, spans)`` for every row of ``docs``: a row is one version at one path.

    ``spans`` is an array of ``(kind, start, stop)`` by start, then by the order of ``rules``; start and
    stop (exclusive) count code points. Whole texts are read; a null text is the empty one. Rows with a null
    or repeated id stay rows of their own; equal texts are read once and have equal spans; an empty table
    gives no rows. Other columns are left behind. The scan adds one table to the folder ``ledger``; a scan that
    failed before its table was committed left nothing behind, and one that is repeated reads nothing twice.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    contents = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = kept(docs.select(F.col(f"`{id_col}`").alias("__path"), F.sha2(text, 256).alias("blob")))
    scanned = unseen(contents, paths, read_ledger(spark, ledger), rules).mapInArrow(_scanner(rules), LEDGER)
    scanned.write.parquet(f"{ledger}/scan-{uuid.uuid4().hex}")

    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    names = [r.name for r in rules]
    found = read_ledger(spark, ledger).select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin(names)).distinct()
    row = F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("place"), F.split_part("f.rule", F.lit("@"), F.lit(1)).alias("kind"), F.col("f.stop").alias("stop"))
    found = found.groupBy("blob").agg(F.sort_array(F.collect_list(row)).alias("spans"))
    shown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    found = kept(found.select("blob", shown.alias("spans")))
    none = F.array().cast("array<struct<kind: string, start: bigint, stop: bigint>>")
    marked = likely(paths, found, "blob")
    clean = marked.where("NOT __likely").select("__path", "blob", none.alias("spans"))
    hit = attach(marked.where("__likely").drop("__likely"), found, ["blob"], salt_by=["__path"])
    hit = hit.select("__path", "blob", F.coalesce("spans", none).alias("spans"))
    return clean.union(hit).withColumnRenamed("__path", id_col)
