"""A cleaning pipeline for training text: five stages, each over all rows its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``, where ``docs`` has the columns of the table
``documents``, and returns a DataFrame; ``run`` writes each result as Parquet and reads it again.
All stages but the last return the columns of ``documents`` (``n_chars`` follows the text).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsfuse.llm import jaccard_join, line_dedup, packing, pii, queries, toxicity
from obsfuse.llm.store import kept


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with the code points of the text counted anew."""
    size = F.length("text").cast(dict(like.dtypes)["n_chars"])
    return docs.withColumn("n_chars", size).select(like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity is 0.3 or more."""
    return toxicity.drop_toxic(docs, queries.toxicity_machine(spark, docs, sf_dir), threshold=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of line runs; documents that lose all their text that way go."""
    out = line_dedup.dedup_lines(docs)
    return _columns(out.where("text <> '' OR text IS NULL OR n_removed = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return _columns(pii.redact(docs, pii.fit_finder(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The trained stages cannot be said in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
