"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsfuse.llm import (
    conversation_repair,
    fingerprints,
    jaccard_join,
    language_id,
    line_dedup,
    packing,
    pii,
    secret_scan,
    sentence_pieces,
    source_divergence,
    token_counts,
    toxicity,
    vector_search,
)
from obsfuse.llm.queries_sql import DIVERGENCE_SQL, REPAIR_SQL, SECRETS_SQL
from obsfuse.llm.store import kept
from obsfuse.runtime import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL for the rows of a query, where SQL can express it.
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def wrap(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return wrap


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op1_jaccard_join")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf, "documents"))


@_query("op9_line_dedup")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))


def _held_out(modulus: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf: str) -> toxicity.Machine:
    """The machine of ``op4`` and of the pipeline, fitted on labels that are not held out."""
    return toxicity.fit_toxicity(docs, _table(spark, sf, "labels").where(~_held_out(4, 2)))


@_query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_machine(spark, docs, sf))
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query("op8_pii")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    found = pii.find_pii(docs, pii.fit_finder(docs))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    said = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for c in ("base", "spans")}
    return found.select("doc_id", *counts, F.sha2(said["base"], 256).alias("base_sha256"), said["spans"].alias("spans"))


@_query("op5_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op2_fingerprints")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    made = fingerprints.fingerprint_edits(_table(spark, sf, "documents"))
    named = {"fingerprint": "sketch", "edited_fingerprint": "edited_sketch"}
    shown = [fingerprints.shown(F.col(c)).alias(name) for name, c in named.items()]
    return made.select("doc_id", "n_chars", "edited_sha256", *shown, "near_edited", "near_next", "n_shingles")


@_query("op10_language_id")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    trees = language_id.fit_languages(docs.where(~_held_out(5, 0)))
    return language_id.identify(docs, trees).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query(
    "op7_vector_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    table = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    good = vector_search.usable(F.col("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double"))
    vectors = table.where(good).select("vec_id", whole.alias("embedding"))
    return vector_search.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@_query("op3_sentence_pieces")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_pieces.digests(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf, "documents"))


@_query("op12_secret_scan", SECRETS_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_versions(_table(spark, sf, "documents"), fresh_folder(spark, "ledger"))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{r.kind}'))").cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE]

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@_query("op13_conversation_repair", REPAIR_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    table = _table(spark, sf, "conversations")
    turns = conversation_repair.damage(table)
    plans = kept(conversation_repair.edit_plans(turns))
    hashes = conversation_repair.digests(conversation_repair.repaired_turns(turns, plans)).withColumnRenamed("conv_id", "hashed")
    convs = table.select(F.col("conv_id").alias("conv")).distinct()
    out = convs.join(plans, F.col("conv").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("conv").eqNullSafe(F.col("hashed")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return out.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
