"""Views that give the driver tables the shapes of the operator inputs.

Each view exists twice: as a DataFrame (used by the library) and as plain SQL (used
only by the correctness oracle).  No view samples, caps or filters rows away; grids
and groups grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsfuse.functions import vec3 as v3

#: orders per case in the dense-sample view; each case is a 40 x 50 grid.
CASE_SPAN, CASE_ROWS, CASE_COLS = 2000, 40, 50
#: line items that one task groups into estimates.
PART_ROWS = 250_000
#: line items that one task groups into samples, which it then sorts more than once.
SAMPLE_ROWS = 100_000


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _d(x: float):
    return F.lit(float(x))


# --- duplicate estimates per cell ------------------------------------------------


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    """cell, contributor, mean (x, y, z) and packed covariance."""
    # the rows of a cell meet first, in parts of a fixed size: no task holds the cells of a whole file split, and what is grouped by cell later stays
    li = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("contributor"), "l_quantity", "l_extendedprice", "l_tax", "l_discount"
    )
    g = (
        li.repartition(-(-max(li.count(), 1) // PART_ROWS), "cell")
        .groupBy("cell", "contributor")
        .agg(
            F.min("l_quantity").alias("q"),
            F.min("l_extendedprice").alias("p"),
            F.min("l_tax").alias("t"),
            F.min("l_discount").alias("s"),
        )
    )
    return g.select(
        "cell",
        "contributor",
        (F.col("q") / 7.0).alias("x"),
        (F.col("p") / 997.0).alias("y"),
        (F.col("s") * 100.0 / 3.0).alias("z"),
        (_d(1.0137137) + F.col("t") * 100.0 / 3.0).alias("c_xx"),
        _d(0.4871371).alias("c_xy"),
        _d(0).alias("c_xz"),
        (_d(2.0229137) + F.col("s") * 50.0 / 3.0).alias("c_yy"),
        _d(0).alias("c_yz"),
        (_d(1.5173371) + F.col("q") / 70.0).alias("c_zz"),
    )


EST_SQL = """v_est AS (
  SELECT l_orderkey AS cell, l_linenumber AS contributor,
         min(l_quantity) / 7.0 AS x, min(l_extendedprice) / 997.0 AS y, min(l_discount) * 100.0 / 3.0 AS z,
         1.0137137 + min(l_tax) * 100.0 / 3.0 AS a, CAST(0.4871371 AS DOUBLE) AS b, 2.0229137 + min(l_discount) * 50.0 / 3.0 AS c,
         1.5173371 + min(l_quantity) / 70.0 AS e
  FROM lineitem GROUP BY 1, 2)"""


# --- dense samples ----------------------------------------------------------------


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows over a (frame, row, col) grid, one similarity per window.

    The line items of a frame of a case meet before they are grouped, in parts of a fixed size: what is grouped by cell,
    by window cell or by frame later stays where it is.
    """
    k = F.col("l_orderkey")
    # numbers in the aggregates, so that rows are hashed and not sorted
    flag = F.when(F.col("l_returnflag") > "N", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    li = read(spark, sf, "lineitem")
    parts = max(-(-li.count() // SAMPLE_ROWS), spark.sparkContext.defaultParallelism)
    li = li.select(
        F.concat(F.lit("c"), F.floor(k / CASE_SPAN).cast("string")).alias("case_id"),
        k.alias("k"),
        (F.col("l_suppkey") % 4).alias("window"),
        F.col("l_linenumber").cast("bigint").alias("frame"),
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("s"),
        F.col("l_tax").alias("t"),
        flag.alias("f"),
    )
    g = (
        li.repartition(parts, "case_id", "frame")
        .groupBy("case_id", "k", "window", "frame")
        .agg(F.min("q").alias("q"), F.min("s").alias("s"), F.min("t").alias("t"), F.max("f").alias("f"))
    )
    k = F.col("k")
    g = g.select(
        "case_id",
        F.concat(F.lit("w"), F.col("window").cast("string")).alias("window_id"),
        "frame",
        F.floor((k % CASE_SPAN) / CASE_COLS).cast("int").alias("row"),
        (k % CASE_COLS).cast("int").alias("col"),
        F.col("window").cast("double").alias("w"),
        "q",
        "s",
        "t",
        "f",
    )
    w = F.col("w")
    k_ = _d(1) + w * 0.1
    return g.select(
        "case_id",
        "window_id",
        "frame",
        "row",
        "col",
        (k_ * F.col("col") + w + F.col("q") / 47.0).alias("x"),
        (k_ * F.col("row") - w + F.col("s") * 31.0 / 7.0).alias("y"),
        (k_ * (_d(10) + F.col("frame") * 2.0) + F.col("t") * 29.0 / 7.0).alias("z"),
        (F.col("f") != 1).alias("valid"),
    )


def window_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The windows and frames of `samples`: few rows, for what asks no more of them."""
    k, window = F.col("l_orderkey"), F.concat(F.lit("w"), (F.col("l_suppkey") % 4).cast("string"))
    case = F.concat(F.lit("c"), F.floor(k / CASE_SPAN).cast("string"))
    return read(spark, sf, "lineitem").select(case.alias("case_id"), window.alias("window_id"), F.col("l_linenumber").cast("bigint").alias("frame")).distinct()


SAMPLES_SQL = f"""v_samples AS (
  SELECT case_id, window_id, frame, "row", col,
         (1.0 + w * 0.1) * col + w + q / 47.0 AS x,
         (1.0 + w * 0.1) * "row" - w + s * 31.0 / 7.0 AS y,
         (1.0 + w * 0.1) * (10.0 + frame * 2.0) + t * 29.0 / 7.0 AS z,
         f <> 'N' AS valid
  FROM (SELECT 'c' || CAST(l_orderkey // {CASE_SPAN} AS VARCHAR) AS case_id,
               'w' || CAST(l_suppkey % 4 AS VARCHAR) AS window_id,
               CAST(l_suppkey % 4 AS DOUBLE) AS w,
               CAST(l_linenumber AS BIGINT) AS frame,
               (l_orderkey % {CASE_SPAN}) // {CASE_COLS} AS "row",
               l_orderkey % {CASE_COLS} AS col,
               min(l_quantity) AS q, min(l_discount) AS s, min(l_tax) AS t, max(l_returnflag) AS f
        FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6))"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Truth grid over every sampled cell: the noise-free scene."""
    return (
        samples(spark, sf)
        .select("case_id", "frame", "row", "col")
        .distinct()
        .select(
            "case_id",
            "frame",
            "row",
            "col",
            F.col("col").cast("double").alias("x"),
            F.col("row").cast("double").alias("y"),
            (_d(10) + F.col("frame") * 2.0).alias("z"),
            ((F.col("row") + F.col("col")) % 11 != 0).alias("valid"),
        )
    )


TRUTH_SQL = """v_truth AS (
  SELECT DISTINCT case_id, frame, "row", col, CAST(col AS DOUBLE) AS x, CAST("row" AS DOUBLE) AS y,
         10.0 + frame * 2.0 AS z, ("row" + col) % 11 <> 0 AS valid
  FROM v_samples)"""


# --- residual rows ------------------------------------------------------------------

#: per event type: variance of the x component; fixed values of the test view.
TYPE_VARIANCE = {"click": 0.9, "error": 1.6, "purchase": 0.6, "signup": 1.1, "view": 0.75}


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    """group, trajectory, step, frame, 3-D error, covariance, target norm."""
    return residual_columns(read(spark, sf, "events"))


def residual_columns(events: DataFrame) -> DataFrame:
    """The residual view over any event table or stream (row-local)."""
    e = events.select(
        F.col("user_id").alias("group_id"),
        F.col("event_type").alias("trajectory_id"),
        F.col("event_id").alias("step"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)).cast("bigint").alias("frame"),
        F.col("value"),
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("double").alias("k"),
    )
    var = F.lit(None).cast("double")
    for name, value in TYPE_VARIANCE.items():
        var = F.when(F.col("trajectory_id") == name, _d(value)).otherwise(var)
    j = (F.col("step") * 7919) % 101
    return e.select(
        "group_id",
        "trajectory_id",
        "step",
        "frame",
        ((F.col("value") - 50.0) / 39.7).alias("ex"),
        ((F.col("k") - 49.5) / 30.0).alias("ey"),
        ((j - 50) / 30.0).alias("ez"),
        var.alias("c_xx"),
        _d(0.2).alias("c_xy"),
        _d(0).alias("c_xz"),
        (var + 0.3).alias("c_yy"),
        _d(0).alias("c_yz"),
        (_d(0.5) + F.col("k") / 100.0).alias("c_zz"),
        (_d(1) + F.col("k") / 10.0).alias("target_norm"),
        (F.col("k") % 10 != 3).alias("valid"),
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_VARIANCE.items()) + " END"
RESID_SQL = f"""v_resid AS (
  SELECT user_id AS group_id, event_type AS trajectory_id, event_id AS step,
         epoch_us(ts) // 86400000000 AS frame,
         (value - 50.0) / 39.7 AS ex, (k - 49.5) / 30.0 AS ey,
         ((event_id * 7919) % 101 - 50) / 30.0 AS ez,
         v AS a, CAST(0.2 AS DOUBLE) AS b, v + 0.3 AS c, 0.5 + k / 100.0 AS e,
         1.0 + k / 10.0 AS target_norm, k % 10 <> 3 AS valid
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE) AS k,
               CAST({_CASE} AS DOUBLE) AS v FROM events)),
v_score AS (
  SELECT *, a * c - b * b AS d2, (a * c - b * b) * e AS det,
         (c * ex * ex - 2.0 * b * ex * ey + a * ey * ey) / (a * c - b * b) + ez * ez / e AS m2,
         sqrt(ex * ex + ey * ey + ez * ez) / greatest(target_norm, 0.01) AS risk,
         (a + c + e) / greatest(target_norm, 0.01) ** 2 AS score,
         ex * ex + ey * ey + ez * ez AS sq
  FROM v_resid)"""


# --- paired arms -----------------------------------------------------------------------


def arms(spark: SparkSession, sf: str) -> DataFrame:
    """Order rows as (group, case, frame, seed, arm) records with denominators."""
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").cast("bigint").alias("group_id"),
        F.col("o_custkey").alias("case_id"),
        F.year("o_orderdate").cast("bigint").alias("frame"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("seed"),
        F.col("o_orderstatus").alias("arm_id"),
        F.col("o_orderkey").alias("record_id"),
        (F.col("o_totalprice") / 997.0).alias("metric"),
        (F.col("o_orderkey") % 10).cast("bigint").alias("correct"),
        F.lit(10).cast("bigint").alias("predicted"),
    )


ARMS_SQL = """v_arms AS (
  SELECT CAST(c_nationkey AS BIGINT) AS group_id, o_custkey AS case_id,
         CAST(year(o_orderdate) AS BIGINT) AS frame,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS seed, o_orderstatus AS arm_id,
         o_orderkey AS record_id, o_totalprice / 997.0 AS metric,
         o_orderkey % 10 AS correct, CAST(10 AS BIGINT) AS predicted
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# --- graph edges ---------------------------------------------------------------------------


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between numbered nodes, from the larger number to the smaller, with a log scale, an RMS and a support count."""
    li = read(spark, sf, "lineitem")
    # the line items of a node meet first: edges lie together by their reference
    parts = max(-(-li.count() // PART_ROWS), spark.sparkContext.defaultParallelism)
    ends = li.where("l_suppkey <> l_partkey").select(
        F.least("l_suppkey", "l_partkey").alias("reference"), F.greatest("l_suppkey", "l_partkey").alias("moving"), "l_extendedprice", "l_quantity"
    )
    return (
        ends.repartition(parts, "reference")
        .groupBy("reference", "moving")
        .agg(
            F.log(F.min("l_extendedprice") / 1000.0).alias("log_scale"),
            F.min("l_quantity").alias("rms"),
            F.count(F.lit(1)).alias("n"),
        )
    )


EDGES_SQL = """v_edges AS (
  SELECT least(l_suppkey, l_partkey) AS reference, greatest(l_suppkey, l_partkey) AS moving,
         ln(min(l_extendedprice) / 1000.0) AS log_scale, min(l_quantity) AS rms, count(*) AS n
  FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2)"""


# --- tracks ----------------------------------------------------------------------------------


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Track points: two alternating windows per day, one point per event."""
    e = read(spark, sf, "events").select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)).cast("bigint").alias("frame"),
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("double").alias("k"),
    )
    return e.groupBy(
        F.concat(F.lit("w"), (F.col("user_id") % 2).cast("string")).alias("window_id"),
        F.col("user_id").alias("track_id"),
        "frame",
    ).agg(
        F.min("value").alias("x"),
        F.min("k").alias("y"),
        (F.max("event_id") % 7).cast("double").alias("z"),
        ((F.max("event_id") % 90 + 10) / 100.0).alias("association_probability"),
    )


TRACKS_SQL = """v_tracks AS (
  SELECT 'w' || CAST(user_id % 2 AS VARCHAR) AS window_id, user_id AS track_id,
         epoch_us(ts) // 86400000000 AS frame, min(value) AS x,
         min(CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS DOUBLE)) AS y,
         CAST(max(event_id) % 7 AS DOUBLE) AS z,
         (max(event_id) % 90 + 10) / 100.0 AS association_probability
  FROM events GROUP BY 1, 2, 3)"""


# --- embedding units ------------------------------------------------------------------------


def unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select(
        F.col("label").cast("bigint").alias("unit_id"),
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows with a 0/1 label, grouped by language."""
    lab, doc = read(spark, sf, "labels"), read(spark, sf, "documents")
    return (
        lab.join(doc, "doc_id")
        .select(
            F.col("lang").alias("group_id"),
            F.col("doc_id").alias("row_id"),
            F.col("quality").cast("double").alias("label"),
            F.array(
                F.log(F.col("n_chars").cast("double") + 1.0),
                F.col("toxic").cast("double"),
                (F.length("source") % 5).cast("double"),
            ).alias("features"),
        )
    )


__all__ = [
    "arms",
    "edges",
    "estimates",
    "labelled",
    "read",
    "residuals",
    "samples",
    "tracks",
    "truth",
    "unit_rows",
    "window_frames",
    "v3",
]
