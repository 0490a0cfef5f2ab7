"""Incremental aggregates, sliding assignment, stream binding, decision ledger."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsfuse.operators import gaussian, scores
from obsfuse.runtime import ensure_checkpoint_dir


def run_available(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Drain the available input into parquet at ``path`` (append outputs only)."""
    ckpt = checkpoint or f"{path}.checkpoint"
    q = df.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", path).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_updates(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Drain the available input through ``sink(batch, epoch)`` in update or complete mode."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def causal_rows(stream: DataFrame, path: str, time: str = "ts", delay: str = "0 seconds") -> StreamingQuery:
    """Drain the available input into ``path``, with rows behind the causal watermark told apart.

    The watermark of a micro-batch is the latest ``time`` of all batches before it, less ``delay``; a row earlier
    than that is late.  Every row is written once, with ``late`` and its ``epoch``; rows that were written are never
    changed by what comes later.  Each batch also writes its latest time, from which the next ones take their
    watermark, so a repeated batch or a restart from the checkpoint gives the same rows.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = F.max(F.col(time)).alias("latest")
        mark = None
        if epoch > 0:
            mark = spark.read.parquet(f"{path}/marks").where(F.col("epoch") < epoch).agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        late = F.lit(False) if mark is None else F.coalesce(F.col(time) < F.lit(mark), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        spark.read.parquet(f"{path}/rows/epoch={epoch}").agg(latest).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")

    return run_updates(stream, sink, f"{path}/checkpoint", "append")


def overlapping_windows(df: DataFrame, size: str, stride: str, keys: Sequence[str], aggs: Sequence[Column], time: str = "ts") -> DataFrame:
    """Assign every row to all windows [k stride, k stride + size) and aggregate."""
    return df.groupBy(F.window(time, size, stride), *keys).agg(*aggs)


def query_projection(rows: DataFrame, keys: Sequence[str], q: int, rank: int) -> DataFrame:
    """Streaming form of the query projection: the same mergeable sums, update mode."""
    return gaussian.query_statistics(rows, keys, q, rank)


def incremental_scorecard(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Streaming sums of the uncertainty scorecard; rank metrics wait for the close."""
    return scores.scored_residuals(rows).groupBy(*keys).agg(*scores.calibration_aggregates())


def bind_streams(factors: DataFrame, biases: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Factor and bias updates joined on (stream, update id) within event time.

    Inner stream-stream join with watermarks; ``reason`` is null where index, interval,
    row count and identity agree, else the first disagreement (quarantine).
    """
    f = factors.withWatermark("ts", delay).alias("f")
    b = biases.withWatermark("ts", delay).alias("b")
    on = (
        (F.col("f.stream_id") == F.col("b.stream_id"))
        & (F.col("f.update_id") == F.col("b.observation_update_id"))
        & (F.col("b.ts") >= F.col("f.ts") - F.expr(f"INTERVAL {delay}"))
        & (F.col("b.ts") <= F.col("f.ts") + F.expr(f"INTERVAL {delay}"))
    )
    why = (
        F.when(F.col("f.update_index") != F.col("b.update_index"), "index-differs")
        .when((F.col("f.start") != F.col("b.start")) | (F.col("f.stop") != F.col("b.stop")), "interval-differs")
        .when(F.col("f.rows") != F.col("b.rows"), "row-count-differs")
        .when(~F.col("f.identity").eqNullSafe(F.col("b.identity")), "identity-differs")
    )
    return f.join(b, on).select(
        F.col("f.stream_id").alias("stream_id"), F.col("f.update_id").alias("update_id"), F.col("b.update_id").alias("bias_update_id"),
        F.col("f.start").alias("start"), F.col("f.stop").alias("stop"), why.alias("reason"),
    )


def bind_complete(factors: DataFrame, biases: DataFrame) -> DataFrame:
    """Batch close of the binding: full join, so one-sided updates are reported too."""
    f = factors.select("stream_id", "update_id", *[F.col(c).alias(f"f_{c}") for c in ("update_index", "start", "stop", "rows", "identity")])
    b = biases.select(
        "stream_id", F.col("observation_update_id").alias("update_id"), F.col("update_id").alias("bias_update_id"),
        *[F.col(c).alias(f"b_{c}") for c in ("update_index", "start", "stop", "rows", "identity")],
    )
    j = f.join(b, ["stream_id", "update_id"], "full")
    why = (
        F.when(F.col("f_start").isNull(), "missing-factor-update")
        .when(F.col("b_start").isNull(), "missing-bias-update")
        .when(F.col("f_update_index") != F.col("b_update_index"), "index-differs")
        .when((F.col("f_start") != F.col("b_start")) | (F.col("f_stop") != F.col("b_stop")), "interval-differs")
        .when(F.col("f_rows") != F.col("b_rows"), "row-count-differs")
        .when(~F.col("f_identity").eqNullSafe(F.col("b_identity")), "identity-differs")
    )
    return j.select("stream_id", "update_id", "bias_update_id", why.alias("reason"))


def rolling_state(edges: DataFrame, lag: int = 4) -> DataFrame:
    """Fixed-lag gauges over a stream of edge arrivals (keyed by case).

    Each micro-batch appends its edges to the case's admitted edge log (state) and emits
    the smoothed gauges of the windows that closed.  State per case is its edge log, which
    is tiny next to the samples.
    """
    from obsfuse.streaming.smoother import GAUGE_OUTPUT, RollingGauges

    return edges.groupBy("case_id").transformWithStateInPandas(
        RollingGauges(lag), outputStructType=GAUGE_OUTPUT, outputMode="Append", timeMode="None"
    )


def append_ledger(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: append decisions whose group is not in the ledger yet.

    Batches carry their epoch, so a replayed epoch is dropped instead of appended twice.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["group_id"])
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            new = new.join(spark.read.parquet(path).select("group_id"), "group_id", "left_anti")
        new.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return sink


def ledger_summary(ledger: DataFrame) -> DataFrame:
    acc = F.col("accepted")
    return ledger.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.when(acc, 1).otherwise(0)).alias("accepted"),
        F.sum(F.when(~acc, 1).otherwise(0)).alias("fallback"),
        F.sum(F.when(~acc & F.col("exact_fallback"), 1).otherwise(0)).alias("exact_fallback"),
    )


def stream_checkpoint(spark, name: str) -> str:  # noqa: ANN001
    """A checkpoint folder below the shared checkpoint directory of the session."""
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}"
