"""Admission of whole update logs as tables: successor joins and pointer doubling.

An update is admitted when it can follow the last one that was. So each update names its successor, and the
admitted ones are those that the first update of a stream reaches; verdicts on the others come from the
last admitted update before them. No log is walked row by row, and none lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsfuse.operators.ranking import with_row_number, with_running
from obsfuse.runtime import attach, durable

RULES = ("interval", "bias")


def _name(column: str) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _successors(nodes: DataFrame, adjoining: bool) -> DataFrame:
    """``(k, at, to)``: the next node that starts where a node stops or, if not ``adjoining``, not before that.

    Nodes have one row for each start of a stream.
    """
    stops = nodes.select("k", "at", F.col("stop").alias("v"))
    starts = nodes.select("k", F.col("start").alias("v"), F.col("at").alias("to"))
    if adjoining:
        return attach(stops, starts, ["k", "v"], "inner").select("k", "at", "to")
    marks = starts.select("k", "v", F.lit(1).alias("s")).unionByName(stops.select("k", "v", F.lit(0).alias("s")))
    marks = marks.groupBy("k", "v").agg(F.max("s").cast("bigint").alias("s"))
    marks = durable(with_running(marks, ["k"], ["v"], {"c": F.col("s")}))
    wanted = marks.select("k", "v", (F.col("c") - F.col("s") + 1).alias("c"))
    at = marks.where("s = 1").select("k", "c", F.col("v").alias("start"))
    found = wanted.join(at, ["k", "c"]).join(starts.withColumnRenamed("v", "start"), ["k", "start"]).select("k", "v", "to")
    return attach(stops, found, ["k", "v"], "inner").select("k", "at", "to")


def _reached(head: DataFrame, links: DataFrame) -> DataFrame:
    """``(k, at)`` of the chains that begin at ``head``; round k adds the 2^k nodes behind the first 2^k."""
    found, jump = head.select("k", "at"), durable(links)
    while True:
        ahead = durable(found.join(jump, ["k", "at"]).select("k", F.col("to").alias("at")))
        if ahead.isEmpty():
            return found
        found = durable(found.unionByName(ahead))
        far = jump.select("k", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = durable(jump.join(far, ["k", "to"]).select("k", "at", F.col("far").alias("to")))


def admit_log(updates: DataFrame, rule: str = "interval") -> DataFrame:
    """One verdict for each row of ``updates(stream_id, update_id, start, stop, identity[, rows])``.

    Rows of a stream are judged by (start, stop, update_id), nulls first. The first one with stop > start opens
    the stream and fixes its identity. Under ``interval`` the next one has to start at the last admitted stop,
    under ``bias`` not before it; no update id is admitted twice. Returns ``(stream_id, update_id, start, stop,
    admitted, reason, row_start, row_stop)``, the last two counting ``rows`` of admitted bias updates (0 under
    ``interval``). A null id is an id; a null start or stop is an empty interval; other columns are not read.

    Chains take log2(length) rounds. A log in which an admitted id would come again with a fitting interval
    takes another pass for each such update of one stream; updates that are merely sent twice do not.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    interval = rule == "interval"
    amount = F.lit(0) if interval or "rows" not in updates.columns else F.coalesce(F.col("rows"), F.lit(0))
    rows = updates.select(
        F.col("stream_id").cast("string").alias("stream_id"), F.col("update_id").cast("string").alias("update_id"),
        F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), F.col("identity").cast("string").alias("identity"),
        amount.cast("bigint").alias("rows"), _name("stream_id").alias("k"), _name("update_id").alias("u"),
        F.coalesce(F.col("stop") <= F.col("start"), F.lit(True)).alias("empty"),
    )
    rows = durable(with_row_number(rows, ["k"], ["start", "stop", "update_id", "identity", "rows"], "at").drop("at_total"))
    head = rows.where("NOT empty").groupBy("k").agg(F.min("at").alias("at"), F.min_by(F.struct("identity"), "at").alias("opened"))
    head = durable(head.select("k", "at", F.col("opened.identity").alias("own")))
    rows = attach(rows, head.select("k", "own"), ["k"], salt_by=["at"]).withColumn("same", F.col("identity").eqNullSafe(F.col("own"))).drop("own")
    rows = durable(rows)

    refused: DataFrame | None = None
    while True:
        able = rows.where("NOT empty AND same")
        if refused is not None:
            able = able.join(refused, ["k", "at"], "left_anti")
        first = F.min_by(F.struct("at", "stop", "u"), "at").alias("n")
        nodes = durable(able.groupBy("k", "start").agg(first).select("k", "start", "n.*"))
        chain = durable(_reached(head, _successors(nodes, interval)).join(nodes, ["k", "at"]))
        ids = durable(chain.groupBy("k", "u").agg(F.min("at").alias("first")))
        again = chain.join(ids, ["k", "u"]).where("at > first").groupBy("k").agg(F.min("at").alias("at"))
        again = durable(again)
        if again.isEmpty():
            break
        refused = durable(again if refused is None else refused.unionByName(again))

    judged = rows.join(chain.select("k", "at", F.lit(1).alias("in")), ["k", "at"], "left").fillna(0, ["in"])
    counts = {"n": F.col("in").cast("bigint"), "total": F.col("in") * F.col("rows")}
    judged = durable(with_running(judged, ["k"], ["at"], counts))
    last = judged.where("in = 1").select("k", "n", F.col("stop").alias("last"))
    judged = attach(judged, last, ["k", "n"], salt_by=["at"])
    judged = attach(judged, ids, ["k", "u"], salt_by=["at"])
    repeated = F.when((F.col("n") > 0) & (F.col("first") < F.col("at")), "repeated-update")
    empty = F.when(F.col("empty"), "empty-interval")
    if interval:
        place = F.when(F.col("start") < F.col("last"), "reopened-interval").when(F.col("start") > F.col("last"), "gap")
        why = F.coalesce(repeated, empty, place, F.lit("identity-changed"))
    else:
        why = F.coalesce(empty, F.when(~F.col("same"), "model-changed"), repeated, F.lit("overlaps-retained"))
    taken = F.col("in") == 1
    return judged.select(
        "stream_id", "update_id", "start", "stop", taken.alias("admitted"), F.when(~taken, why).alias("reason"),
        F.when(taken, F.col("total") - F.col("rows")).alias("row_start"), F.when(taken, F.col("total")).alias("row_stop"),
    )
