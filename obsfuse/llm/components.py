"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsfuse.llm.store import kept


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long ids, in any direction -> ``(node, root)``, root the smallest id reachable.

    Each round takes the smallest root among a node's neighbours and then that root's own
    root, so the number of rounds follows the logarithm of the longest path. Both joins are
    sort-merge joins whose large keys Spark may split; the grouped minimum is combined before
    its shuffle. Loops and repeated links do no harm; no links give no rows.
    """
    both = kept(links.selectExpr("a AS node", "b AS near").union(links.selectExpr("b", "a")).distinct())
    roots = kept(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("low"))
        hop = roots.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        step = kept(
            roots.join(near, "node", "left")
            .join(hop, "root", "left")
            .select("node", F.least("root", "low", "jump").alias("root"), F.col("root").alias("was"))
        )
        roots = step.select("node", "root")
        if step.where("root < was").isEmpty():
            return roots
