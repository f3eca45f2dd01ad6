"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import last_written, written


def connected(edges: DataFrame) -> DataFrame:
    """A written table of node, root (the least node of its component) of every node of the edges (a, b).

    Each round a node takes the least label around it and then that label's own
    label, so rounds grow with the logarithm of a component's diameter.  All
    rounds are written tables; only the number of changes reaches the driver.
    """
    return last_written(edges.sparkSession, lambda: labelled(edges))


def labelled(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        jumped = lower.join(labels.select(F.col("node").alias("via"), F.col("root").alias("far")), "via").select("node", "old", F.least("via", "far").alias("root"))
        new = written(jumped)
        if not new.where("old <> root").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
