"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Each round maps every node to the smallest of itself and its neighbours (an
    aggregation with partial sums, so a hub costs one row per task), relabels the edges
    and drops those inside one node. Stars vanish in one round, and at least half of the
    nodes of any component in each. Every round's result is a written table.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        to = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")))
        # a smallest neighbour may itself move on: follow it once
        up = to.select(F.col("node").alias("to"), F.col("to").alias("top"))
        step = written(to.join(up, "to").select("node", F.col("top").alias("to")))
        drop_written(to)
        if labels is None:
            labels = step
        else:
            moved = labels.select("node", F.col("to").alias("at")).join(step.select(F.col("node").alias("at"), F.col("to").alias("next")), "at", "left")
            before, labels = labels, written(moved.select("node", F.coalesce("next", "at").alias("to")))
            drop_written(before)
        a = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        old, edges = edges, written(edges.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        drop_written(old)
        if labels is not step:
            drop_written(step)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    drop_written(edges)
    return labels.select("node", F.col("to").alias("component"))
