"""Connected components of an edge table by random contraction, every round a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``edges`` (columns ``a``, ``b``); ``root`` is the smallest node of the component.

    Each round joins every node to the neighbour (or itself) of least hash, and keeps the edges between what is left, so
    that the number of nodes falls by a constant factor whatever the shape of the graph. Rounds are written tables; only
    the count of the edges left reaches the driver. Loops and repeated edges are allowed; no edges give no rows.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    left, steps, rounds = edges, [], [edges]
    while left.take(1):
        both = left.union(left.select("b", "a")).toDF("node", "other")
        salt = F.lit(len(steps))
        order = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("to"))
        step = both.groupBy("node").agg(F.min(order("other")).alias("best")).select(
            "node", F.least(F.col("best"), order("node"))["to"].alias("to"))
        step = stored(step, "step")
        steps.append(step)
        one = step.toDF("a", "a_to")
        two = step.toDF("b", "b_to")
        left = stored(
            left.join(one, "a").join(two, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
            .where("a != b").distinct(), "edges")
        rounds.append(left)
    labels = ends.withColumn("root", F.col("node"))
    for step in steps:
        labels = labels.join(step.toDF("root", "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"))
    labels = stored(labels, "labels")
    drop(*rounds, *steps)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
