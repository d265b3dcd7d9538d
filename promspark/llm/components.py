"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of the edges (a, b); label is the smallest node reachable.

    Each round points every node to its smallest neighbour and on to that one's, and then replaces the
    nodes of the edges by what they point to: edges within a group go, equal ones become one.  So the
    rows of a round fall from round to round also along a path, and all rounds together read a few
    times the edges.  Rounds are tables in the shared folder; to the driver comes a number a round."""
    rest = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    loops = edges.select(F.col(a).alias("node")).where(F.col(a) == F.col(b)).distinct()
    steps: list[DataFrame] = []
    while not steps or not rest.isEmpty():
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        points = written(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
        for _ in range(2):
            on = points.select(F.col("node").alias("label"), F.col("label").alias("next"))
            points = written(points.join(on, "label").select("node", F.col("next").alias("label")))
        steps.append(points)
        x, y = (points.select(F.col("node").alias(s), F.col("label").alias(f"to_{s}")) for s in "ab")
        rest = rest.join(x, "a").join(y, "b").where("to_a <> to_b")
        rest = written(rest.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    labels = steps.pop()
    while steps:
        last = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        labels = written(steps.pop().join(last, "label", "left").select("node", F.coalesce("end", "label").alias("label")))
    return labels.union(loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
