"""Connected components of a large, sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for each node in edges (columns a and b).

    Each round, every node joins its least neighbour (taken map-side, so a node with many neighbours sends one row a task)
    and that one's least neighbour in turn; then edges are drawn between the joined nodes and those inside one are dropped, so
    that a round works on a fraction of the last one's edges. Each round's tables are written. An empty table gives an empty one.
    """
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")), "parents")
        upper = parent.select(F.col("node").alias("parent"), F.col("parent").alias("label"))
        rounds.append(materialise(parent.join(upper, "parent").select("node", "label"), "labels"))
        low = rounds[-1].select(F.col("node").alias("a"), F.col("label").alias("x"))
        high = rounds[-1].select(F.col("node").alias("b"), F.col("label").alias("y"))
        drawn = left.join(low, "a").join(high, "b").where("x <> y")
        left = materialise(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).where(F.lit(False))
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = materialise(rounds.pop().join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label")), "labels")
    return labels
