"""Connected components by hooking to the smallest neighbour and pointer jumping, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, stored


def looked_up(df: DataFrame, key: str, pairs: DataFrame, rows: int, name: str) -> DataFrame:
    """df with column `name`: what pairs (node, parent) give for its key, else the key itself.

    Up to BROADCAST_ROWS pairs of two longs go to every executor; more are met in a shuffle join, whose skewed keys Spark splits.
    """
    right = pairs.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    right = F.broadcast(right) if rows <= BROADCAST_ROWS else right
    return df.join(right, F.col(key) == F.col("__node"), "left").withColumn(name, F.coalesce("__parent", key)).drop("__node", "__parent")


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, parent): for every node of the edges (a, b) the smallest node of its component; and the number of nodes.

    In a round each node hooks to its smallest neighbour, chains of hooks are shortened until they end at roots, and
    edges are renamed to roots; equal ones merge. A star or a path takes one round. The tables between rounds are written.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    found, size = None, 0
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        hooks = stored(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent")), "hooks")
        n = hooks.count()
        while True:
            jumped = looked_up(hooks, "parent", hooks, n, "above")
            jumped = stored(jumped, "hooks")
            moved = jumped.where("above != parent").limit(1).count()
            hooks = jumped.select("node", F.col("above").alias("parent"))
            if not moved:
                break
        if found is None:
            found, size = hooks, n
        else:
            found = stored(looked_up(found, "parent", hooks, n, "above").select("node", F.col("above").alias("parent")), "labels")
        renamed = looked_up(looked_up(left, "a", hooks, n, "x"), "b", hooks, n, "y")
        left = stored(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
    if found is None:
        found = left.select(F.col("a").alias("node"), F.col("b").alias("parent"))
    return found, size
