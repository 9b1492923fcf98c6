"""Dependency graphs: dangling references, cycles and ancestors, by frontier steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.storage import durable


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (node, needs) whose needed node does not exist."""
    return edges.join(nodes.select(F.col("node").alias("needs")).distinct(), "needs", "left_anti").select("node", "needs")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) of the nodes that lie on a cycle or between cycles: what is left when nodes without open needs, and
    nodes that nothing left needs, are peeled off. No rows for an acyclic graph. One step per level of the graph."""
    left = durable(edges.select("node", "needs").distinct())
    while True:
        inner = durable(
            left.join(left.select(F.col("node").alias("needs")).distinct(), "needs", "left_semi")
            .join(left.select(F.col("needs").alias("node")).distinct(), "node", "left_semi").select("node", "needs")
        )
        if inner.count() == left.count():
            return inner.select("node").distinct()
        left = inner


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): all that the start nodes need, directly or not, with the least number of steps."""
    reached = durable(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while True:
        depth += 1
        new = edges.join(frontier.select("node"), "node", "left_semi").select(F.col("needs").alias("node")).distinct()
        frontier = durable(new.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return reached
        reached = durable(reached.unionByName(frontier))
