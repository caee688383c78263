"""Connected components of links between binary keys, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators.skew import salted_join
from provena.runtime import materialise


def _ranked(column: str):
    """Nodes in an order that has nothing to do with their names."""
    return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("to"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node reachable.

    Every round contracts the graph: each node moves to its neighbour of least
    rank and on to that one's own choice, links follow their ends, and links
    within one node go. Ranks are random, so a chain loses a constant part of its
    nodes a round whatever its order, and a star is one node after two; rounds are
    logarithmic in the nodes. What is left is written as a table each round, so
    plans and their size estimates start anew. A hub's links are partly
    aggregated where they are read; in the joins they are split at run time.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_ranked("b")).alias("best"))
        up = materialise(best.select(F.col("a").alias("node"), F.least("best", _ranked("a"))["to"].alias("up")), "up")
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        steps.append(materialise(up.join(jump, "up").select("node", F.col("top").alias("up")), "step"))
        a, b = (steps[-1].select(F.col("node").alias(x), F.col("up").alias(f"{x}2")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").where("a2 != b2")
        edges = materialise(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps.pop()
    while steps:  # each round's nodes are named by what their labels became later
        later = labels.select(F.col("node").alias("up"), F.col("up").alias("last"))
        labels = materialise(steps.pop().join(later, "up", "left").select("node", F.coalesce("last", "up").alias("up")), "labels")
    least = labels.groupBy("up").agg(F.min("node").alias("root"))
    return salted_join(labels, least, "up", "node").select("node", "root")
