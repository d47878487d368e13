"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) -> (node, root): the smallest node reachable from each node that has an edge.

    Each round contracts the graph: every node points to its smallest neighbour or itself, pointers are followed once
    more, and edges between different targets go on. All steps are pre-aggregated or joins by node; the edge table
    shrinks from round to round, and a written table cuts the lineage. A hub's rows are only joined, never gathered.
    """
    edges = scratch.keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    label = None
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), f"{name}-up{step}")
        # Two jumps along pointers to smaller nodes; a root points to itself.
        for jump in range(2):
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("far"))
            parent = scratch.keep(parent.join(over, "up").select("node", F.col("far").alias("up")), f"{name}-up{step}-{jump}")
        if label is None:
            label = parent.select("node", F.col("up").alias("root"))
        else:
            over = parent.select(F.col("node").alias("root"), "up")
            label = label.join(over, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        label = scratch.keep(label, f"{name}-label{step}")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("x")), parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        step += 1
        edges = scratch.keep(left, f"{name}-edges{step}")
        scratch.drop(f"{name}-edges{step - 1}", f"{name}-up{step - 1}", f"{name}-up{step - 1}-0", *([f"{name}-label{step - 2}"] if step > 1 else []))
        if edges.isEmpty():
            return label
