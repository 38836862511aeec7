"""Distributed union-find: components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the edges (a, b), which may repeat and loop.

    Each round hooks every tree on the smallest tree that an edge of it reaches, then halves the paths by jumping
    to the parent's parent until all are flat. Trees shrink in number by a constant factor at least, so rounds grow
    with the logarithm of a component's diameter. Minima combine before each shuffle, so a node with very many edges
    is one row per task. Each round is a written table: nothing is collected, and a lost executor repeats one round.
    """
    links = written(edges.select("a", "b").where("a is not null and b is not null"), "links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # First parents: the smallest neighbour, if smaller.
    parent = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
    parent = _flattened(parent)
    while True:
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        links = written(links.join(of_a, "a").join(of_b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return parent.select("node", F.col("parent").alias("component"))
        # Roots hook on the smallest root that they meet; nodes follow their root.
        hooks = _flattened(links.groupBy("b").agg(F.min("a").alias("parent")).withColumnRenamed("b", "node"))
        onto = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("onto"))
        parent = written(parent.join(onto, "parent", "left").select("node", F.coalesce("onto", "parent").alias("parent")), "parents")


def _flattened(parent: DataFrame) -> DataFrame:
    """Jump from parent to parent until each node points at its root. Nodes that are no key are roots."""
    parent = written(parent, "parents")
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up")).where("parent <> up")
        jumped = parent.join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved"))
        jumped = written(jumped, "parents")
        parent = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parent
