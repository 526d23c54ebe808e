"""Cycles of a directed graph, by name: its strongly connected components, found by forward and backward reach.

Nodes that nothing leads to or that lead nowhere are trimmed, round by round. Every node then takes the smallest node it can be
reached from as its colour; those that are their own colour are roots, and what reaches a root along nodes of its colour is one
component with it. All roots are worked on at once, what belongs to none goes into the next turn. Rounds follow the longest path
that is left after trimming; each is a join and an aggregate on edges, cut off by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose beginning is reached and whose end leads on, until none goes."""
    left = edges.count()
    while left:
        heads, tails = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = edges.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b").checkpoint()
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that each can be reached from, itself included."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    colours = nodes.withColumn("colour", F.col("node")).checkpoint()
    while True:
        passed = edges.join(colours, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("_in"))
        moved = colours.join(passed, "node", "left").withColumn("_new", F.least("colour", F.coalesce("_in", "colour")))
        moved = moved.select("node", F.col("_new").alias("colour"), (F.col("_new") != F.col("colour")).alias("_moved")).checkpoint()
        colours = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return colours


def _members(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, colour) of the nodes that reach the root of their colour inside it."""
    a, b = (colours.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}")) for c in ("a", "b"))
    inner = edges.join(a, "a").join(b, "b").where("_a = _b").select("a", "b", F.col("_a").alias("colour")).checkpoint()
    found = colours.where("node = colour").checkpoint()
    fresh = found
    while True:
        back = inner.join(fresh.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour").distinct()
        fresh = back.join(found, ["node", "colour"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh).checkpoint()


def cycles(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, cycle, size): every node that lies on a cycle, the smallest node of its component, and how many nodes that has.

    Edges with a null end lead nowhere; repeated edges count once; an edge of a node to itself is a cycle of one. Without cycles the result is empty.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    left = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct().checkpoint()
    out = left.select(F.col("a").alias("node"), F.col("a").alias("cycle")).limit(0)
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        members = _members(left, _coloured(left))
        # a root alone is a cycle only if it leads to itself
        sizes = members.groupBy("colour").agg(F.count(F.lit(1)).alias("_n"))
        loops = left.where("a = b").select(F.col("a").alias("colour"), F.lit(True).alias("_loop"))
        real = members.join(sizes, "colour").join(loops, "colour", "left").where("_n > 1 OR _loop")
        out = out.unionByName(real.select("node", F.col("colour").alias("cycle")))
        gone = members.select(F.col("node").alias("a"))
        left = left.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b").checkpoint()
    out = out.checkpoint()
    return out.join(out.groupBy("cycle").agg(F.count(F.lit(1)).alias("size")), "cycle").select("node", "cycle", "size")
