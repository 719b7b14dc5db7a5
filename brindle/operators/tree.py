"""Hierarchies: parent pointers to paths, drill-down through chosen nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import cut


def rooted(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes without id 0; a parent that doesn't exist is the root (0)."""
    real = nodes.where(F.col(node) != 0)
    parents = real.select(F.col(node).alias("_p")).distinct()
    return real.join(parents, F.col(parent) == F.col("_p"), "left").withColumn(parent, F.coalesce("_p", F.lit(0))).drop("_p")


def _levels(first: DataFrame, below, what: str, max_depth: int) -> DataFrame:
    """All levels of a tree from the first one down. Each is computed once and kept, so a round joins one level only; more than ``max_depth`` levels are an error, not an end."""
    level, out = cut(first), None
    for _ in range(max_depth):
        out = level if out is None else out.unionByName(level)
        level = cut(below(level))
        if level.isEmpty():
            return out
    raise ValueError(f"{what} is deeper than {max_depth} levels, or runs in a circle")


def paths(nodes: DataFrame, node: str, parent: str, order: str, name: str, through: Column | None = None, max_depth: int = 1000) -> DataFrame:
    """``node, depth, path`` (orders from the root) and ``names`` of every node that the root reaches, in rounds over the levels.

    ``through`` says which nodes are descended into; the others are leaves.
    """
    every = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(order).alias("ord"), F.col(name).cast("string").alias("name"), (through if through is not None else F.lit(True)).alias("open"))
    first = every.where("parent = 0").select("node", F.lit(1).alias("depth"), F.array("ord").alias("path"), "name", F.col("name").alias("names"), "open")

    def below(level: DataFrame) -> DataFrame:
        above = level.where("open").select(F.col("node").alias("parent"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("names").alias("_names"))
        return every.join(above, "parent").select("node", (F.col("_depth") + 1).alias("depth"), F.concat("_path", F.array("ord")).alias("path"), "name", F.concat_ws("/", "_names", "name").alias("names"), "open")

    return _levels(first, below, "the hierarchy", max_depth)


def trail(nodes: DataFrame, node: str, parent: str, max_depth: int = 1000) -> DataFrame:
    """``node, trail``: ids from the top (parent 0) down to each node that the root reaches."""
    links = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))

    def below(level: DataFrame) -> DataFrame:
        return links.join(level.select(F.col("node").alias("parent"), F.col("trail").alias("above")), "parent").select("node", F.concat("above", F.array("node")).alias("trail"))

    return _levels(links.where("parent = 0").select("node", F.array("node").alias("trail")), below, "the hierarchy", max_depth)
