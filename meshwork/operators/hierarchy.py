"""Labels in a tree given as (parent, child) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.scratch import cut


def roots(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("parent").alias("label")).distinct().join(tree.select(F.col("child").alias("label")), "label", "left_anti")


def parents(tree: DataFrame) -> DataFrame:
    """label, parent (least of several) of every label; a root is its own."""
    known = tree.groupBy(F.col("child").alias("label")).agg(F.min("parent").alias("parent"))
    return known.union(roots(tree).select("label", F.col("label").alias("parent")))


def lineages(tree: DataFrame, max_depth: int = 64) -> DataFrame:
    """label, lineage (array from the root to the label), level by level from the roots."""
    level = cut(roots(tree).select("label", F.array("label").alias("lineage")), "lineage")
    out, up = level, parents(tree).where("label <> parent")
    for _ in range(max_depth):
        level = cut(up.join(level.select(F.col("label").alias("parent"), "lineage"), "parent").select("label", F.concat("lineage", F.array("label")).alias("lineage")), "lineage")
        if level.limit(1).count() == 0:
            return out
        out = out.union(level)
    raise ValueError(f"deeper than {max_depth} levels, or not a tree")


def ranks(tree: DataFrame) -> DataFrame:
    """Depth from 1 at the root."""
    return lineages(tree).select("label", F.size("lineage").alias("rank"))


def common_parents(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, common: the deepest label on both lineages, for the given pairs (a, b)."""
    line = lineages(tree)
    both = pairs.join(line.select(F.col("label").alias("a"), F.col("lineage").alias("x")), "a").join(line.select(F.col("label").alias("b"), F.col("lineage").alias("y")), "b")
    return both.select("a", "b", F.element_at(F.array_intersect("x", "y"), -1).alias("common"))
