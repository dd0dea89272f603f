"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.scratch import cut


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each neighbour larger than u to the least vertex of u's closed neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # a table of its own, so that adaptive execution can split the join at a hub
    least = cut(least.select("u", F.least("u", "m").alias("m")), "least", 2 * n)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link u and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least", 2 * n)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Component of every vertex that has an edge: rows (id, component), component = least id in it.

    Each round is two aggregations and two joins over the edges, whose number never grows; stars
    double in reach, so rounds grow with the logarithm of the diameter. A round's edges are written
    to the shared folder, so lineage stays flat. Null ends and loops are dropped: a vertex without a
    real edge is not in the result, and the caller gives it its own id.
    """
    work = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    work, seen = cut(work, "edges"), None
    n = work.count()
    for _ in range(max_rounds):
        work = cut(_small_star(_large_star(work, n), n), "edges", 2 * n)
        mark = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.select(F.col("v").alias("id")).distinct()
    return work.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component"))).distinct()
