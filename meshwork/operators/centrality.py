"""Centralities, PageRank, breadth-first search and betweenness as rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.scratch import cut


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id, all, out, in: distinct neighbours over n - 1."""
    e = edges.select("src", "dst").distinct()
    o = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    i = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    both = o.join(i, "id", "full").na.fill(0, ["o", "i"])
    n = both.agg((F.count("*") - 1).cast("double").alias("m"))
    return both.join(F.broadcast(n)).select("id", ((F.col("o") + F.col("i")) / F.col("m")).alias("all"), (F.col("o") / F.col("m")).alias("out"), (F.col("i") / F.col("m")).alias("in"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tol: float | None = 1e-6, checkpoint_every: int = 5) -> DataFrame:
    """id, rank. Dangling mass is spread evenly; stops when the change is below n * tol, or after ``rounds`` if tol is None.

    The edges with their share 1 / out-degree are written once. A round is one join and one sum of
    contributions, combined before the shuffle, so a hub costs a row a task.
    """
    e = edges.select("src", "dst").distinct()
    links = cut(e.join(e.groupBy("src").agg((1.0 / F.count("*")).alias("share")), "src"), "links")
    ids = cut(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct(), "ids")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    out = links.select(F.col("src").alias("id")).distinct().withColumn("has_out", F.lit(True))
    base = cut(ids.join(out, "id", "left").select("id", F.coalesce("has_out", F.lit(False)).alias("has_out")), "base")
    rank = base.select("id", "has_out", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(~F.col("has_out"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = links.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = base.join(got, "id", "left").join(F.broadcast(lost))
        new = new.select("id", "has_out", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("rank"))
        if tol is not None or (k + 1) % checkpoint_every == 0:
            new = cut(new, "rank")
        if tol is not None:
            change = new.join(rank.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < n * tol:
                return new.select("id", "rank")
        rank = new
    return rank.select("id", "rank")


def rank_neighbors(edges: DataFrame, ranks: DataFrame, source: str, edge_type: str) -> DataFrame:
    """Out-neighbours of ``source`` over one relation with their rank, highest first."""
    near = edges.where((F.col("src") == source) & (F.col("type") == edge_type)).select(F.col("dst").alias("id")).distinct()
    return near.join(ranks, "id").orderBy(F.desc("rank"), "id")


def bfs_levels(edges: DataFrame, roots: DataFrame, max_levels: int = 1000) -> DataFrame:
    """root, id, level of everything reachable along the edges' direction from each root (id)."""
    e = edges.select("src", "dst").distinct()
    seen = front = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level")), "front")
    for k in range(1, max_levels + 1):
        step = front.join(e, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["root", "id"], "left_anti").select("root", "id", F.lit(k).alias("level")), "front")
        if front.limit(1).count() == 0:
            break
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 1000) -> DataFrame:
    """One row (hops, path), direction ignored: of the shortest paths the one least by its nodes; none if there is none.

    Each node keeps only its least path, so a round holds one row per node reached.
    """
    e = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "links")
    spark = edges.sparkSession
    front = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen = front.select("id")
    for k in range(max_hops + 1):
        hit = front.where(F.col("id") == target).select(F.lit(k).alias("hops"), "path")
        if hit.limit(1).count():
            return hit
        nxt = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        front = cut(nxt, "front")
        if front.limit(1).count() == 0:
            break
        seen = seen.union(front.select("id"))
    return spark.createDataFrame([], "hops int, path array<string>")


def betweenness(edges: DataFrame, sources: DataFrame | None = None, directed: bool = True, normalised: bool = True) -> DataFrame:
    """id, score: Brandes' sums, level by level for all sources (id) together; all nodes are sources by default.

    Forward rounds keep (source, node, level, paths); backward rounds add each level's dependencies
    to the one above. Sampled sources give the usual estimate's numerator.
    """
    e = edges.select("src", "dst").where("src <> dst")
    e = cut((e if directed else e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct(), "links")
    ids = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), "ids")
    start = sources if sources is not None else ids
    levels = [cut(start.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("s", "id")
    while True:
        step = levels[-1].join(e, F.col("id") == F.col("src")).select("s", F.col("dst").alias("id"), "paths")
        nxt = cut(step.join(seen, ["s", "id"], "left_anti").groupBy("s", "id").agg(F.sum("paths").alias("paths")), "level")
        if nxt.limit(1).count() == 0:
            break
        levels.append(nxt)
        seen = seen.union(nxt.select("s", "id"))
    total, low = None, levels[-1].select("s", "id", "paths", F.lit(0.0).alias("delta"))
    for k in range(len(levels) - 1, 0, -1):
        part = low.select("id", "delta")
        total = part if total is None else total.union(part)
        up = levels[k - 1]
        links = up.select("s", F.col("id").alias("v"), F.col("paths").alias("pv")).join(e, F.col("v") == F.col("src"))
        links = links.join(low.select("s", F.col("id").alias("dst"), F.col("paths").alias("pw"), "delta"), ["s", "dst"])
        add = links.groupBy("s", F.col("v").alias("id")).agg(F.sum(F.col("pv") / F.col("pw") * (1 + F.col("delta"))).alias("delta"))
        low = cut(up.join(add, ["s", "id"], "left").select("s", "id", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
    sums = total.groupBy("id").agg(F.sum("delta").alias("x")) if total is not None else ids.select("id", F.lit(0.0).alias("x"))
    n = ids.count()
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalised else (1.0 if directed else 0.5)
    return ids.join(sums, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) * scale).alias("score"))
