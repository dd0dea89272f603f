"""Eigenvectors of a graph's Laplacian by products of the sparse matrix with a block of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.graph import PropertyGraph, dense_index
from meshwork.operators.components import star_components
from meshwork.plans.scratch import cut

#: Up to this many nodes the matrix is solved whole on the driver (at most 32 MB); above it stays distributed.
DENSE = 2000
#: Vectors beside the wanted ones in a block.
GUARD = 4


def smallest(graph: PropertyGraph, k: int, rounds: int = 40, degree: int = 12, tol: float = 1e-6, seed: int = 7) -> DataFrame:
    """id, vector: entries of the k eigenvectors of the weighted Laplacian with the least eigenvalues, each with its first nonzero entry positive.

    Above ``DENSE`` nodes: a block of vectors is filtered by Chebyshev polynomials of the matrix, which damp all
    eigenvalues above the block's greatest; a step is one join and one sum, and only matrices of the block's width
    come to the driver. It ends when every residual |L v - e v| is at most ``tol`` times the bound on the
    eigenvalues, and raises if ``rounds`` rounds do not reach that: both ways give the same vectors to that accuracy,
    up to the basis of equal eigenvalues.
    """
    spark = graph.nodes.sparkSession
    lap = graph.laplacian("weighted")
    ids = cut(dense_index(graph.nodes), "ids")
    n = ids.count()
    if n <= DENSE:
        at = {r.id: r.idx for r in ids.collect()}
        m = np.zeros((n, n))
        for r in lap.collect():
            m[at[r.src], at[r.dst]] = r.value
        _, v = np.linalg.eigh((m + m.T) / 2)
        v = v[:, :k]
        for c in range(v.shape[1]):
            first = np.flatnonzero(np.abs(v[:, c]) > 1e-9)
            v[:, c] *= np.sign(v[first[0], c]) if len(first) else 1
        return spark.createDataFrame([(i, v[x].tolist()) for i, x in at.items()], "id string, vector array<double>")
    upper = 2 * (graph.degrees().agg(F.max("weighted")).first()[0] or 1.0)
    width = min(n, k + GUARD)
    m = cut(lap, "m")
    x = cut(ids.select("id", F.posexplode(F.array(*(F.sin((F.col("idx") + 1) * F.lit(float(seed + c))) for c in range(width)))).alias("c", "x")), "x")

    def scaled(x: DataFrame, by: float) -> DataFrame:
        return x.select("id", "c", (F.col("x") * by).alias("x"))

    def total(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return cut(out.groupBy("id", "c").agg(F.sum("x").alias("x")), "x")

    def applied(x: DataFrame, by: float = 1.0) -> DataFrame:
        return m.join(x.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "c", (F.col("value") * F.col("x") * by).alias("x"))

    def products(x: DataFrame, y: DataFrame) -> np.ndarray:
        out = np.zeros((width, width))
        for r in x.join(y.select("id", F.col("c").alias("d"), F.col("x").alias("z")), "id").groupBy("c", "d").agg(F.sum(F.col("x") * F.col("z")).alias("g")).collect():
            out[r.c, r.d] = r.g
        return (out + out.T) / 2

    def turned(y: DataFrame, w: np.ndarray) -> DataFrame:
        rows = spark.createDataFrame([(t, c, float(w[t, c])) for t in range(width) for c in range(width)], "c int, to int, w double")
        return y.join(F.broadcast(rows), "c").select("id", F.col("to").alias("c"), (F.col("x") * F.col("w")).alias("x"))

    for r in range(rounds):
        y = total(applied(x))
        size, basis = np.linalg.eigh(products(x, x))
        w = basis / np.sqrt(np.maximum(size, size.max() * 1e-14))
        values, v = np.linalg.eigh(w.T @ products(x, y) @ w)
        turn = w @ v
        x, y = total(turned(x, turn)), total(turned(y, turn))
        left = total(y, scaled(x, 1.0).join(F.broadcast(spark.createDataFrame([(c, float(-e)) for c, e in enumerate(values)], "c int, e double")), "c").select("id", "c", (F.col("x") * F.col("e")).alias("x")))
        worst = max((row.s for row in left.where(F.col("c") < k).groupBy("c").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s")).collect()), default=0.0)
        if worst <= tol * upper:
            break
        # values from the block's greatest to the bound are damped, those below grow
        low = max(values[-1], values[0] + 1e-9 * upper)
        low = low if low < upper * (1 - 1e-9) else upper / 2
        half, middle = (upper - low) / 2, (upper + low) / 2
        first = rate = half / -middle
        before, now = x, total(applied(x, rate / half), scaled(x, -middle * rate / half))
        for _ in range(degree - 1):
            after = 1 / (2 / first - rate)
            before, now = now, total(applied(now, 2 * after / half), scaled(now, -middle * 2 * after / half), scaled(before, -rate * after))
            rate = after
        x = now
    else:
        raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds: residual {worst / upper:.1e} of the bound")
    x = x.where(F.col("c") < k)
    lead = {r.c: np.sign(r.x) or 1.0 for r in x.where(F.abs("x") > 1e-9).groupBy("c").agg(F.min_by("x", "id").alias("x")).collect()}
    out = x.withColumn("x", F.col("x") * F.element_at(F.create_map(*(F.lit(z) for c in range(k) for z in (c, float(lead.get(c, 1.0))))), F.col("c")))
    return out.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("vector"))


def fiedler(graph: PropertyGraph) -> DataFrame:
    """id, value, side: the second eigenvector's entry, and its sign once rounded to 10 places."""
    v = smallest(graph, 2).select("id", F.round(F.element_at("vector", 2), 10).alias("value"))
    return v.select("id", "value", F.signum("value").cast("int").alias("side"))


def fiedler_groups(graph: PropertyGraph, places: int = 10) -> DataFrame:
    """value, members: nodes by the entry rounded to ``places``."""
    return fiedler(graph).groupBy(F.round("value", places).alias("value")).agg(F.sort_array(F.collect_list("id")).alias("members"))


def spectral_clusters(graph: PropertyGraph, k: int, threshold: float = 0.8) -> DataFrame:
    """id, component: single linkage under the graph's edges, which is the components of the edges whose ends' vectors are nearer than ``threshold``."""
    v = smallest(graph, k)
    e = graph.edges.join(v.select(F.col("id").alias("src"), F.col("vector").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("vector").alias("b")), "dst")
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    joined = star_components(e.where(gap < threshold))
    return graph.nodes.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
