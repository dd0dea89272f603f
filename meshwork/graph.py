"""A property graph as a pair of DataFrames; every property of it is a plan over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.ranking import numbered


def dense_index(df: DataFrame, key: str = "id", index: str = "idx") -> DataFrame:
    """0-based rank of each distinct ``key`` in code-point order."""
    return numbered(df.select(key).distinct(), [F.col(key)], index)


@dataclass
class PropertyGraph:
    """nodes (id, type, label, ...) and directed edges (src, dst, type, weight)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_frames(cls, edges: DataFrame, nodes: DataFrame | None = None, drop_dangling: bool = True, link_single_nodes: bool = False) -> PropertyGraph:
        """Edges with unknown ends go, if asked; nodes without edges get a loop of type ``self``, if asked.

        Without nodes, every end of an edge is one, without type or label.
        """
        if nodes is None:
            ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
            nodes = ends.select("id", F.lit(None).cast("string").alias("type"), F.col("id").alias("label"))
        g = cls(nodes, edges)
        if drop_dangling:
            g = cls(nodes, g.known_edges())
        return cls(nodes, g.edges.unionByName(g.self_loops())) if link_single_nodes else g

    def known_edges(self) -> DataFrame:
        ids = self.nodes.select("id")
        return self.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")

    def ends(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id"))).distinct()

    def single_nodes(self) -> DataFrame:
        return self.nodes.join(self.ends(), "id", "left_anti")

    def self_loops(self) -> DataFrame:
        return self.single_nodes().select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("self").alias("type"), F.lit(1.0).alias("weight"))

    def filter_edges(self, threshold: float) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.where(F.col("weight") > threshold))

    def recast(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.nodes, edges)

    def subgraph(self, ids: DataFrame) -> PropertyGraph:
        """Induced on ``ids`` (id): edges between them, each once with the lesser end first."""
        e = self.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
        return PropertyGraph(self.nodes.join(ids, "id", "left_semi"), e.where("src < dst"))

    def info(self) -> DataFrame:
        """One row: nodes, edges, nodes with an edge, nodes without."""
        ends = self.ends()
        return (
            self.nodes.agg(F.count("*").alias("n_nodes"))
            .join(self.edges.agg(F.count("*").alias("n_edges")))
            .join(ends.agg(F.count("*").alias("n_linked")))
            .join(self.single_nodes().agg(F.count("*").alias("n_single")))
        )

    def adjacency(self) -> DataFrame:
        """src, dst, n (parallel edges), weight (their sum): the sparse matrix of the graph."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))

    def neighbors(self, node: str, rel: str | None = None) -> DataFrame:
        """Distinct in-neighbours other than the node."""
        e = self.edges.where((F.col("dst") == node) & (F.col("src") != node))
        return (e.where(F.col("type") == rel) if rel else e).select(F.col("src").alias("id")).distinct()

    def edge_weight(self, src: str, dst: str) -> DataFrame:
        """One row: the weight of all edges from one node to another, 0 if there is none."""
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))

    def edge_types(self, src: str, dst: str) -> DataFrame:
        """Distinct types of the edges from one node to another."""
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).select("type").distinct()

    def with_label(self, ids: DataFrame, label: str) -> PropertyGraph:
        """The graph with one label given to the nodes ``ids`` (id)."""
        hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
        n = self.nodes.join(hit, "id", "left").withColumn("label", F.when(F.col("__hit"), F.lit(label)).otherwise(F.col("label"))).drop("__hit")
        return PropertyGraph(n.select(*self.nodes.columns), self.edges)

    def degrees(self) -> DataFrame:
        """id, degree (distinct in-neighbours, loops included), weighted (in-weights) for every node."""
        got = self.edges.groupBy("dst", "src").agg(F.sum("weight").alias("w")).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted"))
        return self.nodes.select("id").join(got.hint("merge"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"))

    def relation_degrees(self) -> DataFrame:
        return self.edges.select("type", "dst", "src").distinct().groupBy("type", F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def relation_sizes(self) -> DataFrame:
        """type, n_edges, n_pairs, n_nodes of every relation."""
        e = self.edges.groupBy("type").agg(F.count("*").alias("n_edges"))
        p = self.edges.select("type", "src", "dst").distinct().groupBy("type").agg(F.count("*").alias("n_pairs"))
        v = self.edges.select("type", F.col("src").alias("id")).union(self.edges.select("type", "dst")).distinct().groupBy("type").agg(F.count("*").alias("n_nodes"))
        return e.join(p, "type").join(v, "type")

    def meta_schema(self) -> DataFrame:
        """Distinct (source type, relation, target type)."""
        t = self.nodes.select("id", "type")
        e = self.edges.select("src", "dst", F.col("type").alias("rel"))
        e = e.join(t.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src")
        return e.join(t.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst").select("src_type", "rel", "dst_type").distinct()

    def profile(self, column: str) -> DataFrame:
        """Members (sorted) and their number by type or label."""
        return self.nodes.groupBy(column).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("members"))

    def laplacian(self, kind: str = "plain") -> DataFrame:
        """src, dst, value of D - A (plain), D - W (mixed) or D_w - W (weighted), zeros left out."""
        adj, deg = self.adjacency(), self.degrees()
        off = F.when(F.lit(kind == "plain"), F.col("n").cast("double")).otherwise(F.col("weight"))
        diag = deg.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("weighted" if kind == "weighted" else "degree").cast("double").alias("value"))
        return diag.union(adj.select("src", "dst", (-off).alias("value"))).groupBy("src", "dst").agg(F.sum("value").alias("value")).where("value <> 0")

    def propagation(self, diagonal: float = 0.0, cluster: bool = False) -> DataFrame:
        """src, dst, value of D^-1 (A + I), rows of degree 0 left out; ``cluster``: (D + I)^-1 (A + I) plus ``diagonal`` times its diagonal."""
        adj = self.adjacency().select("src", "dst", F.col("n").cast("double").alias("value"))
        plus = adj.union(self.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("value"))).groupBy("src", "dst").agg(F.sum("value").alias("value"))
        deg = self.degrees().select(F.col("id").alias("src"), (F.col("degree") + (1 if cluster else 0)).alias("d"))
        p = plus.join(deg.where("d > 0").hint("merge"), "src").select("src", "dst", (F.col("value") / F.col("d")).alias("value"))
        return p.withColumn("value", F.when(F.col("src") == F.col("dst"), F.col("value") * (1 + diagonal)).otherwise(F.col("value"))) if cluster else p

    def relation_propagation(self, by: str = "relation") -> DataFrame:
        """type, src, dst, value of D_r^-1 A_r per relation, or D^-1 A_r by the whole graph's degree (``by='graph'``)."""
        a = self.edges.groupBy("type", "src", "dst").agg(F.count("*").cast("double").alias("n"))
        if by == "graph":
            d = self.degrees().select(F.col("id").alias("src"), "degree").where("degree > 0")
            return a.join(d, "src").select("type", "src", "dst", (F.col("n") / F.col("degree")).alias("value"))
        d = self.relation_degrees().select("type", F.col("id").alias("src"), "degree")
        return a.join(d, ["type", "src"]).select("type", "src", "dst", (F.col("n") / F.col("degree")).alias("value"))

    def quotient(self) -> DataFrame:
        """Edges (src, dst, type, weight 1) between different labels that have an edge between their nodes."""
        lab = self.nodes.select("id", "label")
        e = self.edges.join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        return e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "type").distinct().withColumn("weight", F.lit(1.0))

    def line_graph(self) -> DataFrame:
        """Pairs (a, b, shared) of undirected edges that share an end; an edge is ``lesser~greater``.

        Each end's edges meet by that end alone; a hub of degree d makes d * (d - 1) rows, which is the
        result's own size.
        """
        e = self.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().withColumn("e", F.concat_ws("~", "u", "v"))
        at = e.select("e", F.col("u").alias("end")).union(e.select("e", F.col("v").alias("end")))
        return at.select(F.col("e").alias("a"), F.col("end").alias("shared")).join(at.select(F.col("e").alias("b"), F.col("end").alias("shared")), "shared").where("a <> b").select("a", "b", "shared")

    def is_complete(self) -> DataFrame:
        """One row: whether every pair has one edge of weight 1 (each pair counted once)."""
        e = self.edges.where("src < dst").agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
        n = self.nodes.agg(F.count("*").alias("n_nodes"))
        half = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
        return n.join(e).select("n_nodes", "n_edges", ((F.col("n_edges") == half) & (F.col("w") == F.col("n_edges"))).alias("complete"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of sparse matrices (src, dst, value): one join on the inner index and one sum, combined before its shuffle."""
    right = b.select(F.col("src").alias("inner"), F.col("dst").alias("__dst"), F.col("value").alias("__v"))
    return a.withColumnRenamed("dst", "inner").join(right, "inner").groupBy("src", F.col("__dst").alias("dst")).agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def commuting_matrix(steps: list[DataFrame]) -> DataFrame:
    """Product of the steps' edge counts along a metapath."""
    out = steps[0]
    for m in steps[1:]:
        out = matrix_product(out, m)
    return out


def schema_matrix(metapaths: list[list[DataFrame]], laplacian: bool = False) -> DataFrame:
    """src, dst, value: the sum of the metapaths' commuting matrices, or row sums less that matrix (zeros left out)."""
    parts = [commuting_matrix(m).select("src", "dst", F.col("value").cast("double").alias("value")) for m in metapaths]
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    a = every.groupBy("src", "dst").agg(F.sum("value").alias("value"))
    if not laplacian:
        return a
    d = a.groupBy("src").agg(F.sum("value").alias("value")).select("src", F.col("src").alias("dst"), "value")
    return d.union(a.select("src", "dst", -F.col("value"))).groupBy("src", "dst").agg(F.sum("value").alias("value")).where("value <> 0")


def hashed_metapaths(schema: list[tuple[str, str, str]], length: int, number: int, seed: str = "metapath") -> list[list[tuple[str, str, str]]]:
    """``number`` walks of up to ``length`` steps over a schema (source type, relation, target type), chosen by MD5; a schema is small."""
    from hashlib import md5

    pick = lambda some, *key: min(some, key=lambda x: (md5("|".join(map(str, (seed, *key, *x))).encode()).hexdigest(), x))
    out = []
    for k in range(number if schema else 0):
        path = [pick(schema, k, 0)]
        while len(path) < length and (after := [x for x in schema if x[0] == path[-1][2]]):
            path.append(pick(after, k, len(path)))
        out.append(path)
    return out
