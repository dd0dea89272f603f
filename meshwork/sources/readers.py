"""Files that graphs, walks and corpora come in. Lines keep their number where their order means something."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators import hierarchy


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in file order), line. One file is one unsplit read: its rows are numbered as they come."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "line"))


def columns(spark: SparkSession, path: str, names: list[str], sep: str = "\t", header: bool = False) -> DataFrame:
    """Text columns by name; rows with another number of fields go."""
    rows = lines(spark, path) if not header else lines(spark, path).where("line_no > 0")
    parts = rows.select("line_no", F.split("line", sep, -1).alias("f")).where(F.size("f") == len(names))
    return parts.select("line_no", *(F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)))


def bad_rows(spark: SparkSession, path: str, fields: int, sep: str = "\t") -> int:
    return lines(spark, path).where(F.size(F.split("line", sep, -1)) != fields).count()


def karate_matrix(spark: SparkSession, path: str, n: int = 34) -> DataFrame:
    """src, type, dst, weight from n rows of adjacency followed by n rows of layers."""
    cells = lines(spark, path).where("trim(line) <> ''").select("line_no", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "v"))
    a = cells.where((F.col("line_no") < n) & (F.col("v") != "0")).select(F.col("line_no").alias("i"), "j")
    layer = cells.where(F.col("line_no") >= n).select((F.col("line_no") - n).alias("i"), "j", F.col("v").alias("type"))
    return a.join(layer, ["i", "j"]).select(F.col("i").cast("string").alias("src"), "type", F.col("j").cast("string").alias("dst"), F.lit(1.0).alias("weight")).distinct()


def node_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label, cluster: the label's place among the sorted labels."""
    from meshwork.graph import dense_index

    rows = columns(spark, path, ["id", "label"])
    return rows.join(dense_index(rows, "label", "cluster"), "label").select("id", "label", F.col("cluster").cast("int").alias("cluster"))


def citations(spark: SparkSession, nodes: str, edges: str, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label: the lineage joined by colons) and edges in both directions from two CSV files with headers."""
    n = spark.read.csv(nodes, header=True)
    line = hierarchy.lineages(tree).select(F.col("label").alias("subject"), F.array_join("lineage", ":").alias("path"))
    node = n.join(line, "subject", "left").select(F.col("nodeId").alias("id"), F.col("labels").alias("type"), F.coalesce("path", "subject").alias("label"), F.from_json("features", "array<double>").alias("features"))
    e = spark.read.csv(edges, header=True).select(F.col("sourceNodeId").alias("src"), F.col("targetNodeId").alias("dst"), F.col("relationshipType").alias("type"), F.lit(1.0).alias("weight"))
    return node, e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a two-column file; the last of several lines for a key counts."""
    return columns(spark, path, ["key", "value"]).groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def line_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id, idx: each line by its number."""
    return lines(spark, path).select(F.col("line").alias("id"), F.col("line_no").cast("bigint").alias("idx"))


def rdf_graph(spark: SparkSession, triples: str, node_classes: DataFrame, edge_classes: DataFrame) -> DataFrame:
    """src, dst, type, name, src_class, dst_class, edge_class: of several lines for a pair the last counts; names are the last part of a URI."""
    t = columns(spark, triples, ["src", "rel", "dst"]).groupBy("src", "dst").agg(F.max_by("rel", "line_no").alias("type"))
    n = node_classes.select("key", "value")
    t = t.join(n.select(F.col("key").alias("src"), F.col("value").alias("src_class")), "src", "left").join(n.select(F.col("key").alias("dst"), F.col("value").alias("dst_class")), "dst", "left")
    t = t.join(edge_classes.select(F.col("key").alias("type"), F.col("value").alias("edge_class")), "type", "left")
    return t.select("src", "dst", "type", F.substring_index("type", "/", -1).alias("name"), "src_class", "dst_class", "edge_class")


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """src, type, dst of RDF lines; a literal object keeps its text."""
    p = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*)\s*\.'
    g = lambda k: F.regexp_extract("value", p, k)
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    return rows.select(g(1).alias("src"), g(2).alias("type"), F.when(g(3) != "", g(3)).otherwise(g(4)).alias("dst"))


def edge_triples(spark: SparkSession, path: str) -> DataFrame:
    """src, edge (``EDGE_`` before the relation), dst of lines ``head, tail, relation``."""
    return columns(spark, path, ["src", "dst", "rel"]).select("src", F.concat(F.lit("EDGE_"), "rel").alias("edge"), "dst")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as numbers: the first two fields of each line."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 2).select(F.get(f, F.lit(0)).cast("bigint").alias("src"), F.get(f, F.lit(1)).cast("bigint").alias("dst"))


def walks(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    return lines(spark, path).where("trim(line) <> ''").select(F.col("line_no").cast("bigint").alias("walk_id"), F.split(F.trim("line"), sep).alias("tokens"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc, tokens: one document a line, ASCII and lower case."""
    from meshwork.functions.scalars import ascii_clean, tokens

    return lines(spark, path).select(F.col("line_no").alias("doc"), tokens(ascii_clean(F.col("line"))).alias("tokens"))


def metapaths(spark: SparkSession, path: str) -> DataFrame:
    """id, types of a CSV of metapaths, where 0 is an empty place."""
    f = F.split("line", ",", -1)
    clean = F.transform(f, lambda x: F.trim(x))
    return lines(spark, path).where("line_no > 0 AND trim(line) <> ''").select(F.get(clean, F.lit(0)).alias("id"), F.filter(F.slice(clean, 2, 32), lambda x: (x != "0") & (x != "")).alias("types"))


def analogies(spark: SparkSession, path: str) -> DataFrame:
    """section, a, b, c, expected; lines that begin with a colon name the section that follows."""
    from pyspark.sql import Window as W

    rows = lines(spark, path).withColumn("section", F.last(F.when(F.col("line").startswith(":"), F.trim(F.substring("line", 2, 1000))), ignorenulls=True).over(W.orderBy("line_no")))
    f = F.split(F.trim("line"), r"\s+")
    return rows.where(~F.col("line").startswith(":")).where(F.size(f) == 4).select("section", *(F.get(f, F.lit(k)).alias(n) for k, n in enumerate(("a", "b", "c", "expected"))))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two files side by side, by line number."""
    return left.join(right, "line_no")


def graph_set(spark: SparkSession, folder: str) -> DataFrame:
    """graph, src, dst, type of a set of files whose lines belong together: graph_idx (graph of each node, by line), edges (``h,t``), link_labels."""
    graph = lines(spark, f"{folder}/graph_idx").select((F.col("line_no") + 1).cast("string").alias("src"), F.trim("line").alias("graph"))
    e = lines(spark, f"{folder}/edges").select("line_no", F.split("line", r"\s*,\s*").alias("f"))
    lab = lines(spark, f"{folder}/link_labels").select("line_no", F.trim("line").alias("type"))
    both = aligned(e, lab).select(F.trim(F.get("f", F.lit(0))).alias("src"), F.trim(F.get("f", F.lit(1))).alias("dst"), "type")
    return both.join(graph, "src").select("graph", "src", "dst", "type")


def side_effects(spark: SparkSession, path: str) -> DataFrame:
    """id, name of a table without header: preferred terms of the usual frequencies, once each."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(*(F.get(f, F.lit(k)).alias(n) for k, n in ((2, "id"), (4, "frequency"), (7, "kind"), (9, "name"))))
    return rows.where(F.col("frequency").isin("common", "very common", "frequent", "postmarketing") & (F.col("kind") == "PT")).dropDuplicates(["id", "name"]).select("id", "name")


def settings(path: str) -> dict[str, str]:
    """``key value`` lines of a small settings file."""
    pairs = (line.split(None, 1) for line in Path(path).read_text().splitlines() if line.strip())
    return {p[0]: p[1].strip() if len(p) > 1 else "" for p in pairs}


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: str = "gnm") -> DataFrame:
    """src, dst, type, weight: that many distinct hashed pairs among the nodes (fewer if there are not so many)."""
    from meshwork.functions.scalars import uniform

    draws = spark.range(edges * 3).select((F.floor(uniform(F.lit(seed), F.lit("a"), F.col("id")) * nodes)).alias("u"), F.floor(uniform(F.lit(seed), F.lit("b"), F.col("id")) * nodes).alias("v"), "id").where("u <> v")
    pairs = draws.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("id").alias("id"))
    return pairs.orderBy("id").limit(edges).select(F.col("u").cast("string").alias("src"), F.col("v").cast("string").alias("dst"), F.lit("random").alias("type"), F.lit(1.0).alias("weight"))
