"""The star-schema tables as a knowledge graph: nodes, edges and smaller graphs cut from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, label of regions, nations, customers, suppliers and parts."""
    spec = [
        ("region", "R", "r_regionkey", "r_regionkey"),
        ("nation", "N", "n_nationkey", "n_regionkey"),
        ("customer", "C", "c_custkey", "c_mktsegment"),
        ("supplier", "S", "s_suppkey", "s_nationkey"),
        ("part", "P", "p_partkey", "p_brand"),
    ]
    parts = [read(spark, sf_dir, t).select(_id(c, k).alias("id"), F.lit(t).alias("type"), F.col(lab).cast("string").alias("label")) for t, c, k, lab in spec]
    return reduce(DataFrame.union, parts)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, weight: who lies in which nation, and nations in regions."""
    spec = [
        ("customer", "C", "c_custkey", "N", "c_nationkey", "in_nation"),
        ("supplier", "S", "s_suppkey", "N", "s_nationkey", "in_nation"),
        ("nation", "N", "n_nationkey", "R", "n_regionkey", "in_region"),
    ]
    parts = [read(spark, sf_dir, t).select(_id(a, k).alias("src"), _id(b, m).alias("dst"), F.lit(e).alias("type"), F.lit(1.0).alias("weight")) for t, a, k, b, m, e in spec]
    return reduce(DataFrame.union, parts)


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(_id("S", "l_suppkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.lit("supplies").alias("type"), "weight")


def buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = rows.groupBy("o_custkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(_id("C", "o_custkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.lit("buys").alias("type"), "weight")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography(spark, sf_dir).union(supplies(spark, sf_dir)).union(buys(spark, sf_dir))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))


def label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: the world, its regions and their nations."""
    top = read(spark, sf_dir, "region").select(F.lit("world").alias("parent"), F.col("r_name").alias("child"))
    low = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return top.union(low)


def user_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """walk_id, tokens: each user's event types in order of time."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return e.select(F.col("user_id").alias("walk_id"), F.transform("s", lambda x: x["event_type"]).alias("tokens"))


#: The same tables for DuckDB, as common table expressions.
SQL = """
kg_nodes AS (
  SELECT 'R' || r_regionkey AS id, 'region' AS type, r_regionkey::VARCHAR AS label FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'nation', n_regionkey::VARCHAR FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'customer', c_mktsegment FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'supplier', s_nationkey::VARCHAR FROM supplier
  UNION ALL SELECT 'P' || p_partkey, 'part', p_brand FROM part),
geo AS (
  SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'in_nation' AS type, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'in_nation', 1.0 FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'in_region', 1.0 FROM nation),
supplies AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'supplies' AS type, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2),
buys AS (SELECT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, 'buys' AS type, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
kg_edges AS (SELECT * FROM geo UNION ALL SELECT * FROM supplies UNION ALL SELECT * FROM buys),
label_tree AS (SELECT 'world' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
user_walks AS (SELECT user_id AS walk_id, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY user_id),
sym AS (SELECT src, dst, type, weight FROM geo UNION ALL SELECT dst, src, type, weight FROM geo)
"""
