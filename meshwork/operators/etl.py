"""Preparing triples: ids, filters, splits, and pairs that are or are not related."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.functions.scalars import hashed
from meshwork.plans.ranking import numbered


def first_occurrence(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """id, idx: values of the columns numbered from 0 by where they first stand (row order, then column)."""
    at = rows.select(F.explode(F.array(*(F.struct((F.col(order) * len(columns) + k).alias("p"), F.col(c).alias("id")) for k, c in enumerate(columns)))).alias("x"))
    first = at.groupBy(F.col("x.id").alias("id")).agg(F.min("x.p").alias("p"))
    return numbered(first, [F.col("p")]).select("id", "idx")


def encode(triples: DataFrame, ids: DataFrame, rels: DataFrame) -> DataFrame:
    """head, rel, tail as numbers; triples with an unknown part go."""
    t = triples
    for c, d in (("head", ids), ("tail", ids), ("rel", rels)):
        t = t.join(d.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_id")), c)
    return t.select("head_id", "rel_id", "tail_id")


def split(rows: DataFrame, key: list[str], test_share: float, seed: str = "split") -> DataFrame:
    """``rows`` with ``split``: the first floor(share * n) by hash are test.

    Ranks come from range-partitioned hashes: the cut is found from counts by hash prefix, and only
    the prefix that the cut falls into is ordered.
    """
    h = rows.withColumn("__h", hashed(F.lit(seed), *(F.col(k) for k in key))).withColumn("__b", F.substring("__h", 1, 4))
    n = h.groupBy("__b").agg(F.count("*").alias("n"))
    run = n.select("__b", "n", F.sum("n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)).alias("run"), F.sum("n").over(W.partitionBy()).alias("total"))
    lim = run.select("__b", F.floor(F.col("total") * test_share).alias("k"), (F.col("run") - F.col("n")).alias("before"), "run")
    j = h.join(F.broadcast(lim), "__b")
    inner = F.row_number().over(W.partitionBy("__b").orderBy("__h", *key)) + F.col("before")
    edge = j.where("before < k AND run > k").withColumn("split", F.when(inner <= F.col("k"), "test").otherwise("train"))
    rest = j.where("NOT (before < k AND run > k)").withColumn("split", F.when(F.col("run") <= F.col("k"), "test").otherwise("train"))
    return rest.union(edge).drop("__h", "__b", "k", "before", "run")


def covering_split(triples: DataFrame, test_share: float, seed: str = "split") -> DataFrame:
    """Triples with ``split``: each node's least incident triple by hash is in train, the rest is split by hash."""
    key = hashed(F.lit(seed), F.col("head"), F.col("rel"), F.col("tail"))
    t = triples.withColumn("h", key)
    ends = t.select(F.col("head").alias("id"), "h").union(t.select("tail", "h")).groupBy("id").agg(F.min("h").alias("h")).select("h").distinct().withColumn("forced", F.lit(True))
    m = t.join(ends, "h", "left")
    free = split(m.where("forced IS NULL").select("head", "rel", "tail"), ["head", "rel", "tail"], test_share, seed)
    return m.where("forced").select("head", "rel", "tail", F.lit("train").alias("split")).union(free.select("head", "rel", "tail", "split"))


def negatives(triples: DataFrame, corrupted: DataFrame) -> DataFrame:
    """Corrupted heads and tails that are no triple themselves: head, rel, tail."""
    bad = corrupted.select(F.col("bad_head").alias("head"), "rel", "tail").union(corrupted.select("head", "rel", F.col("bad_tail").alias("tail"))).distinct()
    return bad.join(triples, ["head", "rel", "tail"], "left_anti")


def without_test_links(edges: DataFrame, test: DataFrame, seed: str = "remove") -> DataFrame:
    """Edges (src, dst) less the test links (src, dst), but for those whose loss would leave an end bare.

    In hash order of the links a node's last remaining edge stays: a link is kept if it is the last of
    all edges of either end. Order inside each node decides, so no link waits for all others.
    """
    deg = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("deg"))
    t = test.withColumn("h", hashed(F.lit(seed), F.col("src"), F.col("dst")))
    ends = t.select("src", "dst", "h", F.explode(F.array("src", "dst")).alias("id"))
    turn = ends.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("h", "src", "dst"))).join(deg, "id")
    keep = turn.where("k >= deg").select("src", "dst").distinct()
    gone = test.join(keep, ["src", "dst"], "left_anti")
    return edges.join(gone, ["src", "dst"], "left_anti")


def evaluation_set(positive: DataFrame, negative: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, label: distinct pairs with both ends known, positives 1 and negatives 0, rows with nulls dropped."""
    both = positive.select("a", "b", F.lit(1).alias("label")).union(negative.select("a", "b", F.lit(0).alias("label"))).na.drop().distinct()
    return both.join(known, F.col("a") == F.col("id"), "left_semi").join(known, F.col("b") == F.col("id"), "left_semi")


def balanced_split(nodes: DataFrame, column: str, percent: float, seed: str = "balance") -> DataFrame:
    """id, split: floor(floor(percent * n / 100) / classes) of each class train, half of the rest valid, the others test."""
    h = nodes.select("id", F.col(column).alias("c"), hashed(F.lit(seed), F.col("id")).alias("h"))
    size = h.agg(F.floor(F.floor(F.count("*") * percent / 100) / F.countDistinct("c")).alias("k"))
    r = h.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("h", "id"))).join(F.broadcast(size)).withColumn("train", F.col("r") <= F.col("k"))
    rest = split(r.where("NOT train").select("id"), ["id"], 0.5, seed)
    return r.where("train").select("id", F.lit("train").alias("split")).union(rest.select("id", F.when(F.col("split") == "test", "valid").otherwise("test").alias("split")))


def batches(rows: DataFrame, key: list[str], size: int, seed: str = "batch") -> DataFrame:
    """``rows`` with ``batch``: consecutive runs of ``size`` rows in hash order."""
    h = rows.withColumn("__h", hashed(F.lit(seed), *(F.col(k) for k in key)))
    return numbered(h, [F.col("__h"), *(F.col(k) for k in key)], "__n").withColumn("batch", F.floor(F.col("__n") / size)).drop("__h", "__n")


def analogy_samples(pairs: DataFrame, seed: str = "analogy") -> DataFrame:
    """a, b, c, expected: positive pairs (a, b) two by two in hash order."""
    n = numbered(pairs.select("a", "b", hashed(F.lit(seed), F.col("a"), F.col("b")).alias("h")), [F.col("h"), F.col("a"), F.col("b")])
    second = n.where("idx % 2 = 1").select((F.col("idx") - 1).alias("idx"), F.col("a").alias("c"), F.col("b").alias("expected"))
    return n.where("idx % 2 = 0").join(second, "idx").select("a", "b", "c", "expected")


def orient(triples: DataFrame, swapped: list[str]) -> DataFrame:
    """head, tail of (head, rel, tail), turned round for the relations in ``swapped``, once each."""
    turn = F.col("rel").isin(*swapped)
    return triples.select(F.when(turn, F.col("tail")).otherwise(F.col("head")).alias("head"), F.when(turn, F.col("head")).otherwise(F.col("tail")).alias("tail")).distinct()


def unseen_pairs(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: every pair of the two sets (a), (b) that is not in ``known`` (a, b). The result is the product's own size."""
    return left.join(right).join(known, ["a", "b"], "left_anti")


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one stated set with every row of another. The result is the product's own size."""
    return left.join(right)


def supported(paths: DataFrame, key: list[str], length: int) -> DataFrame:
    """key, n of the paths that occur often enough for their length: length times its square root, at least."""
    return paths.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= length * F.sqrt(F.lit(float(length))))
