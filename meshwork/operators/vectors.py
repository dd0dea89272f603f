"""Vectors by id: neighbours, means, and layers of neural models as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.functions.scalars import dot, hashed
from meshwork.operators import tiles
from meshwork.plans.ranking import numbered
from meshwork.plans.scratch import cut


def nearest(queries: DataFrame, vectors: DataFrame, k: int, typed: bool = False) -> DataFrame:
    """query, id, score, rank: the k other vectors of greatest cosine (equal scores by id).

    ``queries`` is (query, vector[, type]), ``vectors`` (id, vector[, type]); they meet in tiles of
    bounded size. ``typed``: only vectors of another type.
    """
    return tiles.nearest(queries.withColumn("skip", F.array("query")), vectors, k, typed)


def mean_by(vectors: DataFrame, key: str, how: str = "avg") -> DataFrame:
    """key, vector: element-wise mean (or sum) of the vectors of each key."""
    e = vectors.select(key, F.posexplode("vector").alias("pos", "x"))
    s = e.groupBy(key, "pos").agg((F.avg("x") if how == "avg" else F.sum("x")).alias("x"))
    return s.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("vector"))


def propagate(matrix: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, vector of the sparse matrix (src, dst, value) times the vectors: one join and one sum per element.

    Vectors of like elements are small as files and large as rows: they are never broadcast, and taken apart after the join.
    """
    e = matrix.join(vectors.select(F.col("id").alias("dst"), "vector").hint("merge"), "dst").select("src", "value", F.posexplode("vector").alias("pos", "x"))
    s = e.groupBy("src", "pos").agg(F.sum(F.col("value") * F.col("x")).alias("x"))
    return s.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("vector"))


def dense(vectors: DataFrame, weights: list[list[float]], bias: list[float] | None = None, activation: str | None = None) -> DataFrame:
    """id, vector: v W + b, with tanh or relu; the weights are literals of the plan."""
    rows = F.array(*(F.array(*map(F.lit, col)) for col in zip(*weights, strict=True)))
    out = F.transform(rows, lambda c: F.aggregate(F.zip_with(F.col("vector"), c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    if bias is not None:
        out = F.zip_with(out, F.array(*map(F.lit, bias)), lambda x, y: x + y)
    act = {"tanh": F.tanh, "relu": lambda x: F.greatest(x, F.lit(0.0)), None: lambda x: x}[activation]
    return vectors.select("id", F.transform(out, act).alias("vector"))


def batch_norm(vectors: DataFrame, eps: float = 1e-5) -> DataFrame:
    """id, vector with each element standardised over all rows (population variance)."""
    e = vectors.select("id", F.posexplode("vector").alias("pos", "x"))
    m = e.groupBy("pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    s = e.join(F.broadcast(m), "pos").select("id", "pos", ((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + eps)).alias("x"))
    return s.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("vector"))


def layer_norm(vectors: DataFrame, eps: float = 1e-5) -> DataFrame:
    """id, vector standardised over its own elements."""
    n = F.size("vector").cast("double")
    mean = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x) / n
    v = vectors.withColumn("m", mean)
    var = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / n
    v = v.withColumn("sd", F.sqrt(var + eps))
    return v.select("id", F.transform("vector", lambda x: (x - F.col("m")) / F.col("sd")).alias("vector"))


def attention(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """query, id, weight: softmax over keys (id, vector) of the scaled dot product with each of a stated set of queries; negative scores are masked."""
    s = queries.select("query", F.col("vector").alias("qv")).join(keys).select("query", "id", (dot(F.col("qv"), F.col("vector")) / F.sqrt(F.size("qv").cast("double"))).alias("s")).where("s >= 0")
    top = s.groupBy("query").agg(F.max("s").alias("top"))
    e = s.join(top, "query").withColumn("e", F.exp(F.col("s") - F.col("top")))
    return e.join(e.groupBy("query").agg(F.sum("e").alias("z")), "query").select("query", "id", (F.col("e") / F.col("z")).alias("weight"))


def distmult(triples: DataFrame, vectors: DataFrame, relations: DataFrame) -> DataFrame:
    """head, rel, tail, score: sum over elements of h * r * t."""
    v = triples.join(vectors.select(F.col("id").alias("head"), F.col("vector").alias("h")), "head").join(vectors.select(F.col("id").alias("tail"), F.col("vector").alias("t")), "tail")
    v = v.join(relations.select(F.col("id").alias("rel"), F.col("vector").alias("r")), "rel")
    return v.select("head", "rel", "tail", dot(F.zip_with("h", "r", lambda x, y: x * y), F.col("t")).alias("score"))


def transe_loss(triples: DataFrame, vectors: DataFrame, relations: DataFrame, margin: float = 2.0) -> DataFrame:
    """head, rel, tail, loss: max(0, margin + |h + r - t| - |h' + r - t'|) for triples with corrupted ends (bad_head, bad_tail)."""
    v = triples
    for c in ("head", "tail", "bad_head", "bad_tail"):
        v = v.join(vectors.select(F.col("id").alias(c), F.col("vector").alias(f"v_{c}")), c)
    v = v.join(relations.select(F.col("id").alias("rel"), F.col("vector").alias("r")), "rel")

    def gap(h: str, t: str):
        d = F.zip_with(F.zip_with(h, "r", lambda x, y: x + y), t, lambda x, y: x - y)
        return F.sqrt(dot(d, d))

    return v.select("head", "rel", "tail", F.greatest(F.lit(0.0), margin + gap("v_head", "v_tail") - gap("v_bad_head", "v_bad_tail")).alias("loss"))


def corrupt(triples: DataFrame, seed: str = "corrupt") -> DataFrame:
    """Triples (head, rel, tail) with bad_head and bad_tail: entities of the same relation, chosen by hash.

    A relation's entities stand in a ring by hash; each triple takes the first entity of a hashed
    bucket, so no triple meets all entities.
    """
    ends = triples.select("rel", F.col("head").alias("e")).union(triples.select("rel", "tail")).distinct()
    n = 256
    bucket = lambda x: F.pmod(F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint"), F.lit(n))
    slots = ends.withColumn("b", bucket(hashed(F.lit("slot"), F.col("rel"), F.col("e")))).groupBy("rel", "b").agg(F.min("e").alias("e"))
    least = ends.groupBy("rel").agg(F.min("e").alias("least"))
    out = triples
    for side in ("head", "tail"):
        key = bucket(hashed(F.lit(seed), F.lit(side), F.col("head"), F.col("rel"), F.col("tail")))
        out = out.withColumn("b", key).join(slots.withColumnRenamed("e", f"bad_{side}"), ["rel", "b"], "left").drop("b")
    out = out.join(least, "rel")
    return out.select("head", "rel", "tail", F.coalesce("bad_head", "least").alias("bad_head"), F.coalesce("bad_tail", "least").alias("bad_tail"))


def corrupt_any(triples: DataFrame, seed: str = "corrupt") -> DataFrame:
    """Triples (head, rel, tail) with bad_head and bad_tail: any entity of the same relation, all equally likely, by hash.

    Entities are numbered over all relations at once, so those of a relation are a range of numbers, and a
    draw is one equi-join on the number.
    """
    ends = triples.select("rel", F.col("head").alias("e")).union(triples.select("rel", "tail")).distinct()
    n = numbered(ends, [F.col("rel"), F.col("e")], "number")
    span = cut(n.groupBy("rel").agg(F.min("number").alias("low"), F.count("*").alias("many")), "spans")
    out = triples.select("head", "rel", "tail").join(span, "rel")
    for side in ("head", "tail"):
        draw = F.conv(F.substring(hashed(F.lit(seed), F.lit(side), F.col("head"), F.col("rel"), F.col("tail")), 1, 15), 16, 10).cast("bigint")
        out = out.withColumn("number", F.col("low") + F.pmod(draw, F.col("many"))).join(n.select("number", F.col("e").alias(f"bad_{side}")), "number").drop("number")
    return out.select("head", "rel", "tail", "bad_head", "bad_tail")


def sage(edges: DataFrame, degrees: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, vector: sum over neighbours of x_j / sqrt(d_i * d_j)."""
    d = degrees.select("id", "degree").where("degree > 0")
    e = edges.select("src", "dst").distinct().join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst")
    return propagate(e.select("src", "dst", (1 / F.sqrt(F.col("a") * F.col("b").cast("double"))).alias("value")), vectors)


def confusion_metrics(pairs: DataFrame) -> DataFrame:
    """One row of accuracy, macro precision, recall and F1, micro F1, hamming and zero-one loss from (y, y_hat)."""
    c = pairs.groupBy("y", "y_hat").agg(F.count("*").cast("double").alias("n"))
    classes = c.select(F.col("y").alias("c")).union(c.select("y_hat")).distinct()
    tp = c.where("y = y_hat").select(F.col("y").alias("c"), F.col("n").alias("tp"))
    real = c.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("real"))
    said = c.groupBy(F.col("y_hat").alias("c")).agg(F.sum("n").alias("said"))
    t = classes.join(tp, "c", "left").join(real, "c", "left").join(said, "c", "left").na.fill(0.0)
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("real") > 0, F.col("tp") / F.col("real")).otherwise(0.0)
    f = F.when(F.col("real") + F.col("said") > 0, 2 * F.col("tp") / (F.col("real") + F.col("said"))).otherwise(0.0)
    acc = F.sum("tp") / F.sum("real")
    return t.agg(acc.alias("accuracy"), F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f).alias("macro_f1"), acc.alias("micro_f1"), (1 - acc).alias("hamming"), (1 - acc).alias("zero_one"))


def hits_f1_by_class(ranked: DataFrame, classes: DataFrame, queries: DataFrame, hits: list[int]) -> DataFrame:
    """hits_f1 over all pairs of a query and another row, labelled by whether their classes (id, label) are equal.

    Only ranked pairs become rows: the pairs that nothing ranks are counted from the classes' sizes.
    """
    best = ranked.select(F.col("query").alias("a"), F.col("id").alias("b"), "rank").union(ranked.select("id", "query", "rank")).groupBy("a", "b").agg(F.min("rank").alias("rank"))
    best = best.join(queries.select(F.col("query").alias("a")), "a", "left_semi")
    best = best.join(classes.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    same, hit = F.col("x") == F.col("y"), F.explode(F.array(*map(F.lit, hits))).alias("hit")
    said = best.select("rank", same.alias("same"), hit).where("rank <= hit").groupBy("hit").agg(F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("same"), 1).otherwise(0)).alias("fp"))
    sizes = classes.groupBy("label").agg(F.count("*").alias("n"))
    asked = classes.join(queries.select(F.col("query").alias("id")), "id", "left_semi").groupBy("label").agg(F.count("*").alias("q"))
    real = asked.join(sizes, "label").agg(F.coalesce(F.sum(F.col("q") * (F.col("n") - 1)), F.lit(0)).alias("real"))
    every = real.select("real", hit).join(said, "hit", "left").na.fill(0, ["tp", "fp"]).withColumn("fn", F.col("real") - F.col("tp"))
    den = F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))
    return every.select("hit", "tp", "fp", "fn", F.when(den > 0, F.col("tp") / den).otherwise(F.lit(0.0)).alias("f1"))


def hits_f1(ranked: DataFrame, labelled: DataFrame, hits: list[int]) -> DataFrame:
    """hit, tp, fp, fn, f1: a pair (a, b, label) counts as found if b is among a's first ``hit`` or a among b's."""
    best = ranked.select(F.col("query").alias("a"), F.col("id").alias("b"), "rank").union(ranked.select("id", "query", "rank")).groupBy("a", "b").agg(F.min("rank").alias("rank"))
    got = labelled.join(best, ["a", "b"], "left").select("label", "rank", F.explode(F.array(*map(F.lit, hits))).alias("hit"))
    said = F.coalesce(F.col("rank") <= F.col("hit"), F.lit(False))
    s = got.groupBy("hit").agg(F.sum(F.when(said & (F.col("label") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(said & (F.col("label") == 0), 1).otherwise(0)).alias("fp"), F.sum(F.when(~said & (F.col("label") == 1), 1).otherwise(0)).alias("fn"))
    den = F.col("tp") + 0.5 * (F.col("fp") + F.col("fn"))
    return s.select("hit", "tp", "fp", "fn", F.when(den > 0, F.col("tp") / den).otherwise(F.lit(0.0)).alias("f1"))
