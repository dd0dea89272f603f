"""Vocabularies, context windows and negative samples from tokenised documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.functions.scalars import keep_probability, uniform
from meshwork.operators import tiles
from meshwork.plans.ranking import numbered


def vocabulary(docs: DataFrame, rate: float = 0.01, threshold: float = 0.2, domain: int | None = None, pad: str = "0") -> DataFrame:
    """rn, word, count, frequency, probability_of_staying, cumulative_distribution from (doc, tokens).

    Corpus size is documents times the longest, as if the shorter were padded with ``pad``, which is
    counted as a word. Words whose keep-probability is at most ``threshold`` go. The distribution is
    the running share of count ** 0.75 (count descending, word ascending), scaled to ``domain`` (the
    number of words kept) and rounded half to even.
    """
    n = docs.agg((F.count("*") * F.max(F.size("tokens"))).alias("size"), (F.count("*") * F.max(F.size("tokens")) - F.sum(F.size("tokens"))).alias("pads"))
    words = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    words = words.union(n.where("pads > 0").select(F.lit(pad).alias("word"), F.col("pads").alias("count"))).groupBy("word").agg(F.sum("count").alias("count"))
    v = words.join(F.broadcast(n)).withColumn("frequency", F.col("count") / F.col("size"))
    v = v.withColumn("probability_of_staying", keep_probability(F.col("frequency"), rate)).where(F.col("probability_of_staying") > threshold)
    v = numbered(v, [F.desc("count"), F.col("word")], "rn", {"run": F.pow("count", F.lit(0.75))})
    total = v.agg(F.max("run").alias("total"), F.count("*").alias("kept"))
    size = F.lit(domain) if domain is not None else F.col("kept")
    cdf = F.bround(F.col("run") / F.col("total") * size).cast("bigint")
    return v.join(F.broadcast(total)).select((F.col("rn") + 1).cast("int").alias("rn"), "word", "count", "frequency", "probability_of_staying", cdf.alias("cumulative_distribution"))


def typed_cdf(words: DataFrame) -> DataFrame:
    """type, word, count, cumulative: the running share of count ** 0.75 inside each type."""
    order = W.partitionBy("type").orderBy(F.desc("count"), "word")
    run = F.sum(F.pow("count", F.lit(0.75))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return words.select("type", "word", "count", (run / F.sum(F.pow("count", F.lit(0.75))).over(W.partitionBy("type"))).alias("cumulative"))


def context_pairs(docs: DataFrame, window: int) -> DataFrame:
    """doc, i, j, center, context for places at most window // 2 apart (an even window takes one more word).

    Pairs come from the document's own array: nothing is shuffled.
    """
    half = (window if window % 2 else window + 1) // 2
    at = docs.select("doc", "tokens", F.posexplode("tokens").alias("i", "center"))
    low, high = F.greatest(F.col("i") - half, F.lit(0)), F.least(F.col("i") + half, F.size("tokens") - 1)
    near = at.select("doc", "tokens", "i", "center", F.explode(F.sequence(low, high)).alias("j")).where("i <> j")
    return near.select("doc", "i", "j", "center", F.get("tokens", F.col("j")).alias("context"))


def inverse_cdf(draws: DataFrame, steps: DataFrame, buckets: int = 256) -> DataFrame:
    """For draws (id, u) the first of steps (item, cumulative), in order, whose cumulative is at least u.

    Steps become ranges (low, high]; both sides are cut into equal buckets of [0, top], so the range
    join is an equi-join on the bucket.
    """
    n = numbered(steps.select("item", F.col("cumulative").cast("double").alias("high")), [F.col("high"), F.col("item")])
    before = n.select((F.col("idx") + 1).alias("idx"), F.col("high").alias("low"))
    r = n.join(before, "idx", "left").select("item", F.coalesce("low", F.lit(-1.0)).alias("low"), "high").where("high > low")
    top = r.agg(F.greatest(F.max("high"), F.lit(1e-300)).alias("top"))
    place = lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)) / F.col("top"), F.lit(1.0)) * buckets)
    r = r.join(F.broadcast(top)).select("item", "low", "high", F.explode(F.sequence(place(F.col("low")), place(F.col("high")))).alias("b"))
    d = draws.join(F.broadcast(top)).select("id", "u", place(F.col("u")).alias("b"))
    return d.join(r, "b").where("u > low AND u <= high").select("id", "item")


def negative_samples(pairs: DataFrame, vocab: DataFrame, k: int, seed: str = "neg") -> DataFrame:
    """Pairs (id, center, context) with k drawn words each: id, draw, word, by the vocabulary's distribution."""
    top = vocab.agg(F.max("cumulative_distribution").alias("top"))
    draws = pairs.select("id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw")).join(F.broadcast(top))
    draws = draws.select(F.struct("id", "draw").alias("id"), (uniform(F.lit(seed), F.col("id"), F.col("draw")) * F.col("top")).alias("u"))
    got = inverse_cdf(draws, vocab.select(F.col("word").alias("item"), F.col("cumulative_distribution").cast("double").alias("cumulative")))
    return got.select("id.id", "id.draw", F.col("item").alias("word"))


def cooccurrence(walks: DataFrame) -> DataFrame:
    """a, b, n: how often b stands anywhere after the first token a of a walk, other than a itself."""
    w = walks.select(F.element_at("tokens", 1).alias("a"), F.explode(F.slice("tokens", 2, 1 << 30)).alias("b"))
    return w.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def analogy(vectors: DataFrame, quads: DataFrame, top: int = 1) -> DataFrame:
    """For (a, b, c, expected) the words nearest to b + c - a by cosine, other than a, b and c: a, b, c, expected, word, rank.

    Quads with a word that has no vector are left out. Repeated quads are answered once each.
    """
    v = vectors.select("word", "vector")
    q = quads.select("a", "b", "c", "expected")
    for x in ("a", "b", "c"):
        q = q.join(v.select(F.col("word").alias(x), F.col("vector").alias(f"v{x}")), x)
    aim = F.zip_with(F.zip_with("vb", "vc", lambda x, y: x + y), "va", lambda x, y: x - y)
    asked = q.select(F.struct("a", "b", "c").alias("query"), aim.alias("vector"), F.array("a", "b", "c").alias("skip")).dropDuplicates(["query"])
    got = tiles.nearest(asked.withColumn("query", F.to_json("query")), v.withColumnRenamed("word", "id"), top)
    named = q.select("a", "b", "c", "expected", F.to_json(F.struct("a", "b", "c")).alias("query"))
    return named.join(got, "query").select("a", "b", "c", "expected", F.col("id").alias("word"), "score", "rank")


def analogy_accuracy(vectors: DataFrame, quads: DataFrame) -> DataFrame:
    """section, n, right, accuracy of quads (section, a, b, c, expected): how often the nearest word is the expected one.

    Quads with an unknown word count as wrong.
    """
    hit = analogy(vectors, quads.select("a", "b", "c", "expected").distinct()).where("word = expected").select("a", "b", "c", "expected", F.lit(1).alias("hit"))
    s = quads.join(hit, ["a", "b", "c", "expected"], "left").groupBy("section").agg(F.count("*").alias("n"), F.count("hit").alias("right"))
    return s.select("section", "n", "right", (F.col("right") / F.col("n")).alias("accuracy"))


def windows(items: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - (size - 1), F.lit(1))), lambda i: F.slice(items, i, size))
