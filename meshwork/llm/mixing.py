"""Mixing sources to target weights (DataFrame functions only).

Sizes are summed per source, targets follow from weights and caps, and a source's repetition rate is
its target over its size. Each document is emitted floor(rate) times, plus one copy with probability
equal to the fraction, decided by a hash of seed and key: reruns agree and no state is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm.common import fresh, table, words_of
from meshwork.plans.scratch import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Up to this many sources (some 100 bytes each) the table of rates is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(key: Column, seed: str = SEED, instead: Column | None = None) -> Column:
    """A number in [0, 1) from the MD5 of seed and key; null keys share one, or have one of their own by ``instead``."""
    none = F.lit("null") if instead is None else F.concat(F.lit("null:"), F.md5(F.coalesce(instead.cast("binary"), F.lit(b""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), none)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size) plus ``target``.

    Sources in code-point order, null last, take the weights in turn. The shares of ``share`` times
    the total are cut at ``cap`` times a source's size and the excess goes to the others by weight
    until none is above: that is the level L with sum(min(cap * size, L * weight)) = share * total.
    With sources in order of cap * size / weight those that are cut come first, so L is read off
    running sums. One row per source; the windows over all of them see only these few rows.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    each = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("most", cap * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0)).cast("double")
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    # The level if exactly the sources before this one are cut; the first row it does not cut has the answer.
    stepped = each.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most").cast("double"))
    first = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return stepped.select("source", "source_size", F.least(F.col("most").cast("double"), first * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, null_keys_by_text: bool = False) -> DataFrame:
    """``docs`` plus a struct column (last) with size, source_size, target and copies.

    Rows that share a key are taken alike, as one document. Null keys share one draw, or one by text if
    ``null_keys_by_text``, so that many of them still come near their source's target.
    Null text has size 0, a null source is a source of its own, empty sources have target 0. The
    per-source sums are combined before the shuffle, so a hot source costs one row a task; the join
    back is a broadcast if the counted sources are few, else a shuffle join that adaptive execution
    splits where a source is hot.
    """
    spark = docs.sparkSession
    out, s = fresh(docs.columns, "mix"), fresh(docs.columns, "__size")
    own = [F.col(f"`{c}`") for c in docs.columns]
    size = F.size(words_of(F.col(f"`{text}`"))).cast("bigint")
    sums = docs.select(F.col(f"`{source}`").cast("string").alias("source"), size.alias("z")).groupBy("source").agg(F.sum("z").alias("source_size"))
    rates = cut(targets(sums), "rates")
    rates = rates.select(F.col("source").alias("__m_source"), F.col("source_size").alias("__m_size"), F.col("target").alias("__m_target"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.select(*own, size.alias(s)).join(rates, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__m_source")), "left")
    rate = F.when(F.col("__m_size") > 0, F.col("__m_target") / F.col("__m_size").cast("double")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(uniform(F.col(f"`{key}`"), seed, F.col(f"`{text}`") if null_keys_by_text else None) < rate - whole, 1).otherwise(0)).cast("int")
    return joined.select(*own, F.struct(F.col(s).alias("size"), F.col("__m_size").alias("source_size"), F.col("__m_target").alias("target"), copies.alias("copies")).alias(out))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's rows as often as it is taken, with ``copy`` counting from 0 as the last column."""
    m = mixed(docs, **options)
    out, copy = m.columns[-1], fresh(m.columns, "copy")
    n = F.col(out)["copies"]
    # most are taken not at all, once or twice; the filter comes before the rows are repeated
    return m.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), n - 1))).drop(out)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = mixed(docs)
    x = F.col(m.columns[-1])
    return m.select("doc_id", x["size"].alias("size"), x["source_size"].alias("source_size"), x["target"].alias("target"), (x["size"] * x["copies"]).cast("bigint").alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, most / weight) AS level FROM l WHERE level * weight <= most::DOUBLE),
t AS (SELECT source, source_size, least(most::DOUBLE, f.level * weight) AS target FROM w, f),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
