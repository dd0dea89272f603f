"""Ranks and running sums over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.plans.scratch import cut


def numbered(rows: DataFrame, order: list[Column], index: str = "idx", running: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``index`` counting from 0 in the given order, and running sums (this row included) by name.

    Rows are dealt into ranges, sorted and numbered inside each, and written: ranges come from a
    sample, so a second computation might cut them elsewhere. Only one row per range meets in a window.
    """
    sums = running or {}
    own = [F.col(f"`{c}`") for c in rows.columns]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*own, F.monotonically_increasing_id().alias("__at"))
    # monotonic ids hold the partition in the upper bits and count from 0 inside it
    dealt = cut(dealt.select(*own, F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__in")), "ranges")
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    start = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums))
    inner = W.partitionBy("__part").orderBy("__in").rowsBetween(W.unboundedPreceding, 0)
    # one row for each of the ranges, whose number is that of the shuffle partitions
    out = dealt.join(F.broadcast(start), "__part")
    return out.select(*own, (F.col("__before") + F.col("__in")).alias(index), *((F.col(f"__b_{n}") + F.sum(c).over(inner)).alias(n) for n, c in sums.items()))
