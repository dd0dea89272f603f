"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 pattern of what separates words: space and the controls from tab to carriage return.
GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or with underscores until no column (in any case) has it."""
    seen = {c.lower() for c in taken}
    while name.lower() in seen:
        name += "_"
    return name


def words_of(text: Column, gaps: str = GAPS) -> Column:
    """Array of the words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def utf8(text: Column) -> Column:
    """The text's bytes, empty for null; Python workers then get bytes without decoding them."""
    return F.coalesce(text, F.lit("")).cast("binary")
