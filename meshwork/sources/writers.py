"""Writing results; Parquet is the first choice, the text forms are for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embeddings_tsv(vectors: DataFrame, path: str, metadata: str) -> None:
    """Six decimals by tab, and the ids in the same order beside them; both ordered by id."""
    rows = vectors.orderBy("id")
    rows.select(F.array_join(F.transform("vector", lambda x: F.format_string("%f", x.cast("double"))), "\t").alias("value")).write.text(path)
    rows.select(F.col("id").cast("string").alias("value")).write.text(metadata)


def ranking_csv(scores: DataFrame, score: str, path: str) -> None:
    scores.orderBy(F.desc(score), "id").write.option("header", True).csv(path)


def tsv(rows: DataFrame, path: str, quote: str = "|") -> None:
    rows.write.option("sep", "\t").option("quote", quote).csv(path)


def id_dictionary(ids: DataFrame, path: str) -> None:
    """One id a line, by index."""
    ids.orderBy("idx").select(F.col("id").cast("string").alias("value")).write.text(path)


def walks_text(walks: DataFrame, path: str) -> None:
    walks.select(F.array_join("tokens", " ").alias("value")).write.text(path)


def word_vectors(vectors: DataFrame, path: str) -> None:
    """``word v1 v2 ...`` lines."""
    vectors.select(F.concat_ws(" ", F.col("id"), F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)


def table(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)


def coordinates(vectors: DataFrame) -> DataFrame:
    """id, x, y: the first two principal components, for plotting elsewhere."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("f"))
    p = PCA(k=2, inputCol="f", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("p"))
    return p.select("id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
