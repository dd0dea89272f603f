"""Scalar functions over text, ids and vectors, all as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snap(x: Column | str) -> Column:
    """Round half up by plain IEEE operations, so that other engines give the same bits."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(1e6) + 0.5) / F.lit(1e6)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the only source of randomness, so reruns agree."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(hashed(*cols), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def ascii_clean(text: Column) -> Column:
    """ASCII characters only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def typed_token(token: Column) -> tuple[Column, Column]:
    """Type and word of a token written ``[t]word``: its second character, and all from the fourth."""
    return F.substring(token, 2, 1), F.substring(token, 4, 1 << 30)


def edge_token(edge: Column) -> Column:
    return F.concat(F.lit("EDGE_"), edge.cast("string"))


def edge_of_token(token: Column) -> Column:
    return F.substring(token, 6, 1 << 30)


def edge_path(edges: Column, node: Column) -> Column:
    """``e1->e2->node``."""
    return F.array_join(F.concat(edges, F.array(node)), "->")


def path_node(path: Column) -> Column:
    return F.element_at(F.split(path, "->"), -1)


def path_edges(path: Column) -> Column:
    parts = F.split(path, "->")
    return F.slice(parts, 1, F.size(parts) - 1)


def basename(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def to_letters(number: Column) -> Column:
    """Digits as letters, 0 as a to 9 as j."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def from_letters(letters: Column) -> Column:
    return F.translate(letters, "abcdefghij", "0123456789").cast("bigint")


def entity_of_url(url: Column) -> Column:
    """Last segment of the path, zeros stripped from both ends, the part after a colon, stripped again."""
    seg = F.trim(F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), "/"), -1), F.lit("0"))
    return F.trim(F.element_at(F.split(seg, ":"), -1), F.lit("0"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def min_max(v: Column) -> Column:
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    return F.transform(v, lambda x: F.when(high > low, (x.cast("double") - low) / (high - low)).otherwise(F.lit(0.0)))


def l2(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def standardise(x: Column) -> Column:
    return (x + 1.0) / 2.0


def softmax(v: Column) -> Column:
    top = F.array_max(v).cast("double")
    e = F.transform(v, lambda x: F.exp(x.cast("double") - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def one_hot(k: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == k, 1).otherwise(0))


def difference(a: Column, b: Column) -> Column:
    """Edge vector: head less tail."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def keep_probability(share: Column, rate: float) -> Column:
    """Subsampling of frequent words: (sqrt(z / s) + 1) * s / z."""
    return (F.sqrt(share / rate) + 1.0) * (F.lit(rate) / share)


def underscored(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def with_prefix(name: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), name)


def without_prefix(uri: Column, prefix: str) -> Column:
    return F.when(F.startswith(uri, F.lit(prefix)), F.substring(uri, len(prefix) + 1, 1 << 30)).otherwise(uri)


def values_of(field: Column) -> Column:
    """The values of a field that holds several, parted by spaces."""
    return F.filter(F.split(field, " "), lambda x: x != "")


def decoded_flag(flag: Column) -> tuple[Column, Column]:
    """Whether a pair is negative, and whether it is in the test part, of negative + 2 * in_test."""
    return flag % 2, F.floor(flag / 2).cast("int")


def learning_rates(first: float, last: float, steps: int) -> list[float]:
    """Rates from the first to the last in equal steps."""
    return [first + (last - first) * k / max(1, steps - 1) for k in range(steps)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def normal_cdf(v: pd.Series) -> pd.Series:
    """Standard normal distribution function of each element; SQL has no error function."""
    sizes = [-1 if x is None else len(x) for x in v]
    flat = np.concatenate([np.asarray(x, float) for x in v if x is not None] or [np.empty(0)])
    done = 0.5 * (1 + _erf(flat / math.sqrt(2)))
    out, at = [], 0
    for n in sizes:
        out.append(None if n < 0 else done[at : at + n])
        at += max(n, 0)
    return pd.Series(out)


_erf = np.vectorize(math.erf, otypes=[float])
