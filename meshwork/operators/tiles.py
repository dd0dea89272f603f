"""A stated set of query vectors against all vectors, in tiles of bounded size.

Queries and vectors are dealt into blocks by hash; a task gets one block of each and compares them
with numpy. A query meets every vector, but no side is broadcast and no task sees more than a tile.
Scores are summed element by element in the vectors' own order, so that they do not depend on tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of queries and of vectors where each query keeps a few rows, and where every pair is a row.
QUERIES, VECTORS = 2048, 8192
PAIR_QUERIES, PAIR_VECTORS = 512, 2048
_STRIP = 1 << 20


def _blocks(rows: DataFrame, key: str, size: int) -> int:
    """Blocks of about ``size`` rows that the rows fill."""
    return max(1, -(-rows.count() // size))


def _dealt(queries: DataFrame, vectors: DataFrame, q_size: int, v_size: int):
    """Both sides by tile: queries (query, qv, ...) once for each block of vectors, and the reverse."""
    nq, nv = _blocks(queries, "query", q_size), _blocks(vectors, "id", v_size)
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", mine("query", nq)).select("*", every(nv).alias("vb"))
    v = vectors.withColumn("vb", mine("id", nv)).select("*", every(nq).alias("qb"))
    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb"))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if not len(col):
        return np.zeros((0, 0))
    flat = col.combine_chunks()
    width = np.diff(flat.offsets.to_numpy())
    if (width != width[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), width[0])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, each element summed from the first on."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += np.multiply.outer(x, y)
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return np.sqrt(out)


def _cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each of b; 0 where a vector is zero."""
    n = np.multiply.outer(na, nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, _dots(a, b) / n, 0.0)


def _clean(rows: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    """Rows with a key and a whole vector, as doubles."""
    v = F.col(vector).cast("array<double>")
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull())).withColumn(vector, v)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, typed: bool = False) -> DataFrame:
    """query, id, score, rank: the k vectors (id, vector[, type]) of greatest cosine, equal scores by id.

    ``queries`` is (query, vector, skip[, type]); ids in the array ``skip`` are left out, as are, if
    ``typed``, vectors of the query's type. A tile keeps its best k a query, so what is shuffled grows
    with queries times blocks. Of equal vectors of one type only as many rows as can matter are compared.
    Rows with a null key, vector or element are left out.
    """
    q = _clean(queries, "query", "vector").select("query", F.col("vector").alias("qv"), "skip", *([F.col("type").cast("string").alias("qt")] if typed else []))
    v = _clean(vectors, "id", "vector").select("id", "vector", *([F.col("type").cast("string").alias("type")] if typed else []))
    most = q.agg(F.max(F.size("skip"))).first()[0] or 0

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        keys, ids = a.column("query"), b.column("id").to_numpy()
        qv, vv = _matrix(a.column("qv")), _matrix(b.column("vector"))
        empty = pa.table({"query": keys.slice(0, 0), "id": b.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(qv) or not len(vv):
            return empty
        order = np.argsort(ids, kind="stable")
        if typed:
            kinds, kind = np.unique(np.concatenate([a.column("qt").to_numpy().astype(str), b.column("type").to_numpy().astype(str)]), return_inverse=True)
            q_kind, v_kind = kind[: len(qv)], kind[len(qv) :]
        else:
            q_kind, v_kind = np.zeros(len(qv), np.int64), np.zeros(len(vv), np.int64)
        # of equal vectors of a type the least ids, one more for each that a query may skip
        body = np.ascontiguousarray(np.column_stack([vv, v_kind])[order] + 0.0)
        _, same = np.unique(body.view(np.void(body.dtype.itemsize * body.shape[1]).dtype).ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")
        group = same[by]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        order = order[np.sort(by[nth < k + most])]
        ids, vv, v_kind = ids[order], vv[order], v_kind[order]
        nq, nv = _norms(qv), _norms(vv)
        skip, step = a.column("skip").to_pylist(), max(1, _STRIP // len(vv))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(qv), step):
            s = _cosines(qv[i : i + step], vv, nq[i : i + step], nv)
            if typed:
                s[q_kind[i : i + step, None] == v_kind[None, :]] = -np.inf
            for r, gone in enumerate(skip[i : i + step]):
                for x in gone or ():
                    s[r, np.searchsorted(ids, x, "left") : np.searchsorted(ids, x, "right")] = -np.inf
            if s.shape[1] > k:
                s[s < np.partition(s, s.shape[1] - k, axis=1)[:, -k, None]] = -np.inf
            r, c = np.nonzero(s > -np.inf)
            at = np.lexsort((c, -s[r, c], r))
            r, c = r[at], c[at]
            start = np.searchsorted(r, r, "left")
            keep = np.arange(len(r)) - start < k
            out.append((r[keep] + i, c[keep], s[r[keep], c[keep]]))
        r, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": keys.take(pa.array(r)), "id": b.column("id").take(pa.array(order[c])), "score": pa.array(s)})

    kinds = dict(q.dtypes), dict(v.dtypes)
    near = _dealt(q, v, QUERIES, VECTORS).applyInArrow(best, f"query {kinds[0]['query']}, id {kinds[1]['id']}, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "score", "rank")


def all_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query, id, cosine, euclid of each query (query, vector) with every other vector (id, vector): as many rows as there are pairs."""
    q = _clean(queries, "query", "vector").select("query", F.col("vector").alias("qv"))
    v = _clean(vectors, "id", "vector").select("id", "vector")

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        qv, vv = _matrix(a.column("qv")), _matrix(b.column("vector"))
        if not len(qv) or not len(vv):
            return pa.table({"query": a.column("query").slice(0, 0), "id": b.column("id").slice(0, 0), "cosine": pa.array([], pa.float64()), "euclid": pa.array([], pa.float64())})
        cosine = _cosines(qv, vv, _norms(qv), _norms(vv))
        gap = np.zeros(cosine.shape)
        for x, y in zip(qv.T, vv.T, strict=True):
            d = np.subtract.outer(x, y)
            gap += d * d
        r, c = np.divmod(np.arange(cosine.size), len(vv))
        return pa.table({"query": a.column("query").take(pa.array(r)), "id": b.column("id").take(pa.array(c)), "cosine": pa.array(cosine.ravel()), "euclid": pa.array(np.sqrt(gap).ravel())})

    kinds = dict(q.dtypes), dict(v.dtypes)
    out = _dealt(q, v, PAIR_QUERIES, PAIR_VECTORS).applyInArrow(both, f"query {kinds[0]['query']}, id {kinds[1]['id']}, cosine double, euclid double")
    return out.where("query <> id")
