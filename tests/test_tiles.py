"""Searches in tiles against all pairs in numpy."""

import numpy as np
import pytest

from meshwork.operators import corpus, tiles, vectors


def _rows(n=90, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, (n, 4)).astype(float)  # many ties
    v[5], v[6], v[7] = 0.0, v[8], v[8]
    return [(i, v[i].tolist(), "ab"[i % 2]) for i in range(n)]


def _cos(a, b):
    n = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
    return float(np.dot(a, b) / n) if n > 0 else 0.0


def _plain(rows, k, typed):
    out = set()
    for q, x, t in rows:
        if q % 5:
            continue
        s = sorted((-round(_cos(np.array(x), np.array(y)), 9), i) for i, y, u in rows if i != q and not (typed and u == t))
        out |= {(q, i, -v, r + 1) for r, (v, i) in enumerate(s[:k])}
    return out


@pytest.fixture()
def small(monkeypatch):
    for name, size in {"QUERIES": 4, "VECTORS": 13, "PAIR_QUERIES": 5, "PAIR_VECTORS": 11, "_STRIP": 20}.items():
        monkeypatch.setattr(tiles, name, size)


@pytest.mark.parametrize("typed", [False, True])
def test_nearest_over_many_tiles(spark, small, typed):
    rows = _rows()
    v = spark.createDataFrame(rows, "id bigint, vector array<double>, type string")
    got = vectors.nearest(v.where("id % 5 = 0").withColumnRenamed("id", "query"), v, 7, typed).collect()
    assert {(r.query, r.id, round(r.score, 9), r["rank"]) for r in got} == _plain(rows, 7, typed)


def test_nearest_leaves_out_nulls_and_takes_names(spark, small):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), (None, [1.0, 0.0]), ("c", [1.0, None]), ("d", [0.0, 1.0]), ("e", [1.0, 0.0])], "id string, vector array<double>")
    got = vectors.nearest(v.withColumnRenamed("id", "query"), v, 9).collect()
    assert {(r.query, r.id, r["rank"]) for r in got} == {("a", "e", 1), ("a", "d", 2), ("e", "a", 1), ("e", "d", 2), ("d", "a", 1), ("d", "e", 2)}
    assert vectors.nearest(v.limit(0).withColumnRenamed("id", "query"), v, 9).count() == 0


def test_many_copies_of_a_vector(spark, small):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "id bigint, vector array<double>")
    got = vectors.nearest(v.where("id % 20 = 0").withColumnRenamed("id", "query"), v, 3).collect()
    assert {(r.query, r.id) for r in got} == {(q, i) for q in (0, 20, 40) for i in ([1, 2, 3] if q == 0 else [0, 1, 2])}


def test_all_scores(spark, small):
    rows = _rows(40)
    v = spark.createDataFrame(rows, "id bigint, vector array<double>, type string")
    got = {(r.query, r.id): (r.cosine, r.euclid) for r in tiles.all_scores(v.where("id % 5 = 0").withColumnRenamed("id", "query"), v).collect()}
    assert set(got) == {(q, i) for q in range(0, 40, 5) for i in range(40) if i != q}
    for (q, i), (c, e) in got.items():
        x, y = np.array(rows[q][1]), np.array(rows[i][1])
        assert abs(c - _cos(x, y)) < 1e-12 and abs(e - np.linalg.norm(x - y)) < 1e-12


def test_hits_by_class_equal_hits_over_all_pairs(spark, small):
    rows = _rows()
    v = spark.createDataFrame(rows, "id bigint, vector array<double>, label string")
    q = v.where("id % 5 = 0").withColumnRenamed("id", "query")
    ranked = vectors.nearest(q, v.select("id", "vector"), 12)
    pairs = spark.createDataFrame([(a, b, int(t == u)) for a, _, t in rows if a % 5 == 0 for b, _, u in rows if a != b], "a bigint, b bigint, label int")
    plain = vectors.hits_f1(ranked, pairs, [3, 12]).collect()
    assert sorted(map(tuple, vectors.hits_f1_by_class(ranked, v, q, [3, 12]).collect())) == sorted(map(tuple, plain))


def test_analogy_and_its_accuracy(spark, small):
    words = {"man": [1.0, 0.0, 0.0], "woman": [1.0, 1.0, 0.0], "king": [1.0, 0.0, 1.0], "queen": [1.0, 1.0, 1.0], "tree": [-1.0, 0.3, 0.0]}
    v = spark.createDataFrame(list(words.items()), "word string, vector array<double>")
    quads = [("family", "man", "woman", "king", "queen"), ("family", "man", "king", "woman", "tree"), ("none", "man", "king", "nobody", "queen")]
    q = spark.createDataFrame(quads, "section string, a string, b string, c string, expected string")
    assert {(r.a, r.b, r.c, r.word) for r in corpus.analogy(v, q).collect()} == {("man", "woman", "king", "queen"), ("man", "king", "woman", "queen")}
    assert {tuple(r) for r in corpus.analogy_accuracy(v, q).collect()} == {("family", 2, 1, 0.5), ("none", 1, 0, 0.0)}
