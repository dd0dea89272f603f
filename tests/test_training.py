"""Trainers whose loss falls, eigenvectors that do not depend on the way they are found, negatives that reach every entity."""

import numpy as np
from pyspark.sql import functions as F

from meshwork.functions.scalars import learning_rates, uniform
from meshwork.graph import PropertyGraph, hashed_metapaths
from meshwork.operators import learning, spectral, vectors, walks
from meshwork.plans.scratch import cut


def test_eigenvectors_above_the_dense_size(spark, monkeypatch):
    pairs = [(f"a{i:02}", "hub", 1.0 + 0.01 * i) for i in range(12)] + [("hub", "p00", 0.5)] + [(f"p{i:02}", f"p{i + 1:02}", 1.0) for i in range(12)]
    e = spark.createDataFrame([x for a, b, w in pairs for x in ((a, b, "t", w), (b, a, "t", w))], "src string, dst string, type string, weight double")
    g = PropertyGraph.from_frames(e)
    whole = {r.id: np.array(r.vector) for r in spectral.smallest(g, 2).collect()}
    monkeypatch.setattr(spectral, "DENSE", 0)
    got = {r.id: np.array(r.vector) for r in spectral.smallest(g, 2, tol=1e-8).collect()}
    assert set(got) == set(whole) and max(np.abs(got[i] - whole[i]).max() for i in whole) < 1e-4


def test_skip_gram_loss_falls_and_brings_neighbours_together(spark):
    docs = spark.createDataFrame([(i, (["a", "b"] if i % 2 else ["x", "y"]) * 4) for i in range(20)], "doc int, tokens array<string>")
    v, losses = learning.sgns(docs, dim=8, window=3, epochs=8, negatives=3)
    assert losses[-1] < losses[0] and sorted(r.id for r in v.collect()) == ["a", "b", "x", "y"]
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in v.collect())
    assert learning_rates(1.0, 0.5, 3) == [1.0, 0.75, 0.5]


def test_triple_loss_falls_and_every_entity_can_be_a_negative(spark):
    t = spark.createDataFrame([(f"h{i}", "r", f"t{i % 4}") for i in range(40)], "head string, rel string, tail string")
    seen = set()
    for s in range(12):
        seen |= {x for r in vectors.corrupt_any(t, f"s{s}").collect() for x in (r.bad_head, r.bad_tail)}
    assert seen == {f"h{i}" for i in range(40)} | {f"t{i}" for i in range(4)}
    vec = lambda ids: ids.select("id", F.array(*(uniform(F.lit("v"), F.col("id"), F.lit(k)) for k in range(4))).alias("vector"))
    ent = vec(t.select(F.col("head").alias("id")).union(t.select("tail")).distinct())
    losses = learning.transe(t, ent, vec(t.select(F.col("rel").alias("id")).distinct()), epochs=4, rate=0.02)[2]
    assert losses[-1] < losses[0]


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(0)
    row, col, val = rng.integers(0, 9, 30), rng.integers(0, 9, 30), rng.normal(size=30)
    m = np.zeros((9, 9))
    np.add.at(m, (row, col), val)
    x = rng.normal(size=(9, 3))
    p = learning.Sparse(row, col, val, 9)
    assert np.allclose(p.times(x), m @ x) and np.allclose(p.transposed_times(x), m.T @ x)


def test_metapaths_follow_the_schema():
    schema = [("a", "r", "b"), ("b", "s", "a"), ("b", "t", "c")]
    paths = hashed_metapaths(schema, 3, 5)
    assert len(paths) == 5 and paths == hashed_metapaths(schema, 3, 5) and hashed_metapaths([], 3, 5) == []
    assert all(x in schema for p in paths for x in p) and all(x[2] == y[0] for p in paths for x, y in zip(p, p[1:]))


def test_too_many_edge_types_fall_back(spark):
    e = spark.createDataFrame([("a", "b", "t", 1.0), ("b", "a", "u", 1.0), ("b", "c", "t", 1.0), ("c", "b", "u", 1.0)], "src string, dst string, type string, weight double")
    nodes, t = spark.createDataFrame([("a",), ("c",)], "id string"), walks.uniform_transitions(e)
    plain = sorted(map(str, walks.simulate(e, nodes, 2, 4).collect()))
    assert sorted(map(str, walks.simulate(e, nodes, 2, 4, transitions=t, most_types=1).collect())) == plain
    assert walks.simulate(e, spark.createDataFrame([("z",)], "id string"), 2, 4).count() == 0


def test_no_vectors_of_nodes_are_broadcast(spark):
    n = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("t").alias("type"), F.lit("l").alias("label"))
    e = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.pmod(F.col("id") * 7, F.lit(2000))).alias("dst"), F.lit("e").alias("type"), F.lit(1.0).alias("weight"))
    g = PropertyGraph(n, e)
    x = cut(g.nodes.select("id", F.array_repeat(F.lit(0.5), 32).alias("vector")), "x")
    out = vectors.propagate(cut(g.propagation(), "p"), x)
    for df in (out, g.propagation(), g.degrees()):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.vector for r in out.collect()}
    assert len(got) == 2000 and all(len(v) == 32 and abs(v[0] - 1.0) < 1e-9 for v in got.values())


def test_graph_network_is_trained_on_every_edge_however_it_is_dealt(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 23
    pairs = {(0, i) for i in range(1, n)} | {(i, 0) for i in range(1, n)} | {tuple(map(int, x)) for x in rng.integers(0, n, (30, 2))}
    g = PropertyGraph(spark.createDataFrame([(f"n{i:02}", "t", "l") for i in range(n)], "id string, type string, label string"), spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "e", 1.0) for a, b in pairs] + [("n01", "lost", "e", 1.0)], "src string, dst string, type string, weight double"))
    x, y = rng.normal(size=(n, 3)), np.array([i % 2 if i % 4 else -1 for i in range(n)])
    features = spark.createDataFrame([(f"n{i:02}", list(map(float, x[i]))) for i in range(n)], "id string, vector array<double>")
    labels = spark.createDataFrame([(f"n{i:02}", int(y[i])) for i in range(n) if y[i] >= 0], "id string, label int")
    m = np.eye(n)
    for a, b in pairs:
        m[a, b] += 1
    m /= m.sum(axis=1, keepdims=True)
    monkeypatch.setattr(learning, "BLOCK", 0)
    for hidden in ((4,), (4, 5)):
        want = learning.init_weights([3, *hidden, 2])
        for _ in range(2):
            h = [x]
            for k, w in enumerate(want):
                h.append(m @ h[-1] @ w if k + 1 == len(want) else np.tanh(m @ h[-1] @ w))
            d, grads = np.exp(h[-1]) / np.exp(h[-1]).sum(axis=1, keepdims=True) - np.eye(2)[y], []
            d[y < 0] = 0
            for k in range(len(want) - 1, -1, -1):
                grads.insert(0, (m @ h[k]).T @ d)
                d = m.T @ d @ want[k].T * (1 - h[k] ** 2)
            want = [w - 0.5 / (y >= 0).sum() * (v + 5e-4 * w) for w, v in zip(want, grads)]
        for whole, edges in ((1 << 22, 1 << 20), (0, 4)):
            monkeypatch.setattr(learning, "WHOLE", whole)
            monkeypatch.setattr(learning, "EDGES", edges)
            got = learning.cluster_gcn(g, features, labels, 2, hidden, rounds=2, steps=1, nodes_per_part=5, rate=0.5)
            assert all(np.allclose(v, w) for v, w in zip(got, want, strict=True))
