"""The graph engine on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from meshwork.functions import scalars as fn
from meshwork.graph import PropertyGraph, dense_index, matrix_product
from meshwork.operators import centrality, communities, corpus, etl, hierarchy, spectral, vectors, walks
from meshwork.operators.components import star_components


@pytest.fixture(scope="session")
def cliques(spark):
    """Two cliques of five joined by one edge, and a node alone."""
    e = [(a, b) for s in ("a", "b") for a in [f"{s}{k}" for k in range(5)] for b in [f"{s}{k}" for k in range(5)] if a != b] + [("a0", "b0"), ("b0", "a0")]
    edges = spark.createDataFrame([(a, b, "e", 1.0) for a, b in e], "src string, dst string, type string, weight double").cache()
    nodes = spark.createDataFrame([(f"{s}{k}", s, s) for s in ("a", "b") for k in range(5)] + [("z", "z", "z")], "id string, type string, label string").cache()
    return PropertyGraph(nodes, edges)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_structure(spark, cliques):
    deg = {r.id: (r.degree, r.weighted) for r in cliques.degrees().collect()}
    assert deg["a0"] == (5, 5.0) and deg["a1"] == (4, 4.0) and deg["z"] == (0, 0.0)
    assert cliques.info().first() == (11, 42, 10, 1)
    lap = cliques.laplacian().groupBy("src").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in lap)
    assert {r.src: r.s for r in cliques.propagation().groupBy("src").agg(F.sum("value").alias("s")).collect()}["a1"] == pytest.approx(5 / 4)
    assert rows(cliques.quotient().select("src", "dst")) == [("a", "b"), ("b", "a")]
    assert cliques.line_graph().where("a = 'a0~b0'").count() == 8
    looped = PropertyGraph.from_frames(cliques.edges, cliques.nodes, link_single_nodes=True)
    assert looped.edges.where("type = 'self'").count() == 1
    assert PropertyGraph.from_frames(cliques.edges).nodes.count() == 10
    assert PropertyGraph.from_frames(cliques.edges, cliques.nodes.where("id <> 'a0'")).edges.count() == 42 - 2 * 5
    assert not cliques.is_complete().first().complete
    half = PropertyGraph(cliques.nodes.where("type = 'a'"), cliques.edges.where("src LIKE 'a%' AND dst LIKE 'a%'"))
    assert half.is_complete().first().complete
    idx = rows(dense_index(cliques.nodes))
    assert idx == [(n, k) for k, n in enumerate(sorted(x for x, _ in idx))]


def test_matrix_product(spark):
    a = spark.createDataFrame([("x", "m", 2.0), ("x", "n", 3.0)], "src string, dst string, value double")
    b = spark.createDataFrame([("m", "y", 5.0), ("n", "y", 7.0)], "src string, dst string, value double")
    assert rows(matrix_product(a, b)) == [("x", "y", 31.0)]


def test_components(spark, cliques):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (None, 3)], "src bigint, dst bigint")
    got = {r.id: r.component for r in star_components(chain).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert star_components(chain.limit(0)).count() == 0
    labels = {r.id: r.label for r in communities.component_labels(cliques.nodes, star_components(cliques.edges)).collect()}
    assert labels["a0"] == labels["b4"] == 0 and labels["z"] == 1


def test_communities(cliques):
    split = cliques.nodes.where("type <> 'z'").select("id", F.col("type").alias("cluster"))
    one = split.select("id", F.lit("c").alias("cluster"))
    q = lambda lab: communities.modularity(cliques.edges, lab).first().q
    assert q(one) == pytest.approx(0) and q(split) == pytest.approx(40 / 42 - 0.5)
    gain = communities.move_gains(cliques.edges, split).where("id = 'a0'").first().gain
    moved = split.select("id", F.when(F.col("id") == "a0", "b").otherwise(F.col("cluster")).alias("cluster"))
    assert q(moved) - q(split) == pytest.approx(gain)
    found = {}
    for r in communities.louvain(cliques.edges, levels=3, rounds=8).collect():
        found.setdefault(r.cluster, set()).add(r.id)
    assert {f"a{k}" for k in range(1, 5)} <= found[min(found)] and q(communities.louvain(cliques.edges, levels=1, rounds=3)) > 0


def test_centrality(spark, cliques):
    pr = {r.id: r.rank for r in centrality.pagerank(cliques.edges, rounds=60, tol=1e-9).collect()}
    assert sum(pr.values()) == pytest.approx(1) and max(pr, key=pr.get) in ("a0", "b0")
    path = centrality.shortest_path(cliques.edges, "a1", "b1").first()
    assert path == (3, ["a1", "a0", "b0", "b1"])
    assert centrality.shortest_path(cliques.edges, "a1", "z").count() == 0
    bt = {r.id: r.score for r in centrality.betweenness(cliques.edges).collect()}
    assert bt["a0"] == pytest.approx(2 * 4 * 5 / (9 * 8)) and bt["a1"] == 0
    lv = {r.id: r.level for r in centrality.bfs_levels(cliques.edges, spark.createDataFrame([("a1",)], "id string")).collect()}
    assert lv["a0"] == 1 and lv["b0"] == 2 and lv["b3"] == 3


def test_spectral_side_splits_the_cliques(cliques):
    side = {r.id: r.side for r in spectral.fiedler(PropertyGraph(cliques.nodes.where("id <> 'z'"), cliques.edges)).collect()}
    assert len({side[f"a{k}"] for k in range(5)}) == 1 and side["a1"] == -side["b1"]


def test_spectral_iteration_agrees_with_the_dense_solver(monkeypatch, cliques):
    g = PropertyGraph(cliques.nodes.where("id <> 'z'"), cliques.edges)
    dense = {r.id: r.value for r in spectral.fiedler(g).collect()}
    monkeypatch.setattr(spectral, "DENSE", 1)
    v = {r.id: r.vector[1] for r in spectral.smallest(g, 2, rounds=9).collect()}
    assert all(v[k] == pytest.approx(dense[k], abs=1e-2) for k in v)


def test_hierarchy(spark):
    tree = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "d")], "parent string, child string")
    assert dict(rows(hierarchy.ranks(tree))) == {"r": 1, "a": 2, "b": 2, "c": 3, "d": 4}
    pairs = spark.createDataFrame([("d", "b"), ("d", "a"), ("c", "d")], "a string, b string")
    assert rows(hierarchy.common_parents(tree, pairs)) == [("c", "d", "c"), ("d", "a", "a"), ("d", "b", "r")]


def test_walks_follow_edges_and_repeat(spark, cliques):
    start = walks.start_walks(cliques.nodes.select("id"), 2)
    one = rows(walks.walk(cliques.edges, start, 6).select("walk_id", "tokens"))
    assert one == rows(walks.walk(cliques.edges, start, 6).select("walk_id", "tokens"))
    e = set(rows(cliques.edges.select("src", "dst")))
    for w, t in one:
        assert all(p in e for p in zip(t, t[1:], strict=False)) and (len(t) == 6 or w.startswith("z"))
    far = walks.second_order_walk(cliques.edges, start, 5, p=1e9, q=1e-9).collect()
    assert all(p in e for r in far for p in zip(r.tokens, r.tokens[1:], strict=False))
    assert walks.metapath_types(["a", "b", "a"], 6) == ["a", "b", "a", "b", "a", "b"] and walks.metapath_types(["a", "b"], 3) == ["a", "b", "a"]
    m = walks.markov(cliques.edges, cliques.nodes.where("id = 'a1'").select("id"), cliques.degrees(), 3)
    assert m.count() == 3


def test_em_transitions(cliques):
    e = cliques.edges.withColumn("type", F.when(F.col("src") < F.col("dst"), "up").otherwise("down")).withColumn("edge_id", F.concat_ws(">", "src", "dst"))
    t = walks.em_transitions(e, rounds=2)
    assert t.count() == 4 and all(-1 <= r.prob <= 1 for r in t.collect())


def test_corpus(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["b"])], "doc int, tokens array<string>")
    v = corpus.vocabulary(docs, rate=1.0).collect()
    assert [(r.word, r["count"]) for r in v] == [("0", 3), ("a", 2), ("b", 2), ("c", 1)] and v[-1].cumulative_distribution == 4
    assert corpus.context_pairs(docs, 3).count() == 6
    pairs = corpus.context_pairs(docs, 3).select(F.concat_ws("-", "doc", "i", "j").alias("id"), "center", "context")
    assert corpus.negative_samples(pairs, corpus.vocabulary(docs, rate=1.0), 3).count() == 18
    steps = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 3.0)], "item string, cumulative double")
    draws = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.5), (4, 3.0)], "id int, u double")
    assert rows(corpus.inverse_cdf(draws, steps)) == [(1, "x"), (2, "x"), (3, "y"), (4, "y")]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    near = vectors.nearest(v.withColumnRenamed("id", "query"), v, 1).collect()
    assert {r.query: r.id for r in near} == {"a": "b", "b": "a", "c": "b"}
    assert rows(vectors.layer_norm(v, 0.0).where("id = 'a'")) == [("a", [1.0, -1.0])]
    assert vectors.mean_by(v.withColumn("k", F.lit(1)), "k").first().vector == pytest.approx([2 / 3, 1.1 / 3])
    cdf = v.select(fn.normal_cdf(F.col("vector")).alias("x")).first().x
    assert cdf == pytest.approx([0.841344746, 0.5])


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4).alias("c"))
    assert etl.split(df, ["id"], 0.25).where("split = 'test'").count() == 250
    got = etl.balanced_split(df, "c", 40).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 400, "valid": 300, "test": 300}
    t = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c"), ("b", "r", "c"), ("d", "r", "a")], "head string, rel string, tail string")
    s = etl.covering_split(t, 1.0).where("split = 'train'").collect()
    assert {x for r in s for x in (r.head, r.tail)} == {"a", "b", "c", "d"}
    assert etl.negatives(t, vectors.corrupt(t)).join(t, ["head", "rel", "tail"]).count() == 0


def test_ranges_number_every_row(spark):
    from meshwork.plans.ranking import numbered

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(1).alias("one"))
    got = numbered(df, [F.col("v")], "n", {"run": F.col("one")}).collect()
    assert sorted((r.v, r.n, r.run) for r in got) == [(k, k, k + 1) for k in range(5000)]


def test_models_learn(spark, cliques):
    from meshwork.operators import learning

    g = PropertyGraph(cliques.nodes.where("id <> 'z'"), cliques.edges)
    x = g.nodes.select("id", F.array(*(F.when(F.col("id") == f"{s}1", 1.0).otherwise(0.0) for s in "ab"), F.lit(1.0)).alias("vector"))
    y = g.nodes.select("id", F.when(F.col("type") == "a", 0).otherwise(1).alias("label"))
    got = learning.train_gcn(g, x, y, 2, rounds=1, steps=400, rate=0.5).join(y, "id").collect()
    assert sum(r.predicted == r.label for r in got) >= 8
    t = g.edges.select(F.col("src").alias("head"), F.col("type").alias("rel"), F.col("dst").alias("tail"))
    ent = g.nodes.select("id", F.array(F.crc32(F.col("id").cast("binary")) / F.lit(2.0**32), F.lit(0.5)).alias("vector"))
    rel = spark.createDataFrame([("e", [0.1, 0.1])], "id string, vector array<double>")
    bad = vectors.corrupt(t)
    loss = lambda e, r: vectors.transe_loss(bad, e, r).agg(F.sum("loss")).first()[0]
    assert loss(*learning.transe_step(bad, ent, rel, rate=0.01)) < loss(ent, rel)
