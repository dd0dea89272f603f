"""Trained models and searches as queries; SQL has no form for them. Importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.catalogue import query
from meshwork.graph import PropertyGraph
from meshwork.operators import communities, learning, spectral, walks
from meshwork.plans import kg
from meshwork.plans.kg import read
from meshwork.plans.scratch import cut


def _labelled(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _held(kind):
    def run(spark, d):
        v = _labelled(spark, d)
        return learning.classifier(kind, v.where("id % 4 <> 0"), v.where("id % 4 = 0"))

    return run


query(name="logistic_held_out")(_held("logistic"))
query(name="perceptron_held_out")(_held("mlp"))


@query()
def word2vec(spark, d):
    return learning.word2vec(kg.user_walks(spark, d).select(F.col("walk_id").alias("doc"), "tokens"), dim=16)


@query()
def sgns_trained(spark, d):
    """Skip-gram with negative samples over all users' event types."""
    return learning.sgns(kg.user_walks(spark, d).select(F.col("walk_id").alias("doc"), "tokens"), dim=16, epochs=5)[0]


def _geography(spark, d):
    g = kg.both_ways(kg.geography(spark, d))
    return PropertyGraph(kg.nodes(spark, d).where("type <> 'part'"), g)


@query()
def gcn_trained(spark, d):
    """Node types from one-hot regions and degrees on the geographic graph, trained on four fifths of the nodes."""
    g = _geography(spark, d)
    x = g.degrees().select("id", F.array(F.lit(1.0), F.log1p(F.col("degree").cast("double")), F.log1p("weighted")).alias("vector"))
    y = g.nodes.select("id", F.when(F.col("type") == "nation", 1).when(F.col("type") == "region", 2).otherwise(0).alias("label"))
    return learning.train_gcn(g, x, y.where(F.crc32(F.col("id").cast("binary")) % 5 != 0), 3, rounds=2, steps=20)


def _label_graph(spark, d):
    """The labels of the whole graph, linked both ways by the weight of all edges between their nodes: one connected part."""
    lab = kg.nodes(spark, d).select("id", "label")
    e = kg.edges(spark, d).join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    e = e.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")).select("src", "dst", F.lit("between").alias("type"), "weight")
    return PropertyGraph(lab.select(F.col("label").alias("id"), F.lit("label").alias("type"), "label").distinct(), cut(kg.both_ways(e), "labels"))


@query()
def fiedler(spark, d):
    g = _label_graph(spark, d)
    return spectral.fiedler(g)


@query()
def spectral_embedding(spark, d):
    g = _label_graph(spark, d)
    return spectral.smallest(g, 4)


@query()
def spectral_clusters(spark, d):
    g = _label_graph(spark, d)
    return spectral.spectral_clusters(g, 5)


@query()
def one_pass_movers(spark, d):
    """Each node's best move from its own cluster, over edges of weight 1."""
    e = kg.both_ways(kg.geography(spark, d)).where("weight = 1")
    ids = e.select(F.col("src").alias("id")).distinct()
    return communities.best_moves(communities.move_gains(e, ids.select("id", F.col("id").alias("cluster"))))


@query()
def transition_em(spark, d):
    e = kg.both_ways(kg.geography(spark, d)).withColumn("edge_id", F.concat_ws(">", "src", "dst")).withColumn("type", F.concat_ws("_", "type", F.when(F.col("src") < F.col("dst"), "up").otherwise("down")))
    return walks.em_transitions(e, rounds=2)


@query()
def transe_trained(spark, d):
    t = kg.geography(spark, d).select(F.col("src").alias("head"), F.col("type").alias("rel"), F.col("dst").alias("tail"))
    from meshwork.functions.scalars import uniform

    vec = lambda ids: ids.select("id", F.array(*(uniform(F.lit("vec"), F.col("id"), F.lit(k)) for k in range(4))).alias("vector"))
    ent = vec(t.select(F.col("head").alias("id")).union(t.select("tail")).distinct())
    rel = vec(t.select(F.col("rel").alias("id")).distinct())
    return learning.transe(t, ent, rel)[0]


@query()
def relational_layer(spark, d):
    import numpy as np

    g = _geography(spark, d)
    x = g.degrees().select("id", F.array(F.lit(1.0), F.col("degree").cast("double")).alias("vector"))
    return learning.relational_layer(g, x, [np.eye(2), np.ones((2, 2))], {"in_nation": [1.0, 0.5], "in_region": [0.5, 1.0]})
