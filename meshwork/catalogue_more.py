"""Further queries: preparation of fields, walk drivers, schema matrices, skip-gram and triple training. Importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwork.catalogue import _s, query
from meshwork.catalogue_sequences import _ANDY, _EMB, _PLAIN, _second_order_sql, _vec, _walk_sql  # noqa: F401
from meshwork.functions import scalars as fn
from meshwork.functions.scalars import snap
from meshwork.graph import PropertyGraph, commuting_matrix, schema_matrix
from meshwork.operators import communities, corpus, learning, vectors, walks
from meshwork.plans import kg
from meshwork.plans.kg import read


@query("SELECT p_partkey, replace(p_type, ' ', '_') AS name FROM part")
def spaces_to_underscores(spark, d):
    return read(spark, d, "part").select("p_partkey", fn.underscored(F.col("p_type")).alias("name"))


@query("SELECT page_id, 'http://example.org/' || page_id AS uri, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare FROM pages")
def uri_prefixes(spark, d):
    return read(spark, d, "pages").select("page_id", fn.with_prefix(F.col("page_id").cast("string"), "http://example.org/").alias("uri"), fn.without_prefix(F.col("url"), "https://").alias("bare"))


@query("SELECT p_partkey, unnest(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS value FROM part")
def split_values(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(fn.values_of(F.col("p_type"))).alias("value"))


@query("SELECT doc_id, toxic AS in_test, 1 - quality AS negative, (1 - quality) + 2 * toxic AS flag FROM labels")
def flag_decode(spark, d):
    flags = read(spark, d, "labels").select("doc_id", ((1 - F.col("quality")) + 2 * F.col("toxic")).alias("flag"))
    negative, in_test = fn.decoded_flag(F.col("flag"))
    return flags.select("doc_id", in_test.alias("in_test"), negative.alias("negative"), "flag")


@query("WITH r AS (SELECT DISTINCT c_mktsegment AS cluster, c_custkey AS ref, o_orderpriority AS token FROM customer LEFT JOIN orders ON o_custkey = c_custkey), n AS (SELECT cluster, count(DISTINCT ref) AS refs FROM r GROUP BY cluster), t AS (SELECT r.cluster, count(*)::DOUBLE / any_value(refs) AS p FROM r JOIN n ON r.cluster = n.cluster WHERE token IS NOT NULL GROUP BY r.cluster, token), h AS (SELECT cluster, sum(-p * log2(p)) AS h, count(*) AS k FROM t GROUP BY cluster) SELECT floor(avg(CASE WHEN refs > 1 AND k IS NOT NULL THEN 1 - h / (-k * (1.0 / refs) * log2(1.0::DOUBLE / refs)) ELSE 1 END) * 1e4 + 0.5) / 1e4 AS quality FROM n LEFT JOIN h ON n.cluster = h.cluster")
def mean_cluster_quality(spark, d):
    c = read(spark, d, "customer").select("c_mktsegment", "c_custkey")
    r = c.join(read(spark, d, "orders").select("o_custkey", "o_orderpriority"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return communities.mean_quality(r.select(F.col("c_mktsegment").alias("cluster"), F.col("c_custkey").alias("ref"), F.col("o_orderpriority").alias("token")))


@query(_EMB + f", x AS (SELECT 'EDGE_' || label AS token, unnest(range(1, 65)) AS i, unnest(e) AS x FROM v), m AS (SELECT token, i, {_s('avg(x)')} AS x FROM x GROUP BY ALL) SELECT token, list(x ORDER BY i) AS vector FROM m GROUP BY token")
def edge_token_means(spark, d):
    v = _vec(spark, d).select(fn.edge_token(F.col("label")).alias("token"), F.col("e").alias("vector"))
    return vectors.mean_by(v, "token").select("token", F.transform("vector", snap).alias("vector"))


@query(_EMB + ", s AS (SELECT q.label AS section, q.vec_id AS a, q.vec_id + 1 AS b, q.vec_id + 2 AS c, q.vec_id + 3 AS expected FROM v q WHERE q.vec_id % 20 = 0), t AS (SELECT s.*, list_transform(range(1, 65), lambda i: y.e[i] + z.e[i] - x.e[i]) AS t FROM s JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b JOIN v z ON z.vec_id = c), r AS (SELECT a, expected, vec_id, row_number() OVER (PARTITION BY a ORDER BY list_dot_product(t, e) / (sqrt(list_dot_product(t, t)) * sqrt(list_dot_product(e, e))) DESC, vec_id) AS k FROM t, v WHERE vec_id NOT IN (a, b, c)) SELECT section, count(*) AS n, count(r.a) AS \"right\", count(r.a) / count(*) AS accuracy FROM s LEFT JOIN r ON r.a = s.a AND r.k = 1 AND r.vec_id = s.expected GROUP BY section")
def analogy_accuracy(spark, d):
    v = _vec(spark, d).select(F.col("vec_id").alias("word"), F.col("e").alias("vector"), F.col("label").alias("section"))
    q = v.where("word % 20 = 0").select("section", F.col("word").alias("a"), (F.col("word") + 1).alias("b"), (F.col("word") + 2).alias("c"), (F.col("word") + 3).alias("expected"))
    return corpus.analogy_accuracy(v.select("word", "vector"), q)


# --- walks -----------------------------------------------------------------------------------------------------

_EVERY = _walk_sql(4, _PLAIN).replace("w0 AS (SELECT id || '#0' AS walk_id, [id] AS tokens FROM kg_nodes WHERE type IN ('nation', 'supplier'))", "{start}")


@query(_EVERY.replace("{start}", "w0 AS (SELECT id || '#' || k AS walk_id, [id] AS tokens FROM (SELECT n.id, unnest(range(0, greatest(coalesce(g.k, 0), 1))) AS k FROM kg_nodes n LEFT JOIN (SELECT dst AS id, count(DISTINCT src) AS k FROM sym GROUP BY dst) g ON g.id = n.id WHERE n.type IN ('nation', 'region')))") + " SELECT walk_id, tokens FROM w3")
def walk_by_degree(spark, d):
    """As many walks from a node as it has neighbours, one at least."""
    g = PropertyGraph(kg.nodes(spark, d), kg.both_ways(kg.geography(spark, d)))
    some = g.nodes.where("type IN ('nation', 'region')").select("id")
    return walks.walk(g.edges, walks.degree_starts(g.degrees().join(some, "id", "left_semi")), 4)


@query(_EVERY.replace("{start}", "w0 AS (SELECT id || '#0' AS walk_id, [id] AS tokens FROM kg_nodes WHERE type <> 'part')") + " SELECT walk_id, tokens[2:] AS tokens FROM w3")
def walk_without_start(spark, d):
    """Walks of fixed length from every node of the geographic graph, the start left out: what neighbour sampling takes as positives."""
    start = walks.start_walks(kg.nodes(spark, d).where("type <> 'part'"))
    return walks.without_start(walks.walk(kg.both_ways(kg.geography(spark, d)), start, 4))


@query(_second_order_sql(0.5, 2.0, 4).replace("w0 AS (SELECT id || '#0' AS walk_id, [id] AS tokens, NULL::VARCHAR AS last FROM kg_nodes WHERE type IN ('nation', 'supplier'))", "w0 AS (SELECT id || '#' || k AS walk_id, [id] AS tokens, NULL::VARCHAR AS last FROM (SELECT id, unnest(range(0, 2)) AS k FROM kg_nodes WHERE type <> 'customer'))") + " WHERE len(tokens) >= 4")
def walk_driver(spark, d):
    """Two walks a node, the short ones dropped; parts have no edge here and so no walk."""
    nodes = kg.nodes(spark, d).where("type <> 'customer'")
    return walks.simulate(kg.both_ways(kg.geography(spark, d)), nodes, 2, 4, 0.5, 2.0)


@query("WITH g AS (SELECT dst AS id, count(DISTINCT src) AS k FROM sym GROUP BY dst), t AS (SELECT src, dst, count(*)::DOUBLE / k AS v FROM sym JOIN g ON g.id = src GROUP BY src, dst, k), p0 AS (SELECT id AS walk_id, id, 1.0::DOUBLE AS p FROM kg_nodes WHERE type = 'nation'), p1 AS (SELECT walk_id, t.src AS id, sum(p * v) AS p FROM p0 JOIN t ON t.dst = p0.id GROUP BY ALL), p2 AS (SELECT walk_id, t.src AS id, sum(p * v) AS p FROM p1 JOIN t ON t.dst = p1.id GROUP BY ALL), o AS (SELECT 1 AS step, walk_id, id, floor(p * 1e9 + 0.5) AS s FROM p1 UNION ALL SELECT 2, walk_id, id, floor(p * 1e9 + 0.5) FROM p2) SELECT walk_id, step, min(id) AS id FROM (SELECT *, max(s) OVER (PARTITION BY walk_id, step) AS m FROM o) WHERE s = m GROUP BY ALL")
def walk_spectral(spark, d):
    """The likeliest node after each step of p <- T p, a batch of starts at once."""
    g = PropertyGraph(kg.nodes(spark, d), kg.both_ways(kg.geography(spark, d)))
    return walks.markov(g.edges, g.nodes.where("type = 'nation'").select("id"), g.degrees(), 2, restart=0.0)


# --- schema matrices -------------------------------------------------------------------------------------------

_SCHEMA = "WITH i AS (SELECT src, dst, weight FROM geo WHERE type = 'in_nation'), r AS (SELECT src, dst, weight FROM geo WHERE type = 'in_region'), m AS (SELECT i.src, r.dst, sum(i.weight * r.weight) AS value FROM i JOIN r ON i.dst = r.src GROUP BY ALL UNION ALL SELECT a.src, b.src, sum(a.weight * b.weight) FROM r a JOIN r b ON a.dst = b.dst GROUP BY ALL), s AS (SELECT src, dst, sum(value)::DOUBLE AS value FROM m GROUP BY ALL)"


def _metapaths(spark, d):
    g = kg.geography(spark, d)
    step = lambda t: g.where(F.col("type") == t).select("src", "dst", F.col("weight").alias("value"))
    back = step("in_region").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
    return [[step("in_nation"), step("in_region")], [step("in_region"), back]]


@query(_SCHEMA + " SELECT src, dst, value FROM s")
def metapath_schema(spark, d):
    """The sum of the metapaths' commuting matrices."""
    return schema_matrix(_metapaths(spark, d))


@query(_SCHEMA + ", l AS (SELECT src, src AS dst, sum(value) AS value FROM s GROUP BY src UNION ALL SELECT src, dst, -value FROM s) SELECT src, dst, sum(value) AS value FROM l GROUP BY src, dst HAVING sum(value) <> 0")
def metapath_schema_laplacian(spark, d):
    return schema_matrix(_metapaths(spark, d), laplacian=True)


# --- one step of training --------------------------------------------------------------------------------------

_HASHED = "list_transform(range(0, 4), lambda k: ('0x' || substr(md5('{0}|' || id || '|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"WITH t AS (SELECT walk_id AS doc, unnest(range(0, len(tokens))) AS i, unnest(tokens) AS w FROM user_walks), ex AS (SELECT a.w AS center, b.w AS word, 1 AS y, count(*)::DOUBLE AS n FROM t a JOIN t b ON a.doc = b.doc AND abs(a.i - b.i) = 1 GROUP BY ALL UNION ALL SELECT DISTINCT w, w, 0, 100.0 FROM t), ids AS (SELECT DISTINCT w AS id FROM t), iv AS (SELECT id, {_HASHED.format('in')} AS v FROM ids), ov AS (SELECT id, {_HASHED.format('out')} AS v FROM ids), x AS (SELECT center, word, n, i.v AS vi, o.v AS vo, (1 / (1 + exp(-list_dot_product(i.v, o.v))) - y) * n AS g FROM ex JOIN iv i ON i.id = center JOIN ov o ON o.id = word), gi AS (SELECT center AS id, k, sum(g * vo[k]) / sum(n) AS d FROM x, (SELECT unnest(range(1, 5)) AS k) GROUP BY ALL), go AS (SELECT word AS id, k, sum(g * vi[k]) / sum(n) AS d FROM x, (SELECT unnest(range(1, 5)) AS k) GROUP BY ALL), a AS (SELECT iv.id, list({_s('v[k] - 0.5 * d')} ORDER BY k) AS inner FROM iv JOIN gi ON gi.id = iv.id GROUP BY iv.id), b AS (SELECT ov.id, list({_s('v[k] - 0.5 * d')} ORDER BY k) AS outer FROM ov JOIN go ON go.id = ov.id GROUP BY ov.id) SELECT a.id, a.inner AS inner_vector, b.outer AS outer_vector FROM a JOIN b ON a.id = b.id".replace("AS inner FROM", "AS inn FROM").replace("AS outer FROM", "AS outr FROM").replace("a.inner AS", "a.inn AS").replace("b.outer AS", "b.outr AS"))
def sgns_step(spark, d):
    """One step over the neighbours in all users' event types, each type drawn a hundred times beside itself."""
    docs = kg.user_walks(spark, d).withColumnRenamed("walk_id", "doc")
    seen = corpus.context_pairs(docs, 3).groupBy("center", F.col("context").alias("word")).agg(F.count("*").cast("double").alias("n"))
    ids = docs.select(F.explode("tokens").alias("id")).distinct()
    examples = seen.select("center", "word", F.lit(1).alias("y"), "n").union(ids.select("id", "id", F.lit(0), F.lit(100.0)))
    start = lambda kind: ids.select("id", F.array(*(fn.uniform(F.lit(kind), F.col("id"), F.lit(k)) for k in range(4))).alias("vector"))
    a, b, _ = learning.sgns_step(examples, start("in"), start("out"), 0.5)
    return a.join(b.withColumnRenamed("vector", "o"), "id").select("id", F.transform("vector", snap).alias("inner_vector"), F.transform("o", snap).alias("outer_vector"))
