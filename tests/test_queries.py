"""Queries of the catalogue against DuckDB at the smallest scale; one of each kind, to keep the run short."""

import duckdb
import pytest

import __spark_entry__
from meshwork import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["degree", "meta_schema", "propagation", "quotient_graph", "inverse_cdf", "delta_modularity", "cc", "lca", "pagerank_10", "walk_node2vec", "transition_spearman", "context_pairs", "triple_split", "minibatches", "analogy_samples", "transe_loss"]


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    got = catalogue.QUERIES[name](spark, D)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
