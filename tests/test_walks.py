"""Walks do not depend on how neighbours are packed into lists, nor on which plan a previous node's links take."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions import digests
from meshwork.operators import walks


@pytest.fixture()
def hub(spark):
    e = [("h", f"n{i}", "ab"[i % 2], 1.0 + i % 3) for i in range(40)] + [(f"n{i}", f"n{(i * 7 + 1) % 40}", "c", 1.0) for i in range(40)] + [("dead", "end", "a", 1.0)]
    return spark.createDataFrame([x for a, b, t, w in e for x in ((a, b, t, w), (b, a, t, w))][:-1], "src string, dst string, type string, weight double")


def _start(spark):
    return walks.start_walks(spark.createDataFrame([("h",), ("n3",), ("n4",), ("dead",), ("lost",)], "id string"), 3)


def _rows(df):
    return sorted(map(tuple, (tuple((r.walk_id, tuple(r.tokens))) for r in df.collect())))


@pytest.mark.parametrize("weighted", [False, True])
def test_walks_with_short_lists_and_crowds(spark, hub, monkeypatch, weighted):
    whole = _rows(walks.walk(hub, _start(spark), 5, weighted=weighted))
    monkeypatch.setattr(walks, "ROOM", 3)
    monkeypatch.setattr(walks, "CROWD", 1)
    assert _rows(walks.walk(hub, _start(spark), 5, weighted=weighted)) == whole
    pairs = {(r.src, r.dst) for r in hub.collect()}
    assert len(whole) == 15 and all((a, b) in pairs for _, t in whole for a, b in zip(t, t[1:]))
    assert {len(t) for w, t in whole if w.startswith(("lost", "dead"))} == {1, 2}


@pytest.mark.parametrize("p,q", [(0.25, 4.0), (4.0, 0.25)])
def test_second_order_by_lists_and_by_joins(spark, hub, monkeypatch, p, q):
    lists = _rows(walks.second_order_walk(hub, _start(spark), 5, p, q))
    monkeypatch.setattr(walks, "FEW", 0)
    assert _rows(walks.second_order_walk(hub, _start(spark), 5, p, q)) == lists
    monkeypatch.setattr(walks, "FEW", 4)
    monkeypatch.setattr(walks, "ROOM", 5)
    assert _rows(walks.second_order_walk(hub, _start(spark), 5, p, q)) == lists


def test_transitions_by_maps_and_by_joins(spark, hub, monkeypatch):
    t = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("c", "c", 0.3), ("c", "a", 0.0), ("a", "a", 0.2)], "from_type string, to_type string, prob double")
    maps = _rows(walks.second_order_walk(hub, _start(spark), 5, 0.5, 2.0, transitions=t))
    monkeypatch.setattr(walks, "TYPES", 0)
    assert _rows(walks.second_order_walk(hub, _start(spark), 5, 0.5, 2.0, transitions=t)) == maps


def test_what_hashes_have_in_common_is_put_together_before_the_lists(spark, hub, monkeypatch):
    plans, real = [], walks.cut
    monkeypatch.setattr(walks, "cut", lambda df, name="table": (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    walks.walk(hub, _start(spark), 2)
    moved = [p for name, p in plans if name == "moved"]
    assert moved and all("concat(prefix" in p for p in moved)


@pytest.mark.parametrize("room,wide,crowd", [(1000, 1000, 1000), (3, 1000, 1000), (3, 5, 2)])
def test_uniform_walks_take_the_least_hash_at_hubs_too(spark, hub, monkeypatch, room, wide, crowd):
    plans, real = [], walks.cut
    monkeypatch.setattr(walks, "cut", lambda df, name="table": (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    monkeypatch.setattr(walks, "ROOM", room)
    monkeypatch.setattr(walks, "WIDE", wide)
    monkeypatch.setattr(walks, "CROWD", crowd)
    near = {}
    for r in hub.collect():
        near.setdefault(r.src, set()).add(r.dst)
    want = []
    for w, t in _rows(_start(spark)):
        t = list(t)
        for step in range(1, 5):
            if t[-1] in near and len(t) == step:
                t.append(min((hashlib.md5(f"walk|{w}|{step}|{x}".encode()).hexdigest(), x) for x in near[t[-1]] if x != t[-1])[1])
        want.append((w, tuple(t)))
    assert _rows(walks.walk(hub, _start(spark), 5)) == sorted(want)
    # the hub's tips are hashed by the kernel, many at once, and not one candidate after the other
    assert all(("MapInArrow" in p) == (room < 40) for name, p in plans if name == "moved")


def test_walks_over_numbers_take_the_least_hash(spark, monkeypatch):
    monkeypatch.setattr(walks, "ROOM", 3)
    edges = spark.createDataFrame([x for i in range(1, 30) for x in ((0, i, 1.0), (i, 0, 1.0))], "src long, dst long, weight double")
    got = walks.walk(edges, walks.start_walks(edges.select(F.col("src").alias("id")).distinct()), 3)
    assert got.schema["tokens"].dataType.simpleString() == "array<bigint>"
    for w, t in _rows(got):
        first = t[0] or int(min((hashlib.md5(f"walk|{w}|1|{x}".encode()).hexdigest(), x) for x in range(1, 30))[1])
        assert t[0] and t[2] == min((hashlib.md5(f"walk|{w}|2|{x}".encode()).hexdigest(), x) for x in range(1, 30))[1] or t == (0, first, 0)


def test_least_md5_of_heads_and_tails():
    rng = random.Random(3)
    for most, some in ((1, 1), (1, 300), (30, 1), (30, 300), (70, 900)):
        heads = [bytes(rng.choices(b"walkC0123#|\xc3", k=rng.choice([0, 3, 5, 17, 18, 40, 60]))) for _ in range(most)]
        tails = list({bytes(rng.choices(b"CSN0123456789\xe2", k=rng.choice([0, 1, 4, 6, 7, 7, 20]))) for _ in range(some)})
        r, t = digests.least_md5(heads, tails)
        assert [(x, tails[k]) for x, k in zip(r, t, strict=True)] == [min((hashlib.md5(h + x).hexdigest(), x) for x in tails) for h in heads]


def test_least_md5_in_tiles_that_do_not_divide_the_work(monkeypatch):
    monkeypatch.setattr(digests, "TILE", 96)
    monkeypatch.setattr(digests, "WIDE", 20)
    heads, tails = [f"walk|N12#{i}|1|".encode() for i in range(100, 123)], [f"C{i}".encode() for i in range(980, 1050)]
    r, t = digests.least_md5(heads, tails)
    assert [(x, tails[k]) for x, k in zip(r, t, strict=True)] == [min((hashlib.md5(h + x).hexdigest(), x) for x in tails) for h in heads]


def test_the_kernels_work_is_dealt_by_how_much_there_is(spark, hub, monkeypatch):
    pairs = hub.select("src", "dst").distinct().where("src = 'h'")
    tips = spark.range(30).select(F.concat(F.lit("w"), "id").alias("walk_id"), F.lit("h").alias("src"), F.lit("p").alias("prefix"))
    dealt = lambda: walks._Lists(pairs, ["src"], 10).crowds(tips, "walk_id", "prefix")._jdf.queryExecution().optimizedPlan().toString()
    assert "], 8" in dealt()  # four lists, one slice
    monkeypatch.setattr(walks, "CROWD", 3)
    assert "], 80" in dealt()  # ten slices
    monkeypatch.setattr(walks, "CROWD", 1)
    assert "], 128" in dealt()  # no more than 32 for each of the shuffle's
