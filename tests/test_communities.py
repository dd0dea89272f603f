"""Bipartite communities against a plain round, with both sides of the broadcast bound."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from meshwork.operators import communities


def _side(links, comm, totals, m):
    out, degree = {}, Counter(a for a, _ in links)
    least = min((big, c) for c, big in totals.items())
    for node in degree:
        n = Counter(comm[b] for a, b in links if a == node)
        scores = [(totals[c] * degree[node] / m - k, c) for c, k in n.items()] + [(least[0] * degree[node] / m, least[1])]
        out[node] = min(scores)[1]
    return out


def _plain(pairs, rounds):
    m, docs = float(len(pairs)), {d: d for d, _ in pairs}
    names = set(docs.values())

    def totals(comm, side):
        t = defaultdict(int, dict.fromkeys(names, 0))
        for p in pairs:
            t[comm[p[side]]] += 1
        return t

    for _ in range(rounds):
        words = _side([(w, d) for d, w in pairs], docs, totals(docs, 0), m)
        docs = _side(list(pairs), words, totals(words, 1), m)
    return docs


@pytest.mark.parametrize("room", [400_000, 7])
@pytest.mark.parametrize("rounds", [1, 2])
def test_brim_rounds_agree_with_a_plain_version(spark, monkeypatch, room, rounds):
    monkeypatch.setattr(communities, "BROADCAST_ROWS", room)
    rnd = random.Random(5)
    pairs = sorted({(rnd.randrange(12), "w" * 70 if rnd.random() < 0.05 else f"w{min(rnd.randrange(40), rnd.randrange(40))}") for _ in range(120)})
    got = communities.brim(spark.createDataFrame(pairs + pairs[:9], "doc bigint, word string"), None, rounds=rounds, fixed=True, measured=False)[0]
    assert {r.doc: r.c for r in got.collect()} == _plain(pairs, rounds)
