"""Repeated word sequences and byte strings against plain searches."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from meshwork.llm import bytespans, repeats, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, KEY string, mark int"


def words_kept(rows):
    order = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for i, t in order:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                gone.update(range(s, s + 20))
            seen.add(g)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def bytes_kept(rows, n=200):
    at = defaultdict(set)
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            at[b[s : s + n]].add((i, s))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if len(at[b[s : s + n]]) > 1:
                gone[s : s + n] = True
        keep = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), keep)
    return out


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    passages = [text(60) for _ in range(4)] + [text(20), text(19), "x" * 600, "ab" * 300]
    docs = []
    for i in range(120):
        parts = [text(r.randint(0, 60)) for _ in range(r.randint(0, 3))]
        if r.random() < 0.6:
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        if r.random() < 0.1:
            parts += parts
        docs.append((i, "\n".join(parts)))
    docs += [(200 + k, docs[5][1]) for k in range(6)] + [(300, None), (301, ""), (302, " \n"), (303, "x y z"), (304, "z " * 400), (305, "z " * 400)]
    near = docs[7][1].split(" ")
    for k in range(5):
        v = list(near)
        if v:
            v[r.randrange(len(v))] = "changed"
        docs.append((400 + k, " ".join(v)))
    return docs


@pytest.mark.parametrize("room", [3, 200_000])
def test_words_match_a_plain_search(spark, room):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substrings.without_repeats(df, room=room).collect()}
    assert got == words_kept(rows)


@pytest.mark.parametrize("room", [3, 200_000])
def test_bytes_match_a_plain_search(spark, room):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bytespans.without_repeats(df, room=room).collect()}
    assert got == bytes_kept(rows)


def test_null_keys_repeated_rows_and_empty_tables(spark):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(None, t, "k", 1), (1, t, "k", 1), (1, t, "k", 1), (2, t + " end", "k", 1), (3, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.without_repeats(df).collect()), key=str)
    assert got == sorted([(None, 0), (1, 40), (1, 40), (2, 40), (3, 0)], key=str)
    alone = spark.createDataFrame([(1, "q" * 150 + "r" * 90, "k", 1)] * 2, SCHEMA)
    assert [r.n_removed for r in bytespans.without_repeats(alone).collect()] == [0, 0]
    none = spark.createDataFrame([], SCHEMA)
    assert substrings.without_repeats(none).count() == 0 and bytespans.without_repeats(none).count() == 0


def test_texts_longer_than_a_stretch(spark, monkeypatch):
    r = random.Random(1)
    half = "".join(r.choices("abcdefgh", k=3000))
    rows = [(1, half + "-" + half), (2, "".join(r.choices("abcdefgh", k=5000)))]
    values = bytespans.byte_tokens()
    monkeypatch.setattr(repeats, "STRETCH", 512)
    found = defaultdict(list)
    for v, doc, number in repeats._stretches(enumerate(t.encode() for _, t in rows), values, bytespans.SHAPE):
        a, c, first, n = repeats.units(v, doc, bytespans.SHAPE)
        for k in range(len(a)):
            found[int(doc[first[k]])] += range(number[first[k]], number[first[k]] + n[k])
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(len(t) - 199)) for k, (_, t) in enumerate(rows)}
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)
    got = {x.doc_id: hashlib.sha256(bytes(x.kept)).hexdigest() for x in bytespans.without_repeats(df).collect()}
    assert got == {k: hashlib.sha256(v[3]).hexdigest() for k, v in bytes_kept(rows).items()}


@pytest.mark.parametrize("room", [1, 2_000])
def test_windows_that_differ_only_at_the_end_stay(spark, room):
    """Some 300,000 windows with three common quarters and another last one: no digest of a quarter may tell them apart wrongly."""
    common, r = "c" * 150, random.Random(9)
    ends = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=50)) for _ in range(300_000 if room > 1 else 3_000)]
    rows = [(i, common + e) for i, e in enumerate(ends)] + [(len(ends), common + ends[7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {x.doc_id for x in bytespans.without_repeats(df, room=room).where("n_removed > 0").collect()}
    assert got == {7, len(ends)}
    start = " ".join(f"w{k}" for k in range(15))
    rows = [(i, f"{start} {' '.join(e[k : k + 10] for k in range(0, 50, 10))}") for i, e in enumerate(ends[: len(ends) // 10])]
    df = spark.createDataFrame(rows + [(10**6, rows[3][1])], "doc_id bigint, text string").repartition(8)
    assert [x.doc_id for x in substrings.without_repeats(df, room=room).where("n_removed > 0").collect()] == [10**6]


def test_keys_that_are_no_numbers(spark):
    t = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([("b", t), ("a", t), (None, "x"), ("c", "y")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substrings.without_repeats(df).collect()} == {"a": 0, "b": 60, None: 0, "c": 0}
    assert {r.doc_id: r.n_removed for r in bytespans.without_repeats(df).collect()} == {"a": len(t), "b": len(t), None: 0, "c": 0}


def test_trees_have_a_node_where_suffixes_part():
    tokens = np.array([[0, 1, 1], [0, 1, 2], [0, 1, 2], [0, 3, 3], [4, 4, 4]])
    tree = substrings.Forest.grow(tokens, (np.arange(5),))
    assert sorted(zip(tree.depth.tolist(), tree.low.tolist(), tree.high.tolist(), strict=True)) == [(1, 0, 4), (2, 0, 3), (3, 1, 3)]
