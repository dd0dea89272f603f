"""Documents of similar five-word shingles against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import nearcopies


def sets(t):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    """Ids that stay, and the number of similar pairs, by all pairs."""
    s, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a in range(len(rows)):
        for b in range(a):
            if s[a] == s[b] or 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                pairs += s[a] != s[b]
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted(least.values()), pairs


def near_copies():
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    licence = " ".join(r.choices(vocab, k=40))
    rows = []
    for words, edits in ((100, 1), (60, 1), (100, 2), (200, 4), (400, 8), (400, 2), (100, 3), (9, 1), (14, 1)):
        for _ in range(12):
            base = r.choices(vocab, k=words)
            v = list(base)
            for at in r.sample(range(words), edits):
                v[at] = "new" + r.choice(vocab)
            rows += [" ".join(base), " ".join(v)]
    crowd = r.choices(vocab, k=120)
    for _ in range(60):
        v = list(crowd)
        for at in r.sample(range(120), 2):
            v[at] = r.choice(vocab)
        rows.append(" ".join(v))
    rows += [" ".join(r.choices(vocab, k=25)) + " " + licence for _ in range(40)] + ["", None, " \t", "One two", "one TWO", "x " * 900, "x " * 400] + rows[:5]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("few", [0, 2, 10**6])
def test_near_dedup_stage_links_all_pairs_of_four_fifths(spark, few, monkeypatch):
    monkeypatch.setattr(nearcopies, "FEW", few)
    rows = near_copies()
    want, pairs = plain(rows)
    assert pairs > 100
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, `__key` string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == want


def test_shingles_of_real_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") < 2500).limit(250).select("doc_id", "text")
    rows = [tuple(x) for x in d.collect()]
    got = nearcopies.one_of_each(spark.createDataFrame(rows, d.schema))
    assert sorted(x.doc_id for x in got.collect()) == plain(rows)[0]


def test_tables_of_the_stage_take_less_than_the_texts(spark, monkeypatch):
    r, sizes, real = random.Random(7), {}, nearcopies.cut
    vocab = [f"word{k}" for k in range(3000)]

    def cut(df, name="table"):
        out = real(df, name)
        sizes[name] = sizes.get(name, 0) + sum(spark.read.format("binaryFile").load(f).select("length").first()[0] for f in out.inputFiles())
        return out

    monkeypatch.setattr(nearcopies, "cut", cut)
    rows = [(i, " ".join(r.choices(vocab, k=3000))) for i in range(60)]
    rows += [(60 + i, t + " tail") for i, t in rows]
    got = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    assert sorted(x.doc_id for x in got.collect()) == list(range(60))
    assert sizes["heads"] < sum(len(t) for _, t in rows)
    assert sum(v for k, v in sizes.items() if k != "heads") < sum(len(t) for _, t in rows)


def test_a_group_of_loose_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    r, asked, real = random.Random(11), [], nearcopies._similar
    crowd = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(240):
        v = list(crowd)
        for at in r.sample(range(150), 1 + i % 6):
            v[at] = f"new{i}x{at}"
        rows.append((i, " ".join(v)))
    want, pairs = plain(rows)
    assert 20 < len(want) < 200 and pairs > 1000
    monkeypatch.setattr(nearcopies, "_similar", lambda p, *rest: (asked.append(p.count()), real(p, *rest))[1])
    got = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted(x.doc_id for x in got.collect()) == want
    assert sum(asked) < 12 * len(rows)  # of 28,680 pairs
