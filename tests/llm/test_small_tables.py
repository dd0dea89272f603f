"""Tables of few rows are few files, however many partitions a shuffle has."""

import random

from meshwork.llm import simhash
from meshwork.operators import components
from meshwork.plans import scratch


def test_small_tables_of_the_components_are_one_file(spark, monkeypatch):
    rng, seen, real = random.Random(5), {}, scratch.cut

    def watched(df, name="table", *more):
        out = real(df, name, *more)
        seen.setdefault(name, []).append(len(out.inputFiles()))
        return out

    for module in (components, simhash):
        monkeypatch.setattr(module, "cut", watched)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join([*words[:-1], "other"])), (4 * i + 2, " ".join(words)), (4 * i + 3, " ".join(["other", *words[1:]]))]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    near = lambda a, b: (a ^ b).bit_count() <= 4
    fps = {k: simhash.fingerprint(t.encode().split()) for k, t in rows}
    least = {k: k for k in fps}
    for _ in range(4):
        least = {k: min(least[j] for j in fps if near(fps[j], fps[k])) for k in fps}
    assert {(r.doc_id, r.component_id) for r in got} == set(least.items())
    assert len(set(least.values())) < len(set(fps.values()))
    assert seen["least"] and all(seen[name] == [1] * len(seen[name]) for name in ("distinct", "least", "nodes", "roots", "names"))
    assert seen["edges"][1:] and set(seen["edges"][1:]) == {1}
