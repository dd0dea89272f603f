"""Operators on many documents, and the pipeline, against plain versions."""

import base64
import hashlib
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import decontaminate, mixing, quality, secrets, simhash, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(t, size=4):
    w = WORD.findall((t or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, size=4):
    fp = [plain_fingerprint(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, f"{fp[a]:016x}", least.get(find(a))) for a, (i, _) in enumerate(rows)]


def near_copies(seed=1):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(30):
        base = r.choices(vocab, k=r.randint(40, 200))
        for c in range(r.choice([1, 1, 2, 6])):
            v = list(base)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = r.choice(vocab)
            rows.append((g * 10 + c, " ".join(v)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one TWO"), (905, "x " * 20000), (7, "again"), (7, "again"), (None, "nobody knows"), (None, "again")]


def test_simhash_matches_all_pairs(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id bigint, text string, fp int, `key` string").repartition(3)
    got = [(x.doc_id, f"{x.fp & (2**64 - 1):016x}", x.component_id) for x in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(plain_components(rows), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    one = simhash.one_of_each(df)
    assert one.columns == df.columns
    assert one.count() == len({c for _, _, c in plain_components(rows)})


@pytest.mark.parametrize("hot", [2, 20_000])
def test_links_lose_no_pair_even_in_tiles(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [base]
    for flips in (1, 2, 3, 4, 5):
        x = base.copy()
        for k in range(len(x)):
            for b in rng.choice(64, flips, replace=False):
                x[k] ^= np.uint64(1 << int(b))
        fps.append(x)
    fps = np.unique(np.concatenate(fps))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    got = simhash.links(df, hot=hot).collect()
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in got:
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 4
        root[find(u)] = find(v)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    for a, b in zip(*np.nonzero(near), strict=True):
        assert find(int(fps.view(np.int64)[a])) == find(int(fps.view(np.int64)[b]))


def test_both_sets_of_blocks_make_every_pair_meet():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[k] ^= np.uint64(1 << int(b))
    for blocks in (simhash.BLOCKS, simhash.LARGE_BLOCKS):
        r, k, h = simhash.anchors(np.concatenate([x, y]), blocks)
        homes = {}
        for row, key, home in zip(r.tolist(), k.tolist(), h.tolist(), strict=True):
            homes.setdefault(row, [set(), set()])[0 if home else 1].add(key)
        assert all(homes[i][0] & (homes[i + 300][0] | homes[i + 300][1]) for i in range(300))


PAGES = [(1, "http://a/é b\n", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "u", "<p>x</p>"), (4, "u", None), (8, "u", ""), (9, "u", "z" * 300000), (None, "u", "<p>x</p>"), (7, "u", "tie"), (7, "u", "tie"), (2, "u", "WARC/1.1\r\n\r\n"), (None, "u", "lone")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(i, u, h, "c", b"c") for i, u, h in PAGES], "page_id bigint, url string, html string, same string, content binary").repartition(2)
    got = sorted((tuple(r) for r in warc.read_archives(warc.write_archives(df)).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        ids = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        first = max(ids, default=None)
        again = first is not None and i != first
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(df, min_bytes=9)).where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_files_and_faults(spark, tmp_path):
    import zstandard as zstd

    payload = [f"<p>page {k} of a site</p>".encode() * 9 for k in range(40)]
    records = [warc.record(k, "http://x/", p, len(p), warc.digest_of(p), None, False) for k, p in enumerate(payload)]
    data = warc.pack(records)
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE and struct.unpack_from("<I", data, 4)[0] > 0
    (tmp_path / "a.warc.zst").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r.page_id for r in warc.read_archives(files).collect()) == list(range(40))
    trained = zstd.train_dictionary(4096, records)
    press = zstd.ZstdCompressor(dict_data=trained)
    bare = struct.pack("<II", warc.SKIPPABLE, len(trained.as_bytes())) + trained.as_bytes() + b"".join(map(press.compress, records))
    assert list(warc.frames(bare)) == records
    for bad in (data[:-3], data[:6], b"junk" + data, data[:8] + b"xxxx" + data[12:]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"HTTP/1.1"), records[0].replace(b"page 0", b"page X"), records[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)


def test_pipeline_matches_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    led = quality.with_ledger(spark.read.parquet(f"{d}/documents.parquet"))
    good = {r[0] for r in led.where(F.col(led.columns[-1])["fail_bits"] == 0).select("doc_id").collect()}
    docs = [r for r in docs if r[0] in good]
    from test_documents import hit_words
    from test_nearcopies import plain

    stay = set(plain([(r[0], r[1]) for r in docs])[0])
    docs = [r for r in docs if r[0] in stay]

    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [r for r in docs if not hit_words(r[1], items)[4]]
    ranks = secrets._ranks(secrets.VOCABULARY)
    clean = {}
    for r in docs:
        t = secrets.redact_text(r[1], ranks, secrets.SPLIT, secrets.MAX_RATIO, "[secret]")
        clean[r[0]] = (r[0], t, r[2], r[3], len(t) if t != r[1] else r[4])
    mixed = mixing.mixed(spark.createDataFrame(list(clean.values()), "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    want = sorted(clean[r.doc_id] + (k,) for r in mixed.collect() for k in range(r[mixed.columns[-1]].copies))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "text", "lang", "source", "n_chars", "copy").collect())
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_stages_take_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g h i j k l", None, "s", 23), (None, "a b c d e f g h i j k l", None, "s", 23), (3, "q w e r t y u i o p a s d f", "en", None, 27), (3, "q w e r t y u i o p a s d f", "en", None, 27)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data, left in ((rows, 0), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.count()
    long = "word" + "".join(f" more{k % 977}" for k in range(40000))
    wide = spark.createDataFrame([(1, long, "en", "s", 1, 2, "k", 3), (2, long + " end", "en", "s", 1, 2, "k", 3)], schema + ", `__hash` int, word string, size int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, wide, "/root/testdata/sf0.001")
        assert out.columns[: len(wide.columns)] == wide.columns and out.count() >= (1 if name == "SimHash near-dedup" else 2), name
    one = simhash.one_of_each(spark.createDataFrame(rows, schema), size=5)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "3", "None"]
