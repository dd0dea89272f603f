"""SimHash fingerprints and their near-duplicate components by anchor-point covering.

A fingerprint's 64 bits are cut into blocks of 22, 21 and 21 bits. Two fingerprints at most four bits
apart are at most one bit apart in some block. In each block the words of a covering code are the
anchors: the direct sum of Hamming codes, which are perfect (every word is within one bit of a code
word of each summand). A fingerprint's home is its nearest anchor; it is also copied to each anchor
that lies within covering radius plus threshold in the way a neighbour's home can. Two fingerprints
with a block at most one bit apart therefore meet at the home of either, and are compared there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import fresh, table, utf8
from meshwork.operators.components import star_components
from meshwork.plans.scratch import cut

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Bits of each block: lengths of Hamming codes (2**r - 1), or below 0 bits taken as they are (all words a code of radius 0).
#: More plain bits make more and smaller groups for more copies: 15 bits name an anchor in the first set, 17 or 18 in the second.
BLOCKS = ((15, 7), (15, 3, -3), (15, 3, -3))
LARGE_BLOCKS = ((15, -7), (15, -6), (15, -6))
#: Distinct fingerprints above which the second set is used.
LARGE = 1 << 22
#: Fingerprints with one home anchor above which that anchor's comparisons are dealt to several tasks.
HOT = 20_000
_TILE = 4096


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the shingles of ``size`` words (of all words if they are fewer); 0 for none."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    cuts = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in cuts], np.uint64)
    return of_hashes(h)


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if it is in over half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key and fp (bigint holding the unsigned bits) per row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes.lower() and bytes.split() know ASCII only: A-Z, and the space and controls from tab to carriage return
            fps = np.fromiter((fingerprint(t.as_py().lower().split(), size) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), utf8(F.col(f"`{text}`")).alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


@lru_cache(maxsize=4)
def _code(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a summand: syndrome by word, the flip that leads home by syndrome, the other flips to visit by syndrome.

    For a Hamming code these are the masks with the word's syndrome, of weight one at most (home) and
    two (anchors that may be home to a neighbour at one bit's distance; a code word has none). For
    plain bits a word is its own home and visits the words at one bit's distance.
    """
    if n < 0:
        return np.zeros(1 << -n, np.uint8), np.zeros(1, np.uint64), np.array([[1 << i for i in range(-n)]], np.uint64)
    words = np.arange(1 << n, dtype=np.uint32)
    syndrome = np.zeros(1 << n, np.uint8)
    for i in range(n):
        syndrome ^= ((words >> i & 1) * (i + 1)).astype(np.uint8)
    by: list[list[int]] = [[] for _ in range(n + 1)]
    for m in [0] + [1 << i for i in range(n)] + [1 << i | 1 << j for i in range(n) for j in range(i)]:
        by[int(syndrome[m])].append(m)
    most = max(map(len, by)) - 1
    visits = [(x[1:] + [x[0]] * most)[:most] for x in by]  # the home again where there are fewer
    return syndrome, np.array([x[0] for x in by], np.uint64), np.array(visits, np.uint64)


def anchors(fp: np.ndarray, blocks: tuple[tuple[int, ...], ...] = BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``fp``, anchor (block number in the top bits), and whether it is the home, for every copy."""
    rows, keys, homes, shift = [], [], [], 0
    every = np.arange(len(fp))
    for b, parts in enumerate(blocks):
        home, tag, steps, at = np.zeros(len(fp), np.uint64), np.uint64(b << 32), [], 0
        for n in parts:
            syndrome, nearest, visits = _code(n)
            word = fp >> np.uint64(shift + at) & np.uint64((1 << abs(n)) - 1)
            s = syndrome[word.astype(np.int64)]
            home |= (word ^ nearest[s]) << np.uint64(at)
            steps += [(nearest[s] ^ visits[s, k]) << np.uint64(at) for k in range(visits.shape[1])]
            at += abs(n)
        rows.append(every)
        keys.append(home | tag)
        homes.append(np.ones(len(fp), bool))
        for step in steps:
            real = step != 0
            rows.append(every[real])
            keys.append((home ^ step)[real] | tag)
            homes.append(np.zeros(int(real.sum()), bool))
        shift += at
    assert shift == 64
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(a: np.ndarray, others: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links between ``a`` and ``others`` within ``max_bits`` that join what the earlier ones do not."""
    out: list[tuple[int, int]] = []
    nodes = label = None

    def top(k: np.ndarray) -> np.ndarray:
        up = label[k]
        while (label[up] != up).any():
            up = label[up]
        label[k] = up
        return up

    for i in range(0, len(a), 256):
        for j in range(0, len(others), _TILE):
            x, y = a[i : i + 256], others[j : j + _TILE]
            apart = np.bitwise_count(x[:, None] ^ y[None])
            near = (apart <= max_bits) & (apart > 0)
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            if nodes is None:
                nodes = np.unique(np.concatenate([a, others]))
                label = np.arange(len(nodes))
            own, theirs = np.searchsorted(nodes, x), np.searchsorted(nodes, y)
            for r in rows:
                met = np.flatnonzero(near[r])
                tops, where = np.unique(top(theirs[met]), return_index=True)
                mine = int(top(own[r : r + 1])[0])
                for t, w in zip(tops.tolist(), where.tolist(), strict=True):
                    if t != mine:
                        out.append((int(x[r]), int(y[met[w]])))
                        label[t] = mine
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that have the same components as all pairs within ``max_bits``.

    Every such pair is compared; of the pairs found at one anchor only a spanning forest is emitted,
    so a crowd of near copies costs as many rows as it has members. Where more than ``hot``
    fingerprints share a home, its members and visitors are dealt into n x n tiles for separate tasks.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the blocks guarantee meetings up to four bits only")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 15):
                part = fp[i : i + (1 << 15)]
                r, k, h = anchors(part, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(part[r].view(np.int64)), pa.array(h)], names=["anchor", "fp", "home"])

    blocks = LARGE_BLOCKS if prints.count() > LARGE else BLOCKS
    copies = prints.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home boolean")
    crowded = copies.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    crowded = cut(crowded.select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("tiles")), "crowded")
    tiles = F.coalesce("tiles", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    dealt = copies.join(crowded, "anchor", "left").select("anchor", "fp", "home", tiles.alias("n"), mine.alias("i"))
    # A home member meets every tile of the others, as one of the first side; everyone, as one of the second, meets every tile of homes.
    every = F.sequence(F.lit(0), F.col("n") - 1)
    first = dealt.where("home").select("anchor", "fp", F.lit(True).alias("first"), "n", "i", F.explode(every).alias("j"))
    second = dealt.select("anchor", "fp", F.lit(False).alias("first"), "n", F.explode(every).alias("i"), F.col("i").alias("j"))
    # Without crowds, one row a copy is enough: homes are on both sides.
    plain = crowded.limit(1).count() == 0
    tasks = copies.select("anchor", "fp", F.col("home").alias("first"), F.lit(0).alias("i"), F.lit(0).alias("j")) if plain else first.drop("n").unionByName(second.drop("n"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(rows: np.ndarray, lead: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, others = rows[lead], rows if plain else rows[~lead]
            if len(a) and len(others):
                found = forest(a, others, max_bits)
                if found:
                    uv = np.array(found, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], names=["u", "v"])

        last, keep, lead = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)], axis=1)
            fp = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            first = b.column(4).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)], strict=True):
                here = tuple(key[s].tolist())
                if here != last and last is not None:
                    yield from finished(np.concatenate(keep), np.concatenate(lead))
                    keep, lead = [], []
                last = here
                keep.append(fp[s:e])
                lead.append(first[s:e])
        if last is not None:
            yield from finished(np.concatenate(keep), np.concatenate(lead))

    by = ["anchor", "i", "j"]
    return tasks.repartition(*by).sortWithinPartitions(*by).select(*by, "fp", "first").mapInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """key, fp, component_id (least key among all documents reachable by links) and ``component`` (its least fp) per row.

    Equal fingerprints are one node, however many documents have them. Rows without words have
    fingerprint 0 and link like any other. A null key takes part but never names a component
    unless all keys of the component are null; then component_id is null.
    """
    rows = _components_of(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), size, max_bits)
    return rows.select(F.col("id").alias(key), "fp", "component_id", "component")


def _components_of(docs: DataFrame, size: int, max_bits: int) -> DataFrame:
    """id, fp, component, component_id (least id that is not null) for rows (id, text)."""
    rows = cut(fingerprints(docs, "id", "text", size), "prints")
    prints = cut(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct", rows.count())
    n = prints.count()
    joined = star_components(links(prints, max_bits), "u", "v")
    nodes = cut(prints.join(joined, prints.fp == joined.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "nodes", n)
    # tables of their own, so that adaptive execution can split a giant component, or the rows of a common fingerprint
    roots = cut(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "roots", n)
    names = cut(nodes.join(roots, "component").select("fp", "component", "component_id"), "names", n)
    return rows.join(names, "fp").select(F.col("key").alias("id"), "fp", "component", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that with the least key stays (of repeated rows one).

    Rows meet their component by key and a hash of the text; null keys stand last.
    """
    k, m = fresh(docs.columns, "__key"), fresh(docs.columns, "__mark")
    mark = F.xxhash64(F.col(f"`{text}`"))
    known = docs.select(F.struct(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit((1 << 63) - 1)).alias("k"), mark.alias("m")).alias("id"), F.col(f"`{text}`").alias("text"))
    found = _components_of(known, size, max_bits)
    kept = found.groupBy("component").agg(F.min("id").alias("id")).select(F.col("id.k").alias(k), F.col("id.m").alias(m))
    own = docs.columns
    marked = docs.withColumn(k, F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit((1 << 63) - 1))).withColumn(m, mark)
    return marked.join(kept, [k, m], "left_semi").dropDuplicates([k, m]).select(*(F.col(f"`{c}`") for c in own))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
