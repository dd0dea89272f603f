"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least 4/5: all pairs.

Candidates come from two sides. SimHash links (:mod:`meshwork.llm.simhash`: fingerprints within four bits,
met at anchor points) find the closest copies cheaply. For the rest: two sets of that similarity share at
least four fifths of the shingles of the larger, so in any order of all shingles the first fifths of both
have one in common. Shingles that are frequent in a sample stand last in the order, so that passages found
everywhere bring no pairs. The same order bounds what a pair can share beyond its heads, which rules most
candidates out; each of the others is decided by the whole sets, made again from the texts. Those lie and
travel compressed: a third of what the hashes of their shingles take. Pairs inside a component need no
decision: rounds with a few leaders of each shingle join crowds before all that is left is compared. Two sets
meet only at shingles that can be the first they share, rarest first, if they share as many as they have to.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm import simhash
from meshwork.llm.common import fresh, utf8
from meshwork.llm.simhash import SEED
from meshwork.operators.components import star_components
from meshwork.plans.scratch import cut, drop, release

#: Documents in the sample for frequent shingles, and how many of them a frequent one is in. The order decides costs alone.
SAMPLE, FREQUENT = 20_000, 10
#: Rounds with leaders alone at most, leaders of a token, and candidates a document at which no more rounds are needed.
ROUNDS, LEADERS, FEW = 4, 8, 2
#: Tokens of a set before the one at which a pair meets that are searched for an earlier meeting.
PAST = 64
#: Share of the pairs still open that a round has to settle for another one to follow.
WORTH = 0.2
#: Pairs up to which the texts asked for are picked out by a broadcast.
SMALL = 50_000
_LAST = (1 << 63) - 1


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``size`` words (of all words if they are fewer), ascending."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: max(1, len(words) - size + 1)], ends[min(size, len(words)) - 1 :]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays or [np.empty(0, np.uint64)]).view(np.int64)))


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens frequent in a sample of the distinct texts, ascending, and in how many of it they are."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                yield pa.RecordBatch.from_arrays([_lists([shingles(t.as_py(), size) for t in b.column(0)[i : i + 1000]])], names=["tokens"])

    n = some.mapInArrow(run, "tokens array<bigint>").select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    got = n.orderBy(F.desc("n"), "t").limit(1 << 20).toArrow()
    t, c = got.column("t").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(t)
    return t[order], c[order]


def _heads(docs: DataFrame, size: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """k, m, sid, fp (the set's SimHash), n (tokens), head (the first fifth and one), body and room (the words, compressed, and their bytes) for rows (k, m, text bytes).

    Where the task had the set before, head and body are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tokens, counts = frequent
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                sid, fp, n, heads = np.empty(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.empty(b.num_rows, np.int64), []
                bodies, room = [b""] * b.num_rows, np.zeros(b.num_rows, np.int64)
                for i, text in enumerate(b.column(2)):
                    words = b" ".join(text.as_py().lower().split())
                    s = shingles(words, size)
                    sid[i], n[i] = xxh64_intdigest(s.tobytes(), SEED), len(s)
                    if int(sid[i]) in seen:
                        heads.append(s[:0])
                        continue
                    seen.add(int(sid[i]))
                    fp[i] = simhash.of_hashes(s)
                    bodies[i], room[i] = pa.compress(words, codec="zstd", asbytes=True), len(words)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        s = s[np.argsort(np.where(tokens[at] == s, counts[at], 0), kind="stable")]
                    heads.append(s[: len(s) - _most(len(s))].copy())
                columns = [b.column(0), b.column(1), pa.array(sid.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(n), _lists(heads), pa.array(bodies, pa.binary()), pa.array(room)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "m", "sid", "fp", "n", "head", "body", "room"])

    return docs.mapInArrow(run, "k bigint, m bigint, sid bigint, fp bigint, n bigint, head array<bigint>, body binary, room bigint")


def _most(n: int) -> int:
    """Tokens that a set of ``n`` has beyond its head."""
    return (4 * n + 4) // 5 - 1


def _close(a: str, b: str):
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def _likely(pairs: DataFrame, kin: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those that can have a Jaccard similarity of at least 4/5 by what their heads share.

    Of the set whose head ends first in the order, what both have up to there is in both heads; beyond it
    they share no more than that set has left. ``kin`` (sid, n, tokens) has the tokens of a head that other heads have.
    """
    x = kin.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("x"))
    y = kin.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("y"))
    both = pairs.join(x, "u").join(y, "v").where(_close("nu", "nv"))
    return both.where(_enough(F.size(F.array_intersect("x", "y")))).select("u", "v")


def _enough(shared: Column) -> Column:
    """Whether sets of nu and nv tokens with so many of their heads' tokens in common can be similar."""
    left = F.floor((4 * F.greatest("nu", "nv") + 4) / 5) - 1
    return 9 * (shared + left) >= 4 * (F.col("nu") + F.col("nv"))


def _ranked(postings: DataFrame) -> DataFrame:
    """Postings (sid, n, token, df, s1, s2, ...) with ``held``, the tokens that a set has here, and ``room``: how many of them, from this one on, stand in the order of df, rarest first.

    Tokens that the same sets have (``s1`` and ``s2`` are 128 bits of a hash of them) follow each other; a pair
    that has one has all, so that only the first of them stays.
    """
    own = W.partitionBy("sid")
    order = own.orderBy("df", "s1", "s2", "token")
    same = F.lag("s1").over(order).eqNullSafe(F.col("s1")) & F.lag("s2").over(order).eqNullSafe(F.col("s2"))
    ranked = postings.withColumn("held", F.count("*").over(own)).withColumn("room", F.col("held") - F.row_number().over(order) + 1)
    return ranked.withColumn("again", same).where("NOT again").drop("again", "s1", "s2")


def _may_be_first() -> Column:
    """Whether the token can be the first, in the order of df, that a set shares with a similar one of another component.

    Such sets share so many tokens of their heads (:func:`_enough`), all of them open, that the first has room
    for the others behind it. A partner has from lo to hi tokens, and from 4/5 to 5/4 of n: of the smaller ones the
    smallest asks for the fewest shared tokens, of the larger ones the largest, up to rounding.
    """
    n, room = F.col("n"), F.col("room")
    smaller = 45 * (room + F.floor((4 * n + 4) / 5) - 1) >= 4 * (5 * n + F.greatest(5 * F.col("lo"), 4 * n))
    larger = 45 * room > 20 * n - 4 * F.least(4 * F.col("hi"), 5 * n)
    return smaller | larger


def _similar(pairs: DataFrame, bodies: DataFrame, size: int) -> DataFrame:
    """Of the pairs (u, v) those whose whole sets, made from the words in ``bodies`` (sid, body, room), have a Jaccard similarity of at least 4/5."""
    if pairs.limit(SMALL + 1).count() <= SMALL:
        # at most two rows a pair: only the texts of the pairs are then dealt
        asked = cut(pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).distinct(), "asked")
        bodies = bodies.join(F.broadcast(asked), "sid", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def tokens(body: bytes, room: int) -> np.ndarray:
            return shingles(pa.decompress(body, decompressed_size=room, codec="zstd", asbytes=True), size)

        for b in batches:
            near = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (tokens(b.column(k)[i].as_py(), b.column(k + 1)[i].as_py()) for k in (2, 4))
                near[i] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
            yield b.select([0, 1]).filter(pa.array(near))

    x = bodies.select(F.col("sid").alias("u"), F.col("body").alias("x"), F.col("room").alias("rx"))
    y = bodies.select(F.col("sid").alias("v"), F.col("body").alias("y"), F.col("room").alias("ry"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "rx", "y", "ry").mapInArrow(run, "u bigint, v bigint")


def _simhash_pairs(heads: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are equal or linked within four bits: enough of them to join each such component."""
    own = cut(heads.where(F.size("head") > 0).select("sid", "fp").distinct(), "own")
    least = cut(own.groupBy("fp").agg(F.min("sid").alias("least")), "least")
    same = own.join(least, "fp").where("sid <> least").select(F.col("least").alias("u"), F.col("sid").alias("v"))
    far = simhash.links(least).withColumnRenamed("u", "fu").withColumnRenamed("v", "fv")
    far = far.join(least.select(F.col("fp").alias("fu"), F.col("least").alias("a")), "fu").join(least.select(F.col("fp").alias("fv"), F.col("least").alias("b")), "fv")
    return same.union(far.select("a", "b")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(heads: DataFrame, size: int) -> DataFrame:
    """sid, component for the sets with a similar other one, from the table of heads, which is deleted as soon as it is used."""
    spark = heads.sparkSession
    # tokens of one set alone bring no pairs; dealt once, what remains is small
    same = W.partitionBy("token")
    dealt = heads.select("sid", "n", F.explode("head").alias("token")).withColumn("a", F.min("sid").over(same)).withColumn("b", F.max("sid").over(same))
    dealt = cut(dealt.where("a < b").select("sid", "n", "token"), "dealt")
    release(spark)
    postings = cut(dealt.distinct(), "postings")
    drop(dealt)
    close = cut(_simhash_pairs(heads), "close")
    met = cut(postings.select("sid").union(close.select("u")).union(close.select("v")).distinct(), "met")
    # one row of the input for each set that meets another
    owners = heads.where(F.size("head") > 0).select("sid", "k", "m").join(met, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("k", "m")).alias("id"))
    owners = cut(owners.select("sid", F.col("id.k").alias("k0"), F.col("id.m").alias("m0")), "owners")
    bodies = heads.where(F.size("head") > 0).select("sid", "k", "m", "body", "room").join(owners, "sid").where("k = k0 AND m = m0")
    bodies = cut(bodies.dropDuplicates(["sid"]).select("sid", "body", "room"), "bodies")  # a row of the input may itself be repeated
    drop(heads)
    kin = cut(postings.groupBy("sid", "n").agg(F.collect_list("token").alias("tokens")), "kin")
    release(spark)
    n_sets, before = met.count(), None

    def named(links: DataFrame) -> DataFrame:
        joined = cut(star_components(links, "u", "v").select(F.col("id").cast("bigint").alias("sid"), F.col("component").cast("bigint").alias("joined")), "joined")
        return cut(met.join(joined, "sid", "left").select("sid", F.coalesce("joined", "sid").alias("component")), "label")

    tried, links = close, cut(_similar(cut(_likely(close, kin), "likely"), bodies, size), "similar")
    label = named(links)
    for r in range(ROUNDS + 1):
        # postings of tokens that more than one component has
        spread = postings.join(label, "sid")
        who = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"s{k}") for k in (1, 2)]
        open_ = spread.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("df"), F.min("n").alias("lo"), F.max("n").alias("hi"), *who)
        first = cut(_ranked(spread.join(open_.where("a < b").drop("a", "b"), "token")).where(_may_be_first()), "open")
        per = first.groupBy("token", "component").agg(F.count("*").cast("double").alias("c"))
        cross = per.groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("x")).agg(F.sum("x")).first()[0] or 0.0
        if not cross:
            break
        last = r == ROUNDS or cross <= FEW * n_sets or (before is not None and cross > (1 - WORTH) * before)
        before = cross
        y = first
        if not last:
            # the sets with the most open tokens are the likeliest partners; who has most changes as components grow
            place = F.row_number().over(W.partitionBy("token").orderBy(F.lit(0) if r % 2 else F.desc("held"), F.xxhash64("sid", F.lit(r))))
            y = first.withColumn("place", place).where(F.col("place") <= LEADERS)
        # a pair counts at the first token where both meet; of those before it the nearest are looked at
        past = F.collect_list("token").over(W.partitionBy("sid").orderBy(F.desc("room")).rowsBetween(-PAST, -1))
        x, y = first.withColumn("past", past), y.withColumn("past", past)
        once = ~F.arrays_overlap("past", "pv") & (F.col("sid") < F.col("v") if last else F.lit(True))
        x = x.select("token", "sid", F.col("n").alias("nu"), "component", "room", "past")
        y = y.select("token", F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"), F.col("room").alias("rv"), F.col("past").alias("pv"))
        pairs = x.join(y, "token").where(once & (F.col("component") != F.col("cv")) & _close("nu", "nv") & _enough(F.least("room", "rv")))
        pairs = pairs.select(F.least("sid", "v").alias("u"), F.greatest("sid", "v").alias("v")).distinct()
        pairs = cut(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        found = cut(_similar(cut(_likely(pairs, kin), "likely"), bodies, size), "similar")
        drop(first)
        release(spark)
        if found.limit(1).count():
            links = links.unionByName(found)
            label = named(links)
        if last:
            break
    for spent in (postings, kin, bodies):
        drop(spent)
    return label


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """The rows of ``docs`` less all but one of each component of similar documents: that with the least key stays (of repeated rows one).

    Documents without words are one component. Rows meet their component by key and a hash of the text; null keys stand last.
    """
    k, m = fresh(docs.columns, "__key"), fresh(docs.columns, "__mark")
    own = docs.columns
    marked = docs.withColumn(k, F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LAST))).withColumn(m, F.xxhash64(F.col(f"`{text}`")))
    texts = marked.select(F.col(k).alias("k"), F.col(m).alias("m"), utf8(F.col(f"`{text}`")).alias("text"))
    frequent = _frequent(texts, size)
    release(docs.sparkSession)
    heads = cut(_heads(texts, size, frequent), "heads")
    sets = cut(heads.select("k", "m", "sid"), "sets")
    found = sets.join(components(heads, size), "sid", "left").select("k", "m", F.coalesce("component", "sid").alias("component"))
    kept = cut(found.groupBy("component").agg(F.min(F.struct("k", "m")).alias("id")).select(F.col("id.k").alias(k), F.col("id.m").alias(m)), "kept")
    drop(sets)
    release(docs.sparkSession)
    return marked.join(kept, [k, m], "left_semi").dropDuplicates([k, m]).select(*(F.col(f"`{c}`") for c in own))
