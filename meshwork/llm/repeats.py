"""Windows of tokens that start in more than one place: candidates without sorting every suffix.

A document is a sequence of tokens (words or bytes). Of the ``length - gram + 1`` grams inside a
window of ``length`` tokens the one with the least hash is the window's *anchor*; equal windows have
equal anchors at equal offsets. Consecutive windows of a document with one anchor form a *unit*, a
stretch of ``n + length - 1`` tokens. So only units whose anchor occurs twice can hold a repeated
window, and of units with equal content one stands for all. What is left (units that share an anchor
but differ, one per content) goes on with its own tokens to the operators, which sort or grow trees
over the suffixes that share a prefix (anchor and offset). Nothing that can repeat is left out.

Anchors only choose what meets: their hashes are polynomials modulo 2**64 over random token values.
What is equal is decided by the tokens themselves in the sorts and trees, and by 128-bit BLAKE2b
digests of the tokens where contents are counted over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import utf8
from meshwork.plans.ranking import numbered
from meshwork.plans.scratch import cut, drop, release

_POSITION = np.uint64((1 << 24) - 1)
#: Windows handled at once; a longer document is taken in stretches of so many, which overlap.
STRETCH = 1 << 18
U64 = np.uint64
#: Stands for a null key: it sorts before all others.
NO_KEY = -(1 << 63)


@dataclass(frozen=True)
class Shape:
    """Tokens of a window, and of the grams that may be its anchor."""

    length: int
    gram: int


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    p = np.full(n, base, U64)
    q = np.full(n, pow(base, -1, 1 << 64), U64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Sums:
    """Hashes of any stretch of a token sequence from its running sums."""

    def __init__(self, values: np.ndarray, base: int):
        room = 1 << max(16, int(len(values)).bit_length())
        p, self.q = _powers(base, room)
        self.sum = np.zeros(len(values) + 1, U64)
        np.cumsum(values * p[: len(values)], out=self.sum[1:])

    def all(self, n: int) -> np.ndarray:
        """Hashes of every stretch of n tokens."""
        m = len(self.sum) - n
        return _mix((self.sum[n:] - self.sum[:m]) * self.q[:m])


ANCHOR_BASE = 0x9E3779B97F4A7C15


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling."""
    span, m = 1, v
    while 2 * span <= n:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(v) - n + 1], m[n - span : len(v) - span + 1]) if span < n else m


def units(values: np.ndarray, doc: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Units of a sequence of token values; ``doc`` has the document of each token.

    Returns anchor hash, the anchor's place after the first token, first token and number of windows of each unit.
    """
    size = len(values)
    if size < shape.length:
        return (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = Sums(values, ANCHOR_BASE).all(shape.gram)
    place = np.arange(len(grams), dtype=U64)
    # the place in the low bits: ties of the high bits go to the leftmost gram
    least = _least(grams & ~_POSITION | place, shape.length - shape.gram + 1)
    at = (least & _POSITION).astype(np.int64)
    whole = doc[: len(at)] == doc[shape.length - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1 : len(at)] != doc[: len(at) - 1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    # a unit ends before the next start or the first window that leaves the document
    stops = np.flatnonzero(np.concatenate([new | ~whole, [True]]))
    end = stops[np.searchsorted(stops, first, "right")]
    n = end - first
    return grams[at[first]], at[first] - first, first, n


Tokens = Callable[[bytes], np.ndarray]
#: A document's tokens as bytes, where each starts (none: at every byte), and how many bytes part two of them.
Layout = tuple[bytes, np.ndarray | None, int]


def _bounds(layout: Layout, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The bytes of the tokens [first, end)."""
    text, starts, gap = layout
    if starts is not None:
        first, end = starts[first], starts[end] - gap
    return [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]


def _digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests, as two numbers each."""
    d = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in pieces]), np.int64).reshape(-1, 2)
    return d[:, 0].copy(), d[:, 1].copy()


def _stretches(texts: Iterator[tuple[int, bytes]], tokens: Tokens, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token values of many documents joined: values, document (its number in the batch) and token number in it, each."""
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def joined():
        values = np.concatenate([h[0] for h in held])
        lens = [len(h[0]) for h in held]
        doc = np.repeat(np.array([h[1] for h in held], np.int64), lens)
        first = np.repeat(np.array([h[2] for h in held], np.int64) - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        return values, doc, first + np.arange(len(values))

    for k, text in texts:
        v = tokens(text)
        for s in range(0, max(1, len(v) - shape.length + 1), STRETCH):
            piece = v[s : s + STRETCH + shape.length - 1]
            # stretches of one document are never joined: they overlap
            if held and (size + len(piece) > STRETCH or s):
                yield joined()
                held, size = [], 0
            held.append((piece, k, s))
            size += len(piece)
    if held:
        yield joined()


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark and body (bytes): a null key comes first as the least number; ``mark``, a hash of the text, tells rows apart that share a key."""
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_KEY)).alias("key"), F.hash(F.col(f"`{text}`")).alias("mark"), utf8(F.col(f"`{text}`")).alias("body"))


def by_number(docs: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on documents whose key is a whole number; keys of another type are numbered in their order first and put back."""
    kind = dict(docs.dtypes)[key]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return work(docs)
    names = cut(numbered(docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("name")).distinct(), [F.col("name")], "number"), "names")
    other = [F.col(f"`{c}`") for c in docs.columns if c != key]
    out = work(docs.join(names, F.col(f"`{key}`") == F.col("name"), "left").select(*other, F.col("number").alias(key)))
    rest = [F.col(f"`{c}`") for c in out.columns if c != key]
    return out.join(names, F.col(f"`{key}`") == F.col("number"), "left").select(F.col("name").alias(key), *rest)


def _place(mark: pa.Array, first: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Mark and first token in one number, whose order is that of the pair."""
    return pa.array(mark.to_numpy()[rows].astype(np.int64) << 32 | first)


@dataclass(frozen=True)
class Kind:
    """How texts become tokens: a maker of token values (one a task), the layout of a text, and the shape of windows."""

    tokens: Callable[[], Tokens]
    layout: Callable[[bytes], Layout]
    shape: Shape


def unit_rows(docs: DataFrame, kind: Kind, whole: bool) -> DataFrame:
    """anchor of every unit of ``docs`` (made by :func:`keyed`); if ``whole`` also c1, c2 (digest of its tokens), key, place (mark and first token), n and at (the anchor's place)."""
    shape = kind.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = kind.tokens()
        for b in batches:
            bodies = [x.as_py() for x in b.column(2)]
            last, layout = -1, None
            for values, doc, number in _stretches(enumerate(bodies), make, shape):
                anchor, at, first, n = units(values, doc, shape)
                if not len(first):
                    continue
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["anchor"])
                    continue
                rows, begin, pieces = doc[first], number[first], []
                edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]]))
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    if rows[x] != last:
                        last, layout = rows[x], kind.layout(bodies[rows[x]])
                    pieces += _bounds(layout, begin[x:y], begin[x:y] + n[x:y] + shape.length - 1)
                c1, c2 = _digests(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(c1), pa.array(c2), b.column(0).take(pa.array(rows)), _place(b.column(1), begin, rows), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))],
                    names=["anchor", "c1", "c2", "key", "place", "n", "at"],
                )

    return docs.mapInArrow(run, "anchor bigint, c1 bigint, c2 bigint, key bigint, place bigint, n int, at int" if whole else "anchor bigint")


def by_document(stretches: DataFrame, *more: str) -> DataFrame:
    """k2, m2, spans: the distinct stretches (key, place, n, ...) of each document, which its length bounds."""
    s = stretches.select(F.col("key").alias("k2"), F.shiftright("place", 32).cast("int").alias("m2"), F.struct(F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("first"), "n", *more).alias("s"))
    return s.groupBy("k2", "m2").agg(F.collect_set("s").alias("spans"))


def candidates(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """Repeated units, and the stretches whose suffixes are in question.

    The first table has the units (key, place, n) whose content occurs at another place too, with the
    earliest place of it (k0, p0). The second has one stretch (anchor, key, place, n, at: the earliest)
    for each content whose anchor also occurs with other content, and c, how many contents the anchor has.
    """
    # Counted apart first: a common anchor is one row a task here. Each count is a table of its own, so that
    # adaptive execution can split the join with it where an anchor or a content is hot.
    twice = cut(unit_rows(docs, kind, False).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "twice")
    release(docs.sparkSession)
    kept = cut(unit_rows(docs, kind, True).join(twice, "anchor", "left_semi"), "units")
    drop(twice)
    release(docs.sparkSession)
    spot = F.struct("key", "place")
    classes = cut(kept.groupBy("c1", "c2").agg(F.min(F.struct("key", "place", "n", "at", "anchor")).alias("least"), F.max(spot).alias("most")).select("c1", "c2", "least.*", F.struct("least.key", "least.place").alias("first"), "most"), "classes")
    common = cut(classes.where("first <> most").select("c1", "c2", F.col("key").alias("k0"), F.col("place").alias("p0")), "common")
    copies = cut(kept.join(common, ["c1", "c2"]).select("key", "place", "n", "k0", "p0"), "copies")
    drop(kept)
    drop(common)
    several = cut(classes.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "several")
    question = cut(classes.join(several, "anchor").select("anchor", "key", "place", "n", "at", "c"), "question")
    drop(classes)
    drop(several)
    release(docs.sparkSession)
    return copies, question


def suffixes_of(docs: DataFrame, question: DataFrame, kind: Kind, room: int) -> tuple[DataFrame, DataFrame]:
    """The tokens in question: stretches (anchor, key, place, n, at, body), and windows (key, place, d1, d2: a digest of the window).

    A prefix (anchor and offset) deals suffixes into groups. Where more than ``room`` contents share an
    anchor, the prefix grows to the whole window, named by its digest: such a group is one leaf of equal windows.
    """
    length = kind.shape.length
    lists = by_document(question.withColumn("wide", F.col("c") > room), "at", "anchor", "wide")
    met = docs.join(lists, (F.col("key") == F.col("k2")) & (F.col("mark") == F.col("m2"))).select("key", "mark", "body", "spans")
    schema = "anchor bigint, key bigint, place bigint, n int, at int, body binary, d1 bigint, d2 bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (body, spans) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                layout, spans = kind.layout(body.as_py()), spans.as_py()
                one = b.slice(row, 1)

                def where(first: np.ndarray, one: pa.RecordBatch = one) -> list[pa.Array]:
                    rows = np.zeros(len(first), np.int64)
                    return [one.column(0).take(pa.array(rows)), _place(one.column(1), first, rows)]

                plain = [x for x in spans if not x["wide"]]
                first, n = (np.array([x[c] for x in plain], np.int64) for c in ("first", "n"))
                if plain:
                    empty = pa.nulls(len(plain), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["anchor"] for x in plain], pa.int64()), *where(first), pa.array(n.astype(np.int32)), pa.array([x["at"] for x in plain], pa.int32()), pa.array(_bounds(layout, first, first + n + length - 1), pa.binary()), empty, empty], names=names
                    )
                wide = [np.arange(x["first"], x["first"] + x["n"]) for x in spans if x["wide"]]
                starts = np.concatenate(wide) if wide else np.empty(0, np.int64)
                for i in range(0, len(starts), STRETCH):
                    at = starts[i : i + STRETCH]
                    d1, d2 = _digests(_bounds(layout, at, at + length))
                    ones, none = pa.array(np.ones(len(at), np.int32)), [pa.nulls(len(at), t) for t in (pa.int64(), pa.int32(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([none[0], *where(at), ones, *none[1:], pa.array(d1), pa.array(d2)], names=names)

    found = cut(met.mapInArrow(run, schema), "suffixes")
    drop(question)
    release(docs.sparkSession)
    return found.where("body IS NOT NULL").drop("d1", "d2"), found.where("body IS NULL").select("key", "place", "d1", "d2")


def anchored(stretches: DataFrame, find: Callable[[pa.Table], np.ndarray], least: int = 1 << 16) -> DataFrame:
    """Stretches (key, place, n) of the windows that ``find`` gives for the stretches of some anchors, all of each: numbers of windows, counted through, ascending."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if size >= least:
                other = b.column(0).to_numpy() != held[-1].column(0)[-1].as_py()
                k = int(np.argmax(other)) if other.any() else b.num_rows
                if k:
                    held.append(b.slice(0, k))
                if k == b.num_rows:
                    continue
                yield pa.Table.from_batches(held)
                held, size, b = [], 0, b.slice(k)
            held.append(b)
            size += int(b.column(3).to_numpy().sum())
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            got = find(t)
            if not len(got):
                continue
            n = t.column("n").to_numpy()
            begin = np.cumsum(n) - n
            row = np.searchsorted(begin, got, "right") - 1
            new = np.concatenate([[True], (got[1:] != got[:-1] + 1) | (row[1:] != row[:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(got)))
            r = row[first]
            yield pa.RecordBatch.from_arrays([pa.array(t.column("key").to_numpy()[r]), pa.array(t.column("place").to_numpy()[r] + got[first] - begin[r]), pa.array(size.astype(np.int32))], names=["key", "place", "n"])

    return stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "key bigint, place bigint, n int")


def windows_in(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the stretches: its row, its number in it, and a number for its prefix (anchor and offset)."""
    n = t.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    offset = t.column("at").to_numpy()[row] - number
    _, anchor = np.unique(t.column("anchor").to_numpy(), return_inverse=True)
    return row, number, anchor[row] * (int(offset.max()) + 1) + offset


def marked(stretches: list[dict], length: int, size: int) -> np.ndarray:
    """True for each of ``size`` tokens that a window of the stretches covers."""
    step = np.zeros(size + 1, np.int64)
    if stretches:
        first = np.array([x["first"] for x in stretches])
        np.add.at(step, first, 1)
        np.add.at(step, first + np.array([x["n"] for x in stretches]) + length - 1, -1)
    return np.cumsum(step)[:size] > 0


def with_stretches(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """key, body and spans (the list of its stretches, null for none) of every row of ``docs``."""
    lists = by_document(stretches)
    return docs.join(lists, (F.col("key") == F.col("k2")) & (F.col("mark") == F.col("m2")), "left").select("key", "body", "spans")
