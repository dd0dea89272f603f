"""Repeated word sequences by suffix trees over groups of suffixes with a common prefix.

Suffixes are those of the stretches that :mod:`meshwork.llm.repeats` leaves in question. A prefix
deals them into groups of bounded size, and grows to the whole window where too many share it. A task
builds the tree of its groups from the sorted words and the words that neighbours share. A node
as deep as a window with two leaves or more is a sequence that repeats: all but its earliest
leaf go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import repeats
from meshwork.llm.common import table
from meshwork.plans.scratch import cut, release

SHAPE = repeats.Shape(length=20, gram=8)
#: Contents that share an anchor above which the prefix grows to the whole window.
ROOM = 2_000
_CACHE = 1 << 20


class _Words(dict):
    """64-bit values of words; forgets all when it has many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = xxh64_intdigest(word, 11)
        return value


def word_tokens() -> repeats.Tokens:
    known = _Words()

    def tokens(body: bytes) -> np.ndarray:
        words = body.split()  # of bytes: at ASCII white space only
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return tokens


def word_layout(body: bytes) -> repeats.Layout:
    words = body.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return b" ".join(words), np.concatenate([[0], np.cumsum(lengths + 1)]), 1


KIND = repeats.Kind(word_tokens, word_layout, SHAPE)


@dataclass
class Forest:
    """Trees of sorted suffixes: each internal node has a depth in tokens and a range [low, high) of leaves."""

    order: np.ndarray
    depth: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def grow(cls, tokens: np.ndarray, ties: tuple[np.ndarray, ...]) -> Forest:
        """Trees over the rows of ``tokens``; leaves with all tokens equal stand in order of ``ties``."""
        order = np.lexsort((*reversed(ties), *tokens.T[::-1]))
        s = tokens[order]
        shared = np.cumprod(s[1:] == s[:-1], axis=1).sum(axis=1)
        depths, lows, highs = [], [], []
        for d in range(1, tokens.shape[1] + 1):
            edge = np.flatnonzero(np.concatenate([[True], shared < d, [True]]))
            low, high = edge[:-1], edge[1:]
            inner = high - low >= 2
            if d < tokens.shape[1] and inner.any():
                # A range whose leaves all share the next token too is no node: its edge goes on.
                inner[inner] = _range_min(shared, low[inner], high[inner] - 1) == d
            depths.append(np.full(int(inner.sum()), d))
            lows.append(low[inner])
            highs.append(high[inner])
        return cls(order, np.concatenate(depths), np.concatenate(lows), np.concatenate(highs))


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of x over each of the disjoint, ascending ranges [low, high)."""
    bounds = np.stack([low, high], axis=1).ravel()
    return np.minimum.reduceat(np.concatenate([x, [np.iinfo(x.dtype).max]]), bounds)[::2]


def later_windows(t: pa.Table) -> np.ndarray:
    """Numbers of the windows in the stretches ``t`` whose words also stand earlier in them, from the deep nodes of their trees."""
    row, number, prefix = repeats.windows_in(t)
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known)) for w in x.as_py().split(b" ")] for x in t.column("body")]
    lengths = np.array([len(w) for w in words])
    ids = np.concatenate([np.array(w, np.int64) for w in words])
    # a prefix with one suffix has no inner node
    _, group, size = np.unique(prefix, return_inverse=True, return_counts=True)
    some = np.flatnonzero(size[group] > 1)
    at = (np.cumsum(lengths) - lengths)[row[some]] + number[some]
    key, place = t.column("key").to_numpy()[row[some]], t.column("place").to_numpy()[row[some]] + number[some]
    tokens = np.column_stack([prefix[some], np.lib.stride_tricks.sliding_window_view(ids, SHAPE.length)[at]]) if len(some) else np.empty((0, SHAPE.length + 1), np.int64)
    tree = Forest.grow(tokens, (key, place))
    deep = tree.depth == SHAPE.length + 1
    low, size = tree.low[deep], (tree.high - tree.low)[deep]
    leaf = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
    later = np.ones(len(leaf), bool)
    later[np.cumsum(size) - size] = False
    return np.sort(some[tree.order[leaf[later]]])


def removed_stretches(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """Windows of ``docs`` (made by repeats.keyed) that also start earlier, as stretches: key, place, n."""
    copies, question = repeats.candidates(docs, KIND)
    some, leaves = repeats.suffixes_of(docs, question, KIND, room)
    spot = F.struct("key", "place")
    least = cut(leaves.groupBy("d1", "d2").agg(F.min(spot).alias("least"), F.max(spot).alias("most")).where("least <> most").drop("most"), "leaves")
    late = leaves.join(least, ["d1", "d2"]).where(spot != F.col("least")).select("key", "place", F.lit(1).alias("n"))
    first = copies.where("key <> k0 OR place <> p0").select("key", "place", "n")
    return first.union(late).union(repeats.anchored(some, later_windows))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = ROOM) -> DataFrame:
    """key, n_words, n_removed, kept (the remaining words joined by one space) for each row of ``docs``.

    A word goes if a window of 20 words that covers it also starts earlier: in a smaller key (null
    least), or in the same document before. Null and short texts lose nothing. Rows that share key
    and text are one document and get the same result; rows that share only the key are ordered by
    a hash of the text. Keys that are no whole numbers are taken in their own order. A whole number
    of the least value of 64 bits counts as null.
    """
    return repeats.by_number(docs.select(key, text), key, lambda d: _without_repeats(d, key, text, room))


def _without_repeats(docs: DataFrame, key: str, text: str, room: int) -> DataFrame:
    rows = repeats.keyed(docs, key, text)
    gone = cut(removed_stretches(rows, room), "removed")
    release(docs.sparkSession)
    met = repeats.with_stretches(rows, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for body, spans in zip(b.column(1), b.column(2), strict=True):
                words, spans = body.as_py().split(), spans.as_py()
                n = 0
                if spans:
                    out = repeats.marked(spans, SHAPE.length, len(words))
                    n = int(out.sum())
                    words_left = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    words_left = words
                total.append(len(words))
                gone.append(n)
                kept.append(b" ".join(words_left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["key", "n_words", "n_removed", "kept"])

    out = met.mapInArrow(run, "key bigint, n_words bigint, n_removed bigint, kept binary")
    return out.select(F.when(F.col("key") != repeats.NO_KEY, F.col("key")).alias(key), "n_words", "n_removed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM late, (SELECT unnest(range(0, 20)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
