"""Repeated byte strings by a radix sort of suffixes that stops at a given depth.

Suffixes are those of the stretches that :mod:`meshwork.llm.repeats` leaves in question. A pass
splits every group by its next eight bytes, the most significant first, and drops suffixes that are
alone; what the last pass leaves together, 200 bytes deep, are the windows that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import repeats
from meshwork.llm.common import table
from meshwork.plans.scratch import cut, release

SHAPE = repeats.Shape(length=200, gram=130)
#: Contents that share an anchor above which the prefix grows to the whole window.
ROOM = 2_000


def byte_tokens() -> repeats.Tokens:
    values = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return lambda body: values[np.frombuffer(body, np.uint8)]


KIND = repeats.Kind(byte_tokens, lambda body: (body, None, 0), SHAPE)


def radix_groups(text: np.ndarray, at: np.ndarray, prefix: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose prefix and first ``depth`` bytes of ``text`` (from ``at`` on) another row shares, and their groups.

    A pass takes eight bytes as one big-endian number, the most significant first. Rows come out group by
    group, in byte order. Each pass sorts only rows that still have company, and only if it splits a group.
    """
    digits = np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))
    rows = np.argsort(prefix, kind="stable")
    group = prefix[rows]
    for d in [-1, *range(0, depth - 8, 8), depth - 8]:
        new = np.ones(len(rows), bool)
        new[1:] = group[1:] != group[:-1]
        if d >= 0:
            value = digits[at[rows] + d].astype(np.uint64)
            if (value == value[np.flatnonzero(new)][np.cumsum(new) - 1]).all():
                continue
            order = np.lexsort((value, group))
            rows, group, value = rows[order], group[order], value[order]
            new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        rows = rows[~alone]
        if not len(rows):
            break
    return rows, group


def repeated_windows(t: pa.Table) -> np.ndarray:
    """Numbers of the windows in the stretches ``t`` whose bytes stand in them twice or more."""
    row, number, prefix = repeats.windows_in(t)
    bodies = [x.as_py() for x in t.column("body")]
    lengths = np.array([len(x) for x in bodies])
    text = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    rows, _ = radix_groups(text, (np.cumsum(lengths) - lengths)[row] + number, prefix, SHAPE.length)
    return np.sort(rows)


def removed_stretches(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """Windows of ``docs`` (made by repeats.keyed) that also start elsewhere, as stretches: key, place, n."""
    copies, question = repeats.candidates(docs, KIND)
    some, leaves = repeats.suffixes_of(docs, question, KIND, room)
    spot = F.struct("key", "place")
    twice = cut(leaves.groupBy("d1", "d2").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("d1", "d2"), "leaves")
    late = leaves.join(twice, ["d1", "d2"], "left_semi").select("key", "place", F.lit(1).alias("n"))
    return copies.select("key", "place", "n").union(late).union(repeats.anchored(some, repeated_windows))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", room: int = ROOM) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row of ``docs``.

    A byte goes if a string of 200 bytes that covers it also starts at any other place. Null and
    short texts lose nothing. Rows that share key and text are one document: they get the same
    result and are not copies of each other. Keys may be of any type that can be ordered. A whole
    number of the least value of 64 bits counts as null.
    """
    return repeats.by_number(docs.select(key, text), key, lambda d: _without_repeats(d, key, text, room))


def _without_repeats(docs: DataFrame, key: str, text: str, room: int) -> DataFrame:
    rows = repeats.keyed(docs, key, text)
    gone = cut(removed_stretches(rows, room), "removed")
    release(docs.sparkSession)
    met = repeats.with_stretches(rows, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, spans in zip(b.column(1), b.column(2), strict=True):
                body, spans = body.as_py(), spans.as_py()
                if not spans:
                    out.append((len(body), 0, 0, body))
                    continue
                gone = repeats.marked(spans, SHAPE.length, len(body))
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(body), int(gone.sum()), runs, np.frombuffer(body, np.uint8)[~gone].tobytes()))
            total, removed, runs, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, runs)), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    out = met.mapInArrow(run, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(F.when(F.col("key") != repeats.NO_KEY, F.col("key")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
step AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step) GROUP BY doc_id, r),
edge AS (
  SELECT d.doc_id, d.h, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY x.a), 0) + 1 AS s, x.a - 1 AS e
  FROM d JOIN (SELECT doc_id, a, b FROM run UNION ALL SELECT doc_id, n + 1, n + 1 FROM d) x ON x.doc_id IS NOT DISTINCT FROM d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s - 1, 2 * (e - s + 1)), '' ORDER BY s) AS k FROM edge GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS removed, count(*) AS spans FROM run GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM d.doc_id
"""
