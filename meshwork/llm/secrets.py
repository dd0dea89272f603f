"""Secrets in texts: three fixed patterns, and strings that a tokenizer needs many tokens for.

Natural text takes a tokenizer three to five characters a token; random keys take fewer than two.
A run of key characters is a finding if it mixes letters and digits (or cases, often), is not a known
digest or identifier, and has a low ratio of characters to tokens. Of a run that is no finding as a
whole, such as a key behind a long name or path, the stretches of short tokens are judged.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import fresh, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which the public 50k byte-level vocabulary splits text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_RATIO = 2.0
MIN_RUN = 16
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_RISE = re.compile(r"[a-z](?=[A-Z])")
_WORD = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Lengths in hex digits of the usual digests (MD5, SHA-1, SHA-2).
_DIGESTS = {32, 40, 56, 64, 96, 128}
_HEX_ONLY = re.compile(r"(?:0x)?(?:[0-9a-f]+|[0-9A-F]+)")
#: Integrity digests as web pages and lock files write them, ULIDs, and numbers in a row (times, versions, counters).
_INTEGRITY = re.compile(r"(?<![A-Za-z0-9])(?:md5|sha1|sha256|sha384|sha512)-[A-Za-z0-9+/]{22,86}={0,2}")
_ULID = re.compile(r"[0-7][0-9A-HJKMNP-TV-Z]{25}")
_NUMBERS = re.compile(r"(?:v?[0-9]{1,8}(?:T[0-9]{1,6})?[A-Za-z]{0,2}|[A-Za-z]{1,3})(?:[-_/=+]+(?:v?[0-9]{1,8}(?:T[0-9]{1,6})?[A-Za-z]{0,2}|[A-Za-z]{1,3}))+[-_/=+]*")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, split: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=split, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def known_identifier(run: str) -> bool:
    """Digests and identifiers that look random but are no secrets."""
    if _UUID.fullmatch(run) or _INTEGRITY.fullmatch(run) or _ULID.fullmatch(run) or _NUMBERS.fullmatch(run):
        return True
    return bool(_HEX_ONLY.fullmatch(run)) and len(run.removeprefix("0x")) in _DIGESTS


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _mixed(run: str) -> bool:
    """Letters and digits, or three changes from lower to upper case."""
    return bool(_LETTER.search(run)) and bool(_DIGIT.search(run)) or len(_RISE.findall(run)) >= 3


def _dense(scores: list[float]) -> list[tuple[int, int]]:
    """The maximal stretches of positive sum (Ruzzo and Tompa), in order."""
    kept: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, x in enumerate(scores):
        if x > 0:
            start, left, right = i, total, total + x
            while True:
                j = len(kept) - 1
                while j >= 0 and kept[j][2] >= left:
                    j -= 1
                if j < 0 or kept[j][3] >= right:
                    break
                start, left = kept[j][0], kept[j][2]
                del kept[j:]
            kept.append((start, i + 1, left, right))
        total += x
    return [(s, e) for s, e, _, _ in kept]


def _stretches(run: str, ranks: bytes, split: str, max_ratio: float) -> list[tuple[int, int]]:
    """Stretches of short tokens, each widened to whole letters-and-digits words and joined where they then touch."""
    code = _encoding(ranks, split)
    lengths = [len(code.decode_single_token_bytes(t)) for t in code.encode_ordinary(run)]
    at = [0, *accumulate(lengths)]
    words = [m.span() for m in _WORD.finditer(run)]
    starts = [w[0] for w in words]
    out: list[tuple[int, int]] = []
    for i, j in _dense([max_ratio - n for n in lengths]):
        s, e = at[i], at[j]
        s += len(run[s:e]) - len(run[s:e].lstrip("="))
        k = bisect_right(starts, s) - 1
        if k >= 0 and words[k][1] > s:
            s = words[k][0]
        k = bisect_right(starts, e - 1) - 1
        if k >= 0 and words[k][1] > e:
            e = words[k][1]
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def random_spans(text: str, ranks: bytes, split: str, max_ratio: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs outside ``taken`` (sorted), or stretches of them, whose characters per token are at most ``max_ratio``.

    What ``taken`` and integrity digests cover is cut out of a run and the rest is judged: a run that overlaps a fixed
    pattern is not left out whole. Runs and cuts are walked through side by side, once.
    """
    code, found = None, []
    gone, k = _disjoint([(s, e) for s, _, e in taken]), 0

    def is_random(run: str) -> bool:
        return len(run) >= MIN_RUN and _mixed(run) and not known_identifier(run) and len(run) <= max_ratio * len(code.encode_ordinary(run))

    for m in _RUN.finditer(text):
        while k < len(gone) and gone[k][1] <= m.start():
            k += 1
        if not _mixed(m[0]):
            continue
        code = code or _encoding(ranks, split)
        at, parts, cuts, j = m.start(), [], [], k
        while j < len(gone) and gone[j][0] < m.end():
            cuts.append(gone[j])
            j += 1
        if "-" in m[0]:
            cuts = _disjoint(sorted(cuts + [(m.start() + x.start(), m.start() + x.end()) for x in _INTEGRITY.finditer(m[0])]))
        for s, e in cuts:
            parts.append((at, s))
            at = max(at, e)
        for s, e in [*parts, (at, m.end())]:
            part = text[s:e]
            if e - s < MIN_RUN or not _mixed(part) or known_identifier(part):
                continue
            if is_random(part):
                found.append((s, 3, e))
            else:
                found += [(s + a, 3, s + b) for a, b in _stretches(part, ranks, split, max_ratio) if is_random(part[a:b])]
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _ranks(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, split: str = SPLIT, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: key, counts by kind, digest of the base spans, all spans.

    Null text is empty and has no spans. Offsets are code points, the end exclusive. Rows are
    handled one by one where they lie, repeated ones alike; nothing is shuffled. The vocabulary (under 1 MB) is read on
    the driver and sent with the function.
    """
    ranks = _ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                every = sorted(base + random_spans(t, ranks, split, max_ratio, base))
                n = [0] * len(KINDS)
                for _, k, _ in every:
                    n[k] += 1
                counts.append(n)
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            cols = [pa.array([n[k] for n in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = f"key {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return found.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact_text(t: str, ranks: bytes, split: str, max_ratio: float, mark: str) -> str:
    base = base_spans(t)
    spans = sorted(base + random_spans(t, ranks, split, max_ratio, base))
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        out += [t[at : max(s, at)], mark] if s >= at else []
        at = e
    return "".join([*out, t[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", vocabulary: str = VOCABULARY, split: str = SPLIT, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every span found (overlapping ones as one) replaced by ``mark``; null stays null."""
    ranks, own = _ranks(vocabulary), docs.columns
    new = fresh(own, "__redacted")

    @F.pandas_udf("string")
    def clean(s):
        return s.map(lambda t: None if t is None else redact_text(t, ranks, split, max_ratio, mark))

    return docs.withColumn(new, clean(F.col(f"`{text}`"))).select(*(F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in own))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
