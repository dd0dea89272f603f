"""Language of a text by a convolutional network over its bytes, in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's
maximum is taken, and a softmax over those maxima gives the language. A text is cut into
consecutive windows that cover all of it; the windows' logits are averaged by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm.common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 6
PAD = 256
#: Bound on the labelled rows that training takes, shared equally by the languages (LEAST_ROWS each at least).
SAMPLE_ROWS, LEAST_ROWS = 3000, 50
#: Stretches of each such text, at hashed places over all of it, and their characters: training sees windows, never whole texts at once.
PIECES, PIECE_CHARS = 4, 512
_LETTER = re.compile(r"[^\W\d_]")
_K = max(WIDTHS)


@dataclass
class Network:
    langs: list[str]
    emb: np.ndarray  # 257 x DIM, the last row zero
    conv: np.ndarray  # (_K * DIM) x filters, zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _columns(self, ids: np.ndarray) -> np.ndarray:
        x = self.emb[ids]
        n = ids.shape[1] - _K + 1
        return np.concatenate([x[:, k : k + n] for k in range(_K)], axis=2)

    def features(self, ids: np.ndarray) -> np.ndarray:
        cols = self._columns(ids)
        y = cols.reshape(-1, cols.shape[2]) @ self.conv
        return np.maximum(y.reshape(*cols.shape[:2], -1).max(axis=1) + self.bias, 0)

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(ids[i : i + 128]) for i in range(0, len(ids), 128)]) @ self.out + self.out_bias


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded windows of all texts, each window's text, and its bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // WINDOW))
    first = np.cumsum(counts) - counts
    ids = np.full((int(counts.sum()), WINDOW + _K - 1), PAD, np.int16)
    for t, f, n in zip(texts, first, sizes, strict=True):
        raw = np.frombuffer(t, np.uint8)
        whole = n // WINDOW
        if whole:
            ids[f : f + whole, :WINDOW] = raw[: whole * WINDOW].reshape(whole, WINDOW)
        if n > whole * WINDOW:
            ids[f + whole, : n - whole * WINDOW] = raw[whole * WINDOW :]
    owner = np.repeat(np.arange(len(texts)), counts)
    length = np.full(len(owner), WINDOW, np.float64)
    length[first + counts - 1] = np.maximum(1, sizes - (counts - 1) * WINDOW)
    return ids, owner, length


def train(texts: list[str], langs: list[str], steps: int = 900, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Adam over balanced batches of random windows; the same input gives the same network."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    by = [[r for r, x in zip(raw, langs, strict=True) if x == n and len(r)] or [np.zeros(1, np.uint8)] for n in names]
    f = FILTERS * len(WIDTHS)
    mask = np.zeros((_K * DIM, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    emb = rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32)
    emb[PAD] = 0
    p = {"emb": emb, "conv": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), "bias": np.zeros(f, np.float32), "out": rng.normal(0, 0.1, (f, len(names))).astype(np.float32), "out_bias": np.zeros(len(names), np.float32)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    spans = np.array([WINDOW, 128, 64, 24])
    for step in range(1, steps + 1):
        n = int(spans[step % len(spans)])
        y = rng.integers(0, len(names), batch)
        ids = np.full((batch, n + _K - 1), PAD, np.int16)
        for i, c in enumerate(y):
            r = by[c][rng.integers(len(by[c]))]
            at = int(rng.integers(0, max(1, len(r) - n + 1)))
            piece = r[at : at + n]
            ids[i, : len(piece)] = piece
        net = Network(names, **p)
        cols = net._columns(ids)
        z = (cols.reshape(-1, cols.shape[2]) @ p["conv"]).reshape(batch, n, f)
        top = z.argmax(axis=1)
        pooled = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + p["bias"]
        h = np.maximum(pooled, 0)
        logit = h @ p["out"] + p["out_bias"]
        e = np.exp(logit - logit.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(batch), y] -= 1
        d /= batch
        dh = (d @ p["out"].T) * (pooled > 0)
        at = np.take_along_axis(cols, top.reshape(batch, f, 1), 1)  # batch x filters x (_K * DIM)
        g = {"out": h.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0), "conv": np.einsum("bf,bfc->cf", dh, at) * mask}
        back = np.einsum("bf,cf->bfc", dh, p["conv"]).reshape(batch, f, _K, DIM)
        g["emb"] = np.zeros_like(emb)
        for k in range(_K):
            np.add.at(g["emb"], np.take_along_axis(ids, top + k, 1).ravel(), back[:, :, k].reshape(-1, DIM))
        g["emb"][PAD] = 0
        for k, x in g.items():
            m1[k] = 0.9 * m1[k] + 0.1 * x
            m2[k] = 0.999 * m2[k] + 0.001 * x * x
            p[k] = (p[k] - rate * (1 - step / (steps + 1)) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(names, **p)


def held_out(key: str = "doc_id"):
    """True for the fifth of rows that training never sees; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Stretches of labelled texts not held out, and their languages: at most ``rows`` texts in all, equally many of each language.

    Languages are counted first. A text is taken if a hash of key and text falls under a threshold that
    leaves about half as many again as wanted, of which those with the least hashes stay: few rows are ever
    sorted or sent, and a rare language is learned from all it has. Repeated rows share a hash.
    """
    body, name = F.col(f"`{text}`"), F.col(f"`{lang}`")
    known = docs.where(body.isNotNull() & name.isNotNull() & ~held_out(key))
    counts = {r["l"]: r["n"] for r in known.groupBy(name.alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    each = max(LEAST_ROWS, rows // len(counts))
    share = F.try_element_at(F.create_map(*(F.lit(x) for n, c in counts.items() for x in (n, min(1.0, (1.5 * each + 20) / c)))), F.col("l"))
    seed = F.xxhash64(F.lit("langid"), F.col(f"`{key}`").cast("string"), body)
    some = known.select(name.alias("l"), seed.alias("h"), body.alias("t")).where(F.pmod(F.col("h"), F.lit(1 << 32)) < share * float(1 << 32))
    room = F.greatest(F.length("t") - PIECE_CHARS + 1, F.lit(1))
    places = F.sequence(F.lit(0), F.least(F.floor(F.length("t") / PIECE_CHARS), F.lit(PIECES - 1)))
    cut_out = F.transform(places, lambda k: F.substring(F.col("t"), (F.pmod(F.xxhash64("h", k), room) + 1).cast("int"), F.lit(PIECE_CHARS)))
    some = some.select("l", "h", cut_out.alias("pieces"))
    best = some.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "pieces"))).where(F.col("r") <= each)
    got = sorted((r.l, r.h, p) for r in best.collect() for p in r.pieces)
    return [p for _, _, p in got], [x for x, _, _ in got]


def classify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score (the softmax share of the prediction; 0 for ``und``) per document.

    ``und`` is given to null texts, to texts without a letter, and to all if nothing was learned.
    Of equal scores the language first in code-point order is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if net and t is not None and _LETTER.search(t)]
            while todo:
                part, size = [], 0
                while todo and (not part or size < 1 << 20):
                    i = todo.pop()
                    part.append(i)
                    size += len(texts[i])
                ids, owner, length = _windows([texts[i].encode("utf-8", "replace") for i in part])
                logit = net.logits(ids) * length[:, None]
                total = np.zeros((len(part), len(net.langs)))
                np.add.at(total, owner, logit)
                total /= np.bincount(owner, length)[:, None]
                e = np.exp(total - total.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                for i, row in zip(part, e, strict=True):
                    k = int(row.argmax())
                    pred[i], score[i] = net.langs[k], float(row[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["key", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(*sample(docs)))
