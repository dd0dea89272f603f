"""Benchmark passages in documents by a prefix-filtered join (DataFrame functions only).

A window of an item is found in a document exactly where all its words follow each other, so the
document must hold the window's rarest word: with words ordered by how rare they are in the corpus
one word is the necessary prefix. Documents' words are joined with those words alone; the place of
the word in window and document gives the only possible start, the lengths bound it, and the words
in between are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import fresh, table, words_of
from meshwork.plans.scratch import cut

WINDOW = 10
#: What separates words, for texts in any case; upper-case A-Z are letters here and lowered after.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to this many windows (some 200 bytes each, with at most ten words) the benchmark's side is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item (string), words (array, A-Z lowered) of each distinct window; items without words have none."""
    w = items.select(F.col(f"`{item}`").cast("string").alias("item"), words_of(F.translate(F.col(f"`{text}`"), _UPPER, _LOWER), GAPS).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words")).distinct()


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Every occurrence of a window: key, text_hash, n_words, start (from 1), len, item.

    Rows with equal key and text give the same occurrences; text_hash tells rows of one key apart.
    ASCII letters alone are case-folded: the join compares words under ``lower``, which is coarser,
    and the comparison of the whole window is exact.
    """
    wins = cut(windows(items, item, item_text, size), "windows")
    few = wins.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    vocab = small(wins.select(F.explode("words").alias("word")).select(F.lower("word").alias("word")).distinct())
    body = F.col(f"`{text}`")
    words = docs.select(F.explode(words_of(body, GAPS)).alias("word")).select(F.lower("word").alias("word"))
    counts = small(cut(words.join(vocab, "word").groupBy("word").agg(F.count("*").alias("n")), "rarity"))
    spread = wins.select("item", "words", F.posexplode("words").alias("at", "word")).select("item", "words", "at", F.lower("word").alias("word"))
    # a window with a word that the corpus lacks does not occur: the inner join leaves it too few rows
    rare = spread.join(counts, "word").groupBy("item", "words").agg(F.min(F.struct("n", "word", "at")).alias("r"), F.count("*").alias("found")).where(F.col("found") == F.size("words"))
    rare = small(rare.select(F.col("r.word").alias("word"), F.col("r.at").alias("at"), F.col("words").alias("win"), "item"))
    own = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"), words_of(body, GAPS).alias("w"))
    start, length = F.col("q") - F.col("at"), F.size("win")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.translate(F.array_join(F.slice("w", F.greatest(start + 1, F.lit(1)), length), " "), _UPPER, _LOWER) == F.array_join("win", " ")
    # only where nothing is shuffled by word do the words of the text go along with each of them
    wide = ["w"] if few else []
    each = own.select("key", "text_hash", *wide, F.size("w").alias("n_words"), F.posexplode("w").alias("q", "raw")).select("key", "text_hash", *wide, "n_words", "q", F.lower("raw").alias("word"))
    found = each.join(rare, "word").where(fits)
    if not few:
        places = found.select(F.col("key").alias("k1"), F.col("text_hash").alias("h1"), "n_words", "q", "at", "win", "item").distinct()
        found = own.join(places, F.col("key").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("h1")))
    return found.where(same).select("key", "text_hash", "n_words", (start + 1).alias("start"), length.alias("len"), "item")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Words and items are counted as sets, so overlapping windows,
    items that share a passage and repeated rows count once.
    """
    found = hits(docs, items, key, text, item, item_text, size)
    # both sets are bounded by the length of one text and the number of items
    each = found.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    both = each.select(F.col("key").alias("k2"), F.col("text_hash").alias("h2"), covered.alias("n_hit"), "items")
    body = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"), F.size(words_of(body, GAPS)).cast("bigint").alias("n_words"))
    out = base.join(both, F.col("key").eqNullSafe(F.col("k2")) & (F.col("text_hash") == F.col("h2")), "left")
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their own columns."""
    bad = hits(docs, items, key, text, **names).select("key", "text_hash").distinct()
    h, k = fresh(docs.columns, "__hash"), fresh(docs.columns, "__key")
    bad = bad.select(F.col("key").alias(k), F.col("text_hash").alias(h))
    return docs.join(bad, F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(h)), "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT rn, i, k.n, array_to_string(w[i:i+k.n-1], ' ') AS g
  FROM (SELECT rn, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, (SELECT DISTINCT n FROM win) k WHERE i + k.n - 1 <= len(w)),
found AS (SELECT g.rn, g.i, g.n, win.item FROM grams g JOIN win ON g.n = win.n AND g.g = win.g),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM found) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM found) GROUP BY rn)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.rn = hit.rn LEFT JOIN named ON d.rn = named.rn
"""
