"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
rule that failed; a policy is a version and a mask over those bits, so that changing which rules
count needs no second look at the text, and ablations are counts over the distinct bit patterns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import fresh, table, words_of

#: Rule names in bit order (bit 0 first) with the condition under which a document fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
WINDOW = 5


@dataclass(frozen=True)
class Policy:
    """Which rules reject a document, under a version."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(n for n, _ in RULES))


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at these ascending positions."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("t")),
        lambda a, i: F.struct((i + WINDOW).alias("e"), (a["t"] + i + WINDOW - F.greatest(a["e"], i)).alias("t")),
        lambda a: a["t"],
    )


def with_ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` plus one struct column ``out``: the measurements and ``fail_bits`` (bigint).

    The struct is named ``out``, with underscores added if a column has that name; it comes last.
    Null and empty texts have no words: all measurements are 0 and few_words fails. Windows of five
    words are compared by 64-bit hashes within one document. A window's cost does not depend on how
    often it repeats, and nothing is shuffled: all is computed in the row.
    """
    w, ln, h, p = (fresh(docs.columns, f"__{x}") for x in ("words", "lines", "hashes", "pairs"))
    out = fresh(docs.columns, out)
    own = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Each step's columns are used more than once by the next one: the optimizer then keeps the steps apart.
    step = docs.select(*own, words_of(body).alias(w), F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(ln))
    hashes = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, WINDOW)))),
        1,
        F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)),
    )
    step = step.select(
        *own,
        F.size(w).cast("bigint").alias("n_words__"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars__"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols__"),
        F.size(ln).cast("bigint").alias("n_lines__"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint").alias("n_dup_lines__"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper__"),
        hashes.alias(h),
    )
    rest = [F.col(f"{m}__") for m in MEASURES if m != "n_repeat_words"]
    # Most texts repeat no window, which the sizes tell; only the others are sorted.
    step = step.select(
        *own,
        *rest,
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias(p),
    )
    twice = F.filter(
        p,
        lambda x, k: F.coalesce(F.get(F.col(p), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col(p), k + 1)["h"] == x["h"], F.lit(False)),
    )
    repeated = F.when(F.col(p).isNotNull(), _covered(F.sort_array(F.transform(twice, lambda x: x["i"])))).otherwise(F.lit(0).cast("bigint"))
    step = step.select(*own, *rest, repeated.alias("n_repeat_words__"))
    fields = [F.col(f"{m}__").alias(m) for m in MEASURES]
    step = step.select(*own, F.struct(*fields).alias(out))
    bits = F.lit(0).cast("bigint")
    for k, (_, failed) in enumerate(RULES):
        cond = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{out}`.\1", failed)
        bits = bits + F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
    # The condition always holds. Being nondeterministic it keeps the optimizer from moving a filter on the
    # ledger below the steps above, which would write each step's expression once for every use of it.
    return step.select(*own, F.col(out).withField("fail_bits", F.when(F.spark_partition_id() >= 0, bits)).alias(out))


def passes(policy: Policy, bits: Column) -> Column:
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablation(bits: DataFrame, policy: Policy, column: str = "fail_bits") -> DataFrame:
    """For each rule of the policy: documents failing it, failing only it, and kept without it.

    One aggregation by bit pattern (at most 2 ** len(RULES) groups, combined before the shuffle);
    the rest is bitwise work over those patterns.
    """
    patterns = bits.groupBy(F.col(column).alias("b")).agg(F.count("*").alias("n"))
    masked = F.col("b").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    names = [n for n, _ in RULES]
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in policy.rules))
    each = patterns.select("n", masked.alias("b"), F.explode(rows).alias("r")).select("n", "b", "r.rule", "r.bit")
    hit = F.col("b").bitwiseAND(F.col("bit")) != 0
    return (
        each.groupBy("rule")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when((F.col("b") == 0) | (F.col("b") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
        .withColumn("policy", F.lit(policy.version))
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    led = with_ledger(docs)
    m = led.columns[-1]
    bits = F.col(m)["fail_bits"]
    return led.select(
        "doc_id",
        *(F.col(m)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~passes(BASE, bits)).alias("base_failed"),
        passes(STANDARD, bits).alias("kept"),
        bits.alias("fail_bits"),
    )


_MEASURED = r"""
split_up AS (
  SELECT {key} AS k, coalesce(text, '') AS body, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM {docs}),
grams AS (
  SELECT k, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM split_up WHERE len(ws) >= 5)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT k, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY k),
measured AS (
  SELECT s.k, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(body, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper
  FROM split_up s LEFT JOIN cover c ON s.k = c.k),
judged AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM measured)
"""
OP4_SQL = (
    "WITH numbered AS (SELECT *, row_number() OVER () AS rn FROM documents), "
    + _MEASURED.format(key="rn", docs="numbered")
    + """
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM judged j JOIN numbered d ON d.rn = j.k"""
)
