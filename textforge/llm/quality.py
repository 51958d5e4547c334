"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; a *policy* is a versioned bitmask of the rules it
enforces. Applying a policy, comparing two versions or running an ablation
("what would come back if rule r were dropped?") is bit arithmetic over the
ledger and never touches a text again.

Null or empty text: zero words, so the word-count rule fails. Every input row
gets one ledger row (repeated rows and null ids included).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm.registry import register, table

#: Fixed values of the measurements: word and symbol classes, window length.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A named predicate over the measurements; true means the rule fails."""
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Bit i of the ledger belongs to RULES[i]; append only, so old ledgers stay readable.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 30 * m("n_words")),
    Rule("shouting", lambda m: 100 * m("n_capitals") > 50 * m("word_chars")),
    Rule("long_words", lambda m: m("word_chars") > 40 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 60 * m("n_lines")),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_words"]

#: Policies by version: the mask of enforced rules.
POLICIES = {
    "v1": BASE_MASK,
    "v2": BASE_MASK | BIT["symbols"] | BIT["shouting"],
    "v3": BASE_MASK | BIT["symbols"] | BIT["shouting"] | BIT["long_words"] | BIT["repeated_lines"],
}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def _covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. Positions of such
    windows come from one sort of (hash, position); then a running union."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    starts = F.sort_array(_let(pairs, repeated))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts, zero,
        lambda a, i: F.struct((i + WINDOW).alias("end"),
                              (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"])


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``_tf_m`` of MEASURES (longs)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("_tf_words")
    a = docs.withColumn("_tf_text", text).withColumn(
        "_tf_words", F.regexp_extract_all("_tf_text", F.lit(WORD), F.lit(0)))
    a = a.withColumn("_tf_lines", F.filter(F.split("_tf_text", "\n", -1), lambda x: x.rlike(WORD)))
    a = a.withColumn(
        "_tf_h",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
                                        lambda i: F.xxhash64(F.slice("_tf_words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")))
    removed = lambda chars: F.length("_tf_text") - F.length(F.translate("_tf_text", chars, ""))
    out = {
        "n_words": n,
        "word_chars": F.length(F.translate("_tf_text", BLANKS, "")),
        "n_symbols": removed(SYMBOLS),
        "n_lines": F.size("_tf_lines"),
        "n_dup_lines": F.size("_tf_lines") - F.size(F.array_distinct("_tf_lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("_tf_h")) < F.size("_tf_h"),
                                 _covered_words(F.col("_tf_h"))).otherwise(F.lit(0)),
        "n_capitals": removed(CAPITALS),
    }
    return a.withColumn("_tf_m", F.struct(*[out[k].cast("long").alias(k) for k in MEASURES])).drop(
        "_tf_text", "_tf_words", "_tf_lines", "_tf_h")


def fail_bits() -> Column:
    """The ledger's bitmask over ``_tf_m``: each rule evaluated once."""
    m = lambda name: F.col("_tf_m")[name]
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(m), F.lit(BIT[r.name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, MEASURES..., fail_bits): one row per input row, no exchange."""
    src = docs.select(F.col(id_col).alias("_tf_id"), F.col(text_col).alias("_tf_src"))
    return with_measures(src, "_tf_src").select(
        F.col("_tf_id").alias(id_col), *[F.col("_tf_m")[k].alias(k) for k in MEASURES],
        fail_bits().alias("fail_bits"))


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    """True where no rule that ``policy`` enforces has failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with exactly their columns."""
    cols = docs.columns
    marked = with_measures(docs.select("*", F.col(text_col).alias("_tf_src")), "_tf_src")
    # the row number keeps the optimizer from pushing the filter into the measurements,
    # which would evaluate them again for every reference, inside lambdas too
    marked = marked.select(*[F.col(f"`{c}`") for c in cols], fail_bits().alias("_tf_bits"),
                           F.monotonically_increasing_id().alias("_tf_row"))
    return marked.where(passes(policy, "_tf_bits") & (F.col("_tf_row") >= 0)).drop("_tf_bits", "_tf_row")


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of ``policy``: documents that fail the rule, fail only
    it (what dropping the rule brings back), and that pass without it; one
    aggregate over the ledger's bits."""
    mask = POLICIES[policy]
    enforced = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    rules = [r.name for r in RULES if BIT[r.name] & mask]
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    aggs = []
    for name in rules:
        rest = F.lit(mask & ~BIT[name]).cast("long")
        aggs.append(F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(count(enforced.bitwiseAND(F.lit(BIT[name]).cast("long")) != 0), F.lit(0)).alias("n_failed"),
            F.coalesce(count(enforced == BIT[name]), F.lit(0)).alias("n_failed_only"),
            F.coalesce(count(enforced.bitwiseAND(rest) == 0), F.lit(0)).alias("n_kept_without")))
    one = led.agg(F.array(*aggs).alias("a"))
    return one.select(F.inline("a")).withColumn("policy", F.lit(policy))


OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + 7)) AS c
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d WHERE len(words) >= 8)),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM win, (SELECT unnest(generate_series(0, 7)) AS k)
  WHERE c > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(translate(t, '{CAPITALS}', '')))::BIGINT AS n_capitals
  FROM d LEFT JOIN rep USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE_MASK}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT]}) = 0 AS kept,
       fail_bits, n_lines, n_capitals, '{CURRENT}' AS policy
FROM b
"""


@register("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0).alias("base_failed"),
        passes().alias("kept"), "fail_bits", "n_lines", "n_capitals", F.lit(CURRENT).alias("policy"))
