"""License scan by ordered signature rules (DataFrame functions only).

A text is normalised to its words, each with a blank on either side, so a
pattern of words matches whatever stood between them. The keyword prefilter has
two steps: a text that holds none of GATES is done; of the others, only rules
whose keyword occurs are tried. Each match of a rule is an interval of words.

Overlaps are resolved by priority and containment: a detection falls if another
one covers its interval whose class is at least as important, unless the other
is the same interval under a later rule of the same class. Intervals that merely
overlap both stay. One pass over the detections sorted by (start, longest first,
class, rule) decides this: the furthest end so far, kept per class, is all it needs.

Base phrases are searched beside the rules; their labels always stay. Null or
empty text: no words, no label, score 0. Each input row gives one row (repeated
rows and null ids included), without any exchange; an empty table gives none.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm.license_rules import CONFIDENCE, GATES, LINES
from textforge.llm.registry import register, table

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, before ASCII capitals are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Detections handled by one inner pass; only the copying of arrays depends on it.
CHUNK = 256
_OPEN, _CLOSE = "\x01", "\x02"     # never part of a word
_FOUND = "array<struct<start:int,neg_end:int,class:int,rule:int,label:string>>"


def spaced(phrase: str) -> str:
    """A phrase or pattern in the form of a normalised text: two blanks between
    words, and so between the halves of ``a ?b`` (one word or two)."""
    return phrase.replace(" ", "  ").replace("[^  ]", "[^ ]").replace("  ?", "(?:  )?")


@dataclass(frozen=True)
class Rule:
    cls: int
    label: str
    keyword: str
    pattern: str


def rules_of(lines: str) -> tuple[Rule, ...]:
    out = []
    for line in lines.strip().split("\n"):
        head, keyword, pattern = line.split(" | ")
        cls, label = head.split(" ")
        out.append(Rule(int(cls), label, f" {spaced(keyword)} ", spaced(pattern)))
    return tuple(out)


RULES = rules_of(LINES)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def normalised(text: Column) -> Column:
    """Words with a blank on either side; a text without words is two blanks."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(text, GAP, "  ")), F.lit(" "))


def intervals(low: Column, pattern: Column) -> Column:
    """array<struct<start, end>>: the matches of a pattern of words, in words
    from 0, end exclusive. Matches are marked in the text, then the marks' places are read off."""
    marked = F.regexp_replace(low, F.concat(F.lit(" ("), pattern, F.lit(") ")), F.lit(f" {_OPEN}$1{_CLOSE} "))
    at = lambda ws, test, by: F.filter(
        F.transform(ws, lambda w, i: F.when(test(w), i + by)), lambda i: i.isNotNull())
    return _let(F.split(marked, " +"), lambda ws: F.arrays_zip(
        at(ws, lambda w: w.startswith(_OPEN), -1).alias("start"), at(ws, lambda w: w.endswith(_CLOSE), 0).alias("end")))


def found_by(low: Column, rules: tuple[Rule, ...]) -> Column:
    """Every rule's detections in ``low``, sorted; rules whose keyword is absent are not tried."""
    ledger = F.from_json(
        F.lit(json.dumps([{"n": i, "c": r.cls, "l": r.label, "k": r.keyword, "p": r.pattern} for i, r in enumerate(rules)])),
        "array<struct<n:int,c:int,l:string,k:string,p:string>>")
    tried = F.filter(ledger, lambda r: low.contains(r["k"]) & F.regexp_like(low, F.concat(F.lit(" "), r["p"], F.lit(" "))))
    each = F.transform(tried, lambda r: F.transform(intervals(low, r["p"]), lambda m: F.struct(
        m["start"].alias("start"), (-m["end"]).alias("neg_end"), r["c"].alias("class"), r["n"].alias("rule"), r["l"].alias("label"))))
    return F.sort_array(F.flatten(each)).cast(_FOUND)


def survivors(found: Column, classes: int = len(CONFIDENCE)) -> Column:
    """The sorted detections that no other one suppresses."""
    none = F.array().cast(_FOUND)

    def step(acc: Column, d: Column) -> Column:
        covered = F.get(acc["ends"], d["class"]) >= -d["neg_end"]
        ends = F.transform(acc["ends"], lambda end, c: F.when(c >= d["class"], F.greatest(end, -d["neg_end"])).otherwise(end))
        return F.struct(ends.alias("ends"), F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    def chunk(acc: Column, ds: Column) -> Column:
        inner = F.aggregate(ds, F.struct(acc["ends"].alias("ends"), none.alias("kept")), step)
        return _let(inner, lambda r: F.struct(r["ends"].alias("ends"), F.concat(acc["kept"], F.array(r["kept"])).alias("kept")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")),
                         lambda i: F.slice(found, i * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.array_repeat(F.lit(0), classes).alias("ends"), F.array().cast(f"array<{_FOUND}>").alias("kept"))
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(chunks, start, chunk, lambda a: F.flatten(a["kept"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, n_words, places, base, detections): places are the intervals of
    the base phrases and base their distinct labels; detections are the rules'
    survivors as (start, end, class, rule, label), in order."""
    n = docs.select(F.col(id_col).alias("_tf_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("_tf_norm"))
    gate = F.lower("_tf_norm")
    words = F.length("_tf_norm") - F.length(F.replace("_tf_norm", F.lit("  "), F.lit(" "))) + 1
    n = n.withColumn("_tf_gate", gate).select(
        "_tf_id", F.when(F.col("_tf_norm") == "  ", 0).otherwise(words).cast("long").alias("n_words"),
        F.when(functools.reduce(operator.or_, [F.col("_tf_gate").contains(spaced(g)) for g in GATES]),
               F.translate("_tf_norm", CAPITALS, SMALL)).alias("_tf_low"))
    low = F.col("_tf_low")
    phrases = "(?:" + "|".join(spaced(p) for p, _ in BASE) + ")"
    places = F.when(low.rlike(f" {phrases} "), intervals(low, F.lit(phrases)))
    base = F.when(F.col("places").isNotNull(), F.filter(
        F.array(*[F.when(low.contains(f" {spaced(p)} "), F.lit(label)) for p, label in BASE]), lambda x: x.isNotNull()))
    n = n.withColumn("places", places).withColumn("base", base)
    n = n.withColumn("_tf_found", F.when(low.isNotNull(), found_by(low, rules)))
    kept = F.transform(survivors(F.col("_tf_found")), lambda d: F.struct(
        d["start"].alias("start"), (-d["neg_end"]).alias("end"), d["class"].alias("class"), d["rule"].alias("rule"), d["label"].alias("label")))
    return n.select(
        F.col("_tf_id").alias(id_col), "n_words",
        F.coalesce("places", F.array().cast("array<struct<start:int,end:int>>")).alias("places"),
        F.coalesce("base", F.array().cast("array<string>")).alias("base"),
        F.when(F.size("_tf_found") > 0, kept).otherwise(
            F.array().cast("array<struct<start:int,end:int,class:int,rule:int,label:string>>")).alias("detections"))


def _sql() -> str:
    text = "translate(coalesce(text, ''), '%s', '%s')" % (CAPITALS, SMALL)
    rules = ", ".join(f"({i}, {r.cls}, '{r.label}', '{r.keyword}', '{r.pattern}')" for i, r in enumerate(RULES))
    base = ", ".join(f"(' {spaced(p)} ', '{label}')" for p, label in BASE)
    phrases = "(?:" + "|".join(spaced(p) for p, _ in BASE) + ")"
    mark = lambda pattern: (
        f"string_split_regex(regexp_replace(low, ' (' || {pattern} || ') ', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' +')")
    sure = "CASE class " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(CONFIDENCE)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  ' ' || trim(regexp_replace({text}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) || ' ' AS low FROM documents),
rules(rule, class, label, keyword, pattern) AS (VALUES {rules}),
base(phrase, label) AS (VALUES {base}),
m AS (SELECT rid, rule, class, label, {mark("pattern")} AS ws FROM d JOIN rules ON contains(low, keyword)),
s AS (SELECT rid, rule, class, label,
             unnest(list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: starts_with(x[1], chr(1))), lambda x: x[2] - 2)) AS a,
             unnest(list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: ends_with(x[1], chr(2))), lambda x: x[2] - 1)) AS b
      FROM m),
kept AS (SELECT * FROM s x WHERE NOT EXISTS (
  SELECT 1 FROM s y WHERE y.rid = x.rid AND y.a <= x.a AND y.b >= x.b AND y.class <= x.class
  AND (y.a < x.a OR y.b > x.b OR y.class < x.class OR y.rule < x.rule))),
bw AS (SELECT rid, {mark("'" + phrases + "'")} AS ws FROM d),
bp AS (SELECT rid, list_transform(list_filter(list_zip(ws, generate_series(1, len(ws))), lambda x: starts_with(x[1], chr(1))), lambda x: x[2] - 2) AS p FROM bw),
bl AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM d JOIN base ON contains(low, phrase) GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (
  SELECT rid, label FROM kept UNION ALL SELECT rid, label FROM d JOIN base ON contains(low, phrase)) GROUP BY rid),
sc AS (SELECT rid, max({sure})::DOUBLE AS score, count(*) AS n FROM kept GROUP BY rid)
SELECT doc_id, CASE WHEN low = '  ' THEN 0 ELSE len(string_split(trim(low), '  ')) END::BIGINT AS n_words,
       len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
       coalesce(bl.ls, '') AS base_labels, coalesce(al.ls, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score,
       coalesce(n, 0)::BIGINT AS n_detections
FROM d JOIN bp USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""


@register("op12_license_scan", _sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = lambda xs: F.array_join(F.sort_array(F.array_distinct(xs)), ",")
    labels = F.transform("detections", lambda d: d["label"])
    sure = F.array(*[F.lit(c) for c in CONFIDENCE])
    start = F.transform("places", lambda x: x["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.concat("base", labels)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: F.get(sure, d["class"]))), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"))
