"""Judge prompts, verdict parsing and judge aggregates.

Parsing is native: fences are cut with ``split``/``element_at``, key
presence is tested on a ``map<string,string>`` parse (a present null
passes, as in the reference), and the typed verdict comes from a second
``from_json``. The first valid attempt per id is a ``min_by`` aggregate
with map-side combine.
"""

from __future__ import annotations

import string
import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.prompts import PAIRWISE_PROMPT, SCALAR_PROMPT
from textforge.functions.text import trim_ws

# --- fixed values: verdict contract ---
AXES = ("faithfulness", "darija_quality", "conciseness")
REQUIRED_KEYS = ("faithfulness", "darija_quality", "conciseness", "reasoning")
FAILED_REASON = "evaluation failed"
MAX_ATTEMPTS = 3
FENCE = "```"
# --- end of fixed values ---

#: Prompts that a task holds as Python texts at once.
ASK_ROWS = 256

SCALAR_VERDICT = T.StructType(
    [T.StructField(a, T.DoubleType()) for a in AXES] + [T.StructField("reasoning", T.StringType())])
_CHOICE = T.StructType([T.StructField(x, T.StringType()) for x in ("winner", "confidence", "reason")])
PAIRWISE_VERDICT = T.StructType(
    [T.StructField(a, _CHOICE) for a in AXES]
    + [T.StructField(f"overall_{x}", T.StringType()) for x in ("winner", "confidence", "reason")])


def render_template(template: str, **cols: Column | str) -> Column:
    """A ``str.format`` template with Column placeholders -> one ``concat``."""
    parts: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            c = cols[field]
            parts.append(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.concat(*parts)


def judge_prompt_scalar(input_col: Column | str, reference: Column | str,
                        prediction: Column | str) -> Column:
    """The 1-5 rubric prompt."""
    return render_template(SCALAR_PROMPT, input=input_col, reference=reference,
                           prediction=prediction)


def judge_prompt_pairwise(input_col: Column | str, reference: Column | str,
                          prediction_a: Column | str, prediction_b: Column | str) -> Column:
    """The A/B comparison prompt."""
    return render_template(PAIRWISE_PROMPT, input=input_col, reference=reference,
                           prediction_a=prediction_a, prediction_b=prediction_b)


def strip_code_fence(raw: Column | str) -> Column:
    """P10: trim; if fenced keep the part after the first fence, minus a
    leading ``json``; trim again."""
    t = trim_ws(raw)
    inner = F.get(F.split(t, FENCE), F.lit(1))
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return trim_ws(F.when(t.startswith(FENCE), inner).otherwise(t))


def parse_verdict(text: Column | str, required: Sequence[str] = REQUIRED_KEYS,
                  schema: T.StructType = SCALAR_VERDICT) -> Column:
    """The verdict struct when the text is exactly one JSON object holding
    every required key; null otherwise. The object is parsed as the only member
    of a list, so that text after it is an error instead of being ignored."""
    c = F.col(text) if isinstance(text, str) else text
    listed, strict = F.concat(F.lit("["), c, F.lit("]")), {"allowSingleQuotes": "false"}
    objects = F.from_json(listed, T.ArrayType(T.MapType(T.StringType(), T.StringType())), strict)
    keys = F.get(objects, F.lit(0))
    ok = F.coalesce(F.size(objects) == 1, F.lit(False))
    for k in required:
        ok = ok & F.coalesce(F.map_contains_key(keys, k), F.lit(False))
    return F.when(ok, F.get(F.from_json(listed, T.ArrayType(schema), strict), F.lit(0)))


def verdict_fallback(schema: T.StructType = SCALAR_VERDICT) -> Column:
    """Null scores and the failure reason."""
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "reasoning"
                      else F.lit(FAILED_REASON).alias("reasoning") for f in schema.fields])


def parsed_attempts(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """P10 + P11 per attempt: adds ``verdict`` (null when invalid)."""
    return raw.withColumn("verdict", parse_verdict(strip_code_fence(raw_col)))


def judge_first_valid_attempt(attempts: DataFrame, key: str = "id", attempt: str = "attempt",
                              max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The first attempt that parses, else the fallback verdict.

    Output: key, the verdict fields, ``valid`` and ``attempts_used``.
    """
    p = parsed_attempts(attempts).where(F.col(attempt) <= max_attempts)
    per = p.groupBy(key).agg(
        F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.col(attempt))).alias("_v"),
        F.min(F.when(F.col("verdict").isNotNull(), F.col(attempt))).alias("_first"),
        F.max(attempt).alias("_last"))
    valid = F.col("_first").isNotNull()
    v = F.when(valid, F.col("_v")).otherwise(verdict_fallback())
    return per.select(key, *[v[f].alias(f) for f in SCALAR_VERDICT.fieldNames()],
                      valid.alias("valid"),
                      F.coalesce(F.col("_first"), F.col("_last")).cast("int").alias("attempts_used"))


def judge_mean_scores(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean per axis over valid verdicts; overall = all scores / (3 n).
    With no valid verdict the means are null (the reference divides by zero)."""
    ok = F.col("faithfulness").isNotNull()
    n = F.count_if(ok)
    total = sum((F.sum(F.when(ok, F.col(a))) for a in AXES[1:]), F.sum(F.when(ok, F.col(AXES[0]))))
    aggs = [F.avg(F.when(ok, F.col(a))).alias(a) for a in AXES]
    aggs += [(total / (3 * n)).alias("overall"), n.alias("n_valid")]
    return verdicts.groupBy(*by).agg(*aggs)


def judge_failure_rate(verdicts: DataFrame) -> DataFrame:
    """Rows that ended in the fallback and attempts used."""
    return verdicts.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("n_failed"),
        (F.count_if(~F.col("valid")) / F.count(F.lit(1))).alias("failure_rate"),
        F.avg("attempts_used").alias("mean_attempts"))


def parse_pairwise(raw: Column | str) -> Column:
    """Pairwise verdict struct (A/B per axis) or null when keys are missing."""
    req = list(AXES) + ["overall_winner"]
    return parse_verdict(strip_code_fence(raw), req, PAIRWISE_VERDICT)


def judge_win_rate(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """A10: per axis (and overall), count and share of each winner by confidence."""
    v = raw.select(parse_pairwise(raw_col).alias("v")).where(F.col("v").isNotNull())
    rows = [F.struct(F.lit(a).alias("axis"), F.col(f"v.{a}.winner").alias("winner"),
                     F.col(f"v.{a}.confidence").alias("confidence")) for a in AXES]
    rows.append(F.struct(F.lit("overall").alias("axis"), F.col("v.overall_winner").alias("winner"),
                         F.col("v.overall_confidence").alias("confidence")))
    long = v.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    counts = long.groupBy("axis", "winner", "confidence").agg(F.count(F.lit(1)).alias("n"))
    totals = long.groupBy("axis").agg(F.count(F.lit(1)).alias("_t"))
    # both sides are aggregates with at most (axes x winners x confidences) rows
    return counts.join(F.broadcast(totals), "axis").select(
        "axis", "winner", "confidence", "n", (F.col("n") / F.col("_t")).alias("share"))


def is_verdict(text: str, required: Sequence[str] = REQUIRED_KEYS) -> bool:
    """P10 + P11 for one reply, where it is made."""
    t = text.strip()
    if t.startswith(FENCE):
        t = t.split(FENCE)[1]
        t = t[4:] if t.startswith("json") else t
    try:
        parsed = json.loads(t)
    except ValueError:
        return False
    return isinstance(parsed, dict) and all(k in parsed for k in required)


def batch_judge(df: DataFrame, prompt: str = "prompt", out: str = "raw",
                load_client: Callable[[], Callable[[list[str]], list[str]]] | None = None,
                attempts: int = MAX_ATTEMPTS, valid: Callable[[str], bool] = is_verdict,
                pause: float = 0.0) -> DataFrame:
    """Prompt -> raw verdict texts via an iterator Arrow UDF (one client per
    task, given at most ASK_ROWS prompts at a time). With ``pause``, a task asks one prompt at a time and at most once in so
    many seconds; run fewer tasks for fewer calls at once.

    A prompt is asked again only while its reply is not ``valid``, at most
    ``attempts`` times. Output has one row per (input row, attempt made) with
    ``attempt`` 1..n; the default client is a deterministic offline stub.
    """
    loader = load_client or stub_judge_client

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = loader() if not pause else paced(loader(), pause)
        for batch in batches:
            # an Arrow batch holds as many rows as the session says; only a few prompts become Python texts at once
            for at in range(0, len(batch), ASK_ROWS):
                prompts = batch.slice(at, ASK_ROWS).to_pylist()
                replies: list[list[str]] = [[] for _ in prompts]
                todo = list(range(len(prompts)))
                for a in range(1, attempts + 1):
                    if not todo:
                        break
                    for i, r in zip(todo, client([f"{prompts[i]}\u0000{a}" for i in todo])):
                        replies[i].append(r)
                    todo = [i for i in todo if not valid(replies[i][-1] or "")]
                yield pa.array(replies, pa.list_(pa.string()))

    # not deterministic for the optimizer: it would infer a filter on the replies and ask for them a second time,
    # below an anti join that was to leave prompts out
    made = df.withColumn("_replies", call.asNondeterministic()(F.col(prompt)))
    return made.select(*df.columns, F.posexplode("_replies").alias("_at", out)).select(
        *df.columns, (F.col("_at") + 1).alias("attempt"), out)


def paced(client: Callable[[list[str]], list[str]], pause: float, clock: Callable[[], float] = time.monotonic,
          sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """``client`` asked one prompt at a time, calls at least ``pause`` seconds apart."""
    due = 0.0

    def ask(texts: list[str]) -> list[str]:
        nonlocal due
        out = []
        for t in texts:
            wait = due - clock()
            if wait > 0:
                sleep(wait)
            due = clock() + pause
            out += client([t])
        return out
    return ask


REPLY_DDL = "digest string, attempt int, raw string"


def judge_with_store(df: DataFrame, store: str, prompt: str = "prompt", out: str = "raw",
                     load_client: Callable[[], Callable[[list[str]], list[str]]] | None = None, **options) -> DataFrame:
    """U6 with replies kept: ``df`` joined to the replies of its prompts, which
    ``store`` (a Parquet path) holds by the prompt's digest. Only prompts without
    a reply there are asked, each once however many rows have it; their replies
    are appended before anything is returned, so a later or repeated run asks nothing."""
    spark = df.sparkSession
    keyed = df.withColumn("_digest", F.sha2(F.col(prompt), 256))
    prompts = keyed.where(F.col(prompt).isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.first(prompt).alias("_p"))
    spark.createDataFrame([], REPLY_DDL).write.mode("append").parquet(store)
    known = spark.read.schema(REPLY_DDL).parquet(store).select("digest").distinct()
    asked = batch_judge(prompts.join(known, "digest", "left_anti"), "_p", "raw", load_client, **options)
    asked.select("digest", F.col("attempt").cast("int").alias("attempt"), "raw").write.mode("append").parquet(store)
    replies = spark.read.schema(REPLY_DDL).parquet(store).select(F.col("digest").alias("_digest"), "attempt", F.col("raw").alias(out))
    return keyed.join(replies, "_digest").select(*df.columns, "attempt", out)


def stub_judge_client() -> Callable[[list[str]], list[str]]:
    """Offline stand-in for a judge model: scores from the prompt's length."""
    def client(texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            p, _, a = t.partition("\u0000")
            s = 1 + len(p) % 5
            out.append('{"faithfulness": %d, "darija_quality": %d, "conciseness": %d, '
                       '"reasoning": "stub %s"}' % (s, 6 - s, 1 + (len(p) // 7) % 5, a))
        return out
    return client
