"""Generation requests and backend responses.

Validation is a set of native rule columns: a row is accepted when no
rule fires, and a rejected row carries every reason, not only the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.strict_json import strict_json
from textforge.functions.text import trim_ws
from textforge.operators.corpus import INSTRUCTION

# --- fixed values: request contract of the generation API ---
DEFAULTS = {"max_tokens": 150, "temperature": 0.5, "repetition_penalty": 1.3,
            "system_prompt": INSTRUCTION}
PROMPT_MAX_CHARS = 4000
MAX_TOKENS_RANGE = (1, 512)
TEMPERATURE_RANGE = (0.0, 2.0)
PENALTY_RANGE = (1.0, 2.0)
SYSTEM_PROMPT_MAX_CHARS = 500
HIGH_TEMPERATURE = 1.0
MODEL_NAME = "summarizer"         # served model name; a parameter of build_payload
STOP = ("<|eot_id|>", "<|end_of_text|>")
STATUS_BACKEND_ERROR, STATUS_TIMEOUT, STATUS_INTERNAL = 502, 504, 500
# --- end of fixed values ---


def request_defaults(df: DataFrame) -> DataFrame:
    """Absent sampling fields take their defaults (null counts as absent)."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})


def rejection_reasons(df: DataFrame) -> Column:
    """P14 rules on defaulted rows -> array of the reasons that fire."""
    p, mt, t = F.col("prompt"), F.col("max_tokens"), F.col("temperature")
    rp, sp = F.col("repetition_penalty"), F.col("system_prompt")
    rules = [
        (p.isNull(), "prompt_missing"),
        (F.length(p) < 1, "prompt_too_short"),
        (F.length(p) > PROMPT_MAX_CHARS, "prompt_too_long"),
        ((F.length(p) >= 1) & (trim_ws(p) == ""), "prompt_blank"),
        ((mt < MAX_TOKENS_RANGE[0]) | (mt > MAX_TOKENS_RANGE[1]), "max_tokens_out_of_range"),
        ((t < TEMPERATURE_RANGE[0]) | (t > TEMPERATURE_RANGE[1]), "temperature_out_of_range"),
        ((rp < PENALTY_RANGE[0]) | (rp > PENALTY_RANGE[1]), "repetition_penalty_out_of_range"),
        (F.length(sp) > SYSTEM_PROMPT_MAX_CHARS, "system_prompt_too_long"),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]),
                    lambda x: x.isNotNull())


def validate_requests(df: DataFrame) -> DataFrame:
    """P13 + P14 + P15: defaults, ``reasons`` array, ``accepted`` flag, the
    stripped prompt and the high-temperature warning flag."""
    d = request_defaults(df)
    d = d.withColumn("reasons", rejection_reasons(d))
    d = d.withColumn("accepted", F.size("reasons") == 0)
    return d.withColumns({
        "prompt": F.when(F.col("accepted"), trim_ws("prompt")),
        "high_temperature": warn_high_temperature("temperature"),
    })


def accepted_requests(validated: DataFrame) -> DataFrame:
    return validated.where("accepted").drop("reasons")


def rejected_requests(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("accepted")).select(
        "request_id", F.array_join("reasons", ",").alias("reasons"))


def warn_high_temperature(col: Column | str) -> Column:
    """Temperature above 1.0 is accepted but flagged."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c > HIGH_TEMPERATURE, F.lit(False))


def build_payload(df: DataFrame, stream: bool = False, model: str = MODEL_NAME) -> Column:
    """The backend chat-completion JSON body of an accepted request."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    fields = [F.lit(model).alias("model"), msgs.alias("messages"),
              F.col("max_tokens").alias("max_tokens"), F.col("temperature").alias("temperature"),
              F.col("repetition_penalty").alias("repetition_penalty"),
              F.array(*[F.lit(s) for s in STOP]).alias("stop")]
    if stream:
        fields.append(F.lit(True).alias("stream"))
    return F.to_json(F.struct(*fields))


RESPONSE_SCHEMA = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]))),
    T.StructField("usage", T.StructType([
        T.StructField(k, T.LongType()) for k in ("prompt_tokens", "completion_tokens", "total_tokens")])),
])


def extract_response(df: DataFrame, body: str = "body") -> DataFrame:
    """Summary (first choice, stripped) and usage counts from the body; all
    null where the body is not exactly one JSON value."""
    r = strict_json(F.col(body), RESPONSE_SCHEMA)
    return df.withColumns({
        "summary": trim_ws(F.get(r["choices"], F.lit(0))["message"]["content"]),
        "prompt_tokens": r["usage"]["prompt_tokens"],
        "completion_tokens": r["usage"]["completion_tokens"],
        "total_tokens": r["usage"]["total_tokens"],
    })


def classify_status(outcome: Column | str = "outcome", status: Column | str = "status_code") -> Column:
    """Timeout -> 504, other failure -> 500, non-200 reply -> 502, else 200."""
    o = F.col(outcome) if isinstance(outcome, str) else outcome
    s = F.col(status) if isinstance(status, str) else status
    return (F.when(o == "timeout", STATUS_TIMEOUT).when(o == "exception", STATUS_INTERNAL)
            .when(F.coalesce(s, F.lit(0)) != 200, STATUS_BACKEND_ERROR).otherwise(200))


def usage_totals(responses: DataFrame, by: str = "model") -> DataFrame:
    """Token usage and latency per model over successful responses."""
    ok = extract_response(responses).where(classify_status() == 200)
    return ok.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_ms").alias("latency_mean_ms"), F.max("latency_ms").alias("latency_max_ms"))
