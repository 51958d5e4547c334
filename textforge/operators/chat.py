"""Chat records, templates, token counts and the row/batch UDF surface."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.text import WS

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

# --- fixed values: limits of the training and evaluation scripts ---
MAX_SEQ_TOKENS = 768         # training sequences longer than this are dropped
MAX_PROMPT_TOKENS = 1024     # longer prompts are not generated for
# --- end of fixed values ---

# A chat template: header/footer around each message and the generation prompt.
# Model templates belong to tokenizers; this default follows the common
# header-token layout and is a parameter everywhere it is used.
DEFAULT_TEMPLATE = {
    "begin": "<|begin_of_text|>",
    "message": "<|start_header_id|>{role}<|end_header_id|>\n\n{content}<|eot_id|>",
    "generation": "<|start_header_id|>assistant<|end_header_id|>\n\n",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_messages(system: Column | str, user: Column | str,
                   assistant: Column | str | None = None) -> Column:
    """``[system, user(, assistant)]`` as ``array<struct<role, content>>``."""
    msgs = [F.struct(F.lit("system").alias("role"), _c(system).alias("content")),
            F.struct(F.lit("user").alias("role"), _c(user).alias("content"))]
    if assistant is not None:
        msgs.append(F.struct(F.lit("assistant").alias("role"), _c(assistant).alias("content")))
    return F.array(*msgs)


def render_chat(messages: Column | str, add_generation_prompt: bool = False,
                template: dict | None = None) -> Column:
    """Messages -> one text by template, in one native expression."""
    t = template or DEFAULT_TEMPLATE
    head, rest = t["message"].split("{role}")
    mid, tail = rest.split("{content}")
    parts = F.transform(_c(messages), lambda m: F.concat(
        F.lit(head), m["role"], F.lit(mid), F.coalesce(m["content"], F.lit("")), F.lit(tail)))
    out = [F.lit(t["begin"]), F.array_join(parts, "")]
    if add_generation_prompt:
        out.append(F.lit(t["generation"]))
    return F.concat(*out)


def whitespace_tokens(text: Column | str) -> Column:
    """Tokens split on Unicode whitespace (Python ``str.split()``)."""
    return F.filter(F.split(_c(text), f"[{WS}]+"), lambda x: x != "")


def token_count(text: Column | str) -> Column:
    """P4 default: whitespace token count, untruncated, native."""
    return F.size(whitespace_tokens(text))


def tokenizer_count_udf(load_tokenizer: Callable[[], object]) -> Callable[[Column], Column]:
    """P4 exact form: an iterator pandas UDF that loads ``load_tokenizer()`` once
    per task and counts ids per text (no truncation). The tokenizer object
    must offer ``encode(str) -> sequence``."""
    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load_tokenizer()
        for s in batches:
            yield s.map(lambda t: None if t is None else len(tok.encode(t))).astype("Int32")
    return count


def training_text(df: DataFrame, template: dict | None = None, keep: Sequence[str] = ("id",),
                  count: Callable[[Column], Column] = token_count) -> DataFrame:
    """P2 + P3 + P4: ``text`` and untruncated ``length`` for each instruction record."""
    msgs = build_messages("instruction", "input", "output")
    out = df.select(*keep, render_chat(msgs, False, template).alias("text"))
    return out.withColumn("length", count(F.col("text")).cast("int"))


def filter_max_tokens(df: DataFrame, max_tokens: int = MAX_SEQ_TOKENS, length: str = "length"
                      ) -> DataFrame:
    """drop rows longer than ``max_tokens``."""
    return df.where(F.col(length) <= max_tokens)


def filter_not_null(df: DataFrame, col: str = "text") -> DataFrame:
    """keep rows whose ``col`` is present."""
    return df.where(F.col(col).isNotNull())


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """P5: remove columns (pruned from the scan when they are source columns)."""
    return df.drop(*cols)


def prompt_lengths(df: DataFrame, template: dict | None = None, keep: Sequence[str] = ("id",),
                   count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Inference prompts ``[system, user]`` with the generation prompt, and their length."""
    prompt = render_chat(build_messages("instruction", "input"), True, template)
    return df.select(*keep, count(prompt).alias("prompt_tokens"))


def skip_long_prompts(df: DataFrame, max_tokens: int = MAX_PROMPT_TOKENS,
                      length: str = "prompt_tokens") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) by prompt length."""
    return df.where(F.col(length) <= max_tokens), df.where(F.col(length) > max_tokens)


def skip_empty_predictions(df: DataFrame, col: str = "predicted") -> DataFrame:
    """drop null or empty predictions."""
    return df.where(F.length(F.col(col)) > 0)


def truncate_text(col: Column | str, n: int = 100) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(col), 1, n)


def round_score(col: Column | str, digits: int = 4) -> Column:
    """Half-even rounding as Python's ``round`` does."""
    return F.bround(_c(col), digits)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType,
                rows: int = 256) -> DataFrame:
    """A user batch function over every row; Arrow batches, one Python
    worker per partition, so parallelism is the partition count. ``fn`` is given
    at most ``rows`` rows at a time, however many an Arrow batch has: what it
    makes of them (lists of words) may be many times their size."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, max(len(pdf), 1), rows):
                yield fn(pdf.iloc[at:at + rows].reset_index(drop=True))
    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, add: dict[str, Column] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """A row function as column expressions (add and drop columns)."""
    return df.withColumns(add or {}).drop(*drop)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """A row predicate."""
    return df.where(predicate)


def render_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", template: dict | None = None,
                         chunk: int = 256) -> DataFrame:
    """P3, conversation form: one rendered text per conversation, turns in order.

    Each turn is rendered on its own row (map-only); fragments are joined
    within bounded chunks of ``chunk`` turns and the chunk strings per
    conversation, so a very long conversation is assembled by many tasks.
    """
    t = template or DEFAULT_TEMPLATE
    head, rest = t["message"].split("{role}")
    mid, tail = rest.split("{content}")
    frag = F.concat(F.lit(head), F.col(role), F.lit(mid), F.coalesce(F.col(text), F.lit("")), F.lit(tail))
    rows = turns.select(conv, turn, frag.alias("_f"), (F.col(turn) / chunk).cast("long").alias("_c"))
    parts = rows.groupBy(conv, "_c").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(turn, "_f"))), lambda x: x["_f"]), "").alias("_p"))
    return parts.groupBy(conv).agg(F.concat(F.lit(t["begin"]), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_c", "_p"))), lambda x: x["_p"]), "")).alias("text"))
