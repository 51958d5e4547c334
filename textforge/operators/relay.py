"""The token relay as a protocol over a request log (T2-T5, L1 with failures).

A request log has one row per thing that happened to a request, in ``seq``
order: ``status`` (the backend's reply code; it opens the request), ``line`` (a
line of the token stream), ``failure`` (an exception, its text) and ``close``
(the stream ended). A relayed request is a row per token and one end:

* ``done`` at ``close``, with the number of tokens and the time taken;
* ``error`` at a reply other than 200, at a failure, or when nothing happened
  for TIMEOUT_SECONDS. Nothing of the request is relayed after its end.

A request that neither ended nor has been silent for so long by the log's last
timestamp is open: its tokens are relayed, it has no end yet. Rows of a request
without a ``status`` row in front are ignored. A ``[DONE]`` line is skipped like
any line without a token: the end of the stream is ``close``, in batch and in
stream alike. The streaming form is :mod:`textforge.streaming.relay`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.operators import latency as LT
from textforge.plans.ordered import ordered_running

# --- fixed values: relay protocol ---
TIMEOUT_SECONDS = 60
TIMEOUT_MESSAGE = "generation timed out"
BACKEND_ERROR = "vLLM error: "
HTTP_ERROR = "HTTP "
OK_STATUS = 200
# --- end of fixed values ---

TIMEOUT_MICROS = TIMEOUT_SECONDS * 1_000_000
LOG_DDL = "request_id long, seq long, ts timestamp, kind string, status int, text string"


def with_delta(log: DataFrame) -> DataFrame:
    """The log with the token that each line carries (``delta``, else null)."""
    return log.withColumn("delta", F.when(F.col("kind") == "line", LT.token_delta("text")))


def due_millis(last: Column) -> Column:
    """When a request whose last row is at ``last`` times out (epoch milliseconds)."""
    return F.unix_millis(last.cast("timestamp")) + TIMEOUT_SECONDS * 1000


def request_ends(log: DataFrame) -> DataFrame:
    """(request_id, start, stop_seq, end, reason, detail): how each opened request
    ended. ``end`` is the moment it did (the limit's, for a timeout); reason is
    ``close``, ``status``, ``failure`` or ``timeout``, and null while it is open.

    The row before each row comes from an equi-join on (request, seq): no window
    over a request. The least ending ``seq`` is a combinable aggregate.
    """
    keys = log.select("request_id", "seq", "ts", "kind", "status", "text")
    before = log.select("request_id", (F.col("seq") + 1).alias("seq"), F.col("ts").alias("_prev"))
    rows = keys.join(before, ["request_id", "seq"], "left")
    late = LT.micros_between("_prev", "ts") > TIMEOUT_MICROS
    kind = F.col("kind")
    reason = (F.when(late, "timeout")
              .when((kind == "status") & ~F.col("status").eqNullSafe(F.lit(OK_STATUS)), "status")
              .when(kind.isin("failure", "close"), kind))
    limit = lambda c: F.timestamp_add("MICROSECOND", F.lit(TIMEOUT_MICROS), c)
    end = F.when(reason == "timeout", limit(F.col("_prev"))).otherwise(F.col("ts"))
    detail = F.when(reason == "status", F.col("status").cast("string")).when(reason == "failure", F.col("text"))
    stop = F.when(reason.isNotNull(), F.struct("seq", end.alias("end"), reason.alias("reason"), detail.alias("detail")))
    per = rows.groupBy("request_id").agg(
        F.min(stop).alias("_stop"), F.min("ts").alias("start"),
        F.min(F.struct("seq", "kind"))["kind"].alias("_first"), F.max(F.struct("seq", "ts")).alias("_last"))
    now = log.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]        # one value: the log's own clock
    silent = F.col("_stop").isNull() & (due_millis(F.col("_last.ts")) < F.lit(now))
    return per.where(F.col("_first") == "status").select(
        "request_id", "start",
        F.when(silent, F.col("_last.seq") + 1).otherwise(F.col("_stop.seq")).alias("stop_seq"),
        F.when(silent, limit(F.col("_last.ts"))).otherwise(F.col("_stop.end")).alias("end"),
        F.when(silent, F.lit("timeout")).otherwise(F.col("_stop.reason")).alias("reason"),
        F.col("_stop.detail").alias("detail"))


def relayed_tokens(log: DataFrame, ends: DataFrame, *, sums: dict[str, Column] | None = None) -> DataFrame:
    """(request_id, seq, ts, delta, start, idx, ...): the tokens before each
    request's end with their position; only these columns go through the ordering."""
    tokens = with_delta(log).where("delta is not null").select("request_id", "seq", "ts", "delta")
    kept = tokens.join(ends.select("request_id", "start", "stop_seq"), "request_id").where(
        F.col("stop_seq").isNull() | (F.col("seq") < F.col("stop_seq"))).drop("stop_seq")
    return ordered_running(kept, ["request_id"], ["seq"], index_col="idx", sums=sums)


def relay_error(reason: Column, detail: Column) -> Column:
    """What the relay says of a failed request."""
    return (F.when(reason == "timeout", TIMEOUT_MESSAGE).when(reason == "status", F.concat(F.lit(BACKEND_ERROR), detail))
            .when(reason == "failure", F.coalesce(detail, F.lit(""))))


def result_error(reason: Column, detail: Column) -> Column:
    """What a measurement says of a failed request."""
    return (F.when(reason == "timeout", TIMEOUT_MESSAGE).when(reason == "status", F.concat(F.lit(HTTP_ERROR), detail))
            .when(reason == "failure", F.coalesce(detail, F.lit(""))))


def relay_events(log: DataFrame) -> DataFrame:
    """T2 + T3 + T5: (request_id, seq, kind, idx, ms, text). ``kind`` is token,
    done or error; ``idx`` a token's position or the number of tokens at done."""
    ends = request_ends(log)
    tokens = relayed_tokens(log, ends)
    total = tokens.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    said = tokens.select("request_id", "seq", F.lit("token").alias("kind"), "idx",
                         LT.ms_2dp(LT.micros_between("start", "ts")).alias("ms"), F.col("delta").alias("text"))
    done = F.col("reason") == "close"
    over = ends.where("reason is not null").join(total, "request_id", "left").select(
        "request_id", F.col("stop_seq").alias("seq"), F.when(done, "done").otherwise("error").alias("kind"),
        F.when(done, F.coalesce("_n", F.lit(0))).alias("idx"), LT.ms_2dp(LT.micros_between("start", "end")).alias("ms"),
        relay_error(F.col("reason"), F.col("detail")).alias("text"))
    return said.unionByName(over)


def sse_payload() -> Column:
    """The JSON of one relayed event, as the relay writes it behind ``data: ``."""
    number = LT.json_number_2dp(F.col("ms"))
    token = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("text").alias("token"), F.col("idx").alias("index"))), "}$", ""),
                     F.lit(',"elapsed_ms":'), number, F.lit("}"))
    done = F.concat(F.lit('{"done":true,"total_tokens":'), F.col("idx").cast("string"), F.lit(',"total_ms":'), number, F.lit("}"))
    return (F.when(F.col("kind") == "token", token).when(F.col("kind") == "done", done)
            .otherwise(F.to_json(F.struct(F.col("text").alias("error")))))


def assemble(events: DataFrame) -> DataFrame:
    """T4 over relayed events: (request_id, text, outcome, detail): the tokens
    before the first end in order, ``done``, ``error`` or ``open``, and the error's text."""
    parts = assembled_parts(events)
    return join_parts(parts)


def assembled_parts(events: DataFrame) -> DataFrame:
    """(request_id, first_seq, part, end): what one set of events adds to each
    request's text. Sets that follow each other in ``seq`` give parts to be joined."""
    end = F.when(F.col("kind") != "token", F.struct("seq", "kind", "text"))
    token = F.when(F.col("kind") == "token", F.struct("seq", "text"))
    return events.groupBy("request_id").agg(
        F.min("seq").alias("first_seq"),
        F.array_join(F.transform(F.sort_array(F.collect_list(token)), lambda x: x["text"]), "").alias("part"),
        F.min(end).alias("end"))


def join_parts(parts: DataFrame) -> DataFrame:
    """The text so far and the outcome of every request, from all its parts."""
    out = parts.groupBy("request_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_seq", "part"))), lambda x: x["part"]), "").alias("text"),
        F.min("end").alias("_end"))
    return out.select("request_id", "text", F.coalesce("_end.kind", F.lit("open")).alias("outcome"),
                      F.when(F.col("_end.kind") == "error", F.col("_end.text")).alias("detail"))


RESULT_COLUMNS = ("ttft_ms", "total_time_ms", "token_count", "tokens_per_sec", "response", "error")


def request_results(log: DataFrame) -> DataFrame:
    """L1 with failures: one row per ended request. A failed one has its error
    and nothing else; a request with tokens but no duration fails as ``zero duration``.
    Only tokens that begin before character RESPONSE_CHARS are gathered."""
    ends = request_ends(log)
    tokens = relayed_tokens(log, ends, sums={"_to": F.length("delta")})
    head = F.when(F.col("_to") - F.length("delta") < LT.RESPONSE_CHARS, F.struct("seq", "delta"))
    per = tokens.groupBy("request_id").agg(
        F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(head)).alias("_head"))
    ok = F.col("reason") == "close"
    n, total = F.coalesce("_n", F.lit(0)), LT.micros_between("start", "end")
    instant = ok & (n > 0) & (total == 0)
    text = F.substring(F.array_join(F.transform("_head", lambda x: x["delta"]), ""), 1, LT.RESPONSE_CHARS)
    return ends.where("reason is not null").join(per, "request_id", "left").select(
        "request_id",
        F.when(ok & ~instant, LT.micros_between("start", "_first") / 1000.0).alias("ttft_ms"),
        F.when(ok, total / 1000.0).alias("total_time_ms"), F.when(ok, n).cast("int").alias("token_count"),
        F.when(ok, F.when(n > 0, F.try_divide(n.cast("double"), total / 1e6)).otherwise(F.lit(0.0))).alias("tokens_per_sec"),
        F.when(ok, F.coalesce(text, F.lit(""))).alias("response"),
        F.when(instant, LT.ZERO_DURATION).otherwise(result_error(F.col("reason"), F.col("detail"))).alias("error"))


def timeouts(log: DataFrame) -> DataFrame:
    """T5: (request_id, timeout_seq) of the requests that went silent for too long."""
    return request_ends(log).where("reason = 'timeout'").select("request_id", F.col("stop_seq").alias("timeout_seq"))
