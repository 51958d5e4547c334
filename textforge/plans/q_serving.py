"""Registered queries: requests, responses, token streams, latency (P13-P18, L1-L6,
W2, W3, F8, J5, S8, T1-T6 batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textforge.operators import latency as LT
from textforge.operators import requests as RQ
from textforge.plans import sql_text as S
from textforge.plans.fixtures_sql import with_bindings
from textforge.plans.registry import register
from textforge.sources import bindings as B


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- P13..P16 ------------------------------------------------------------------
_D = RQ.DEFAULTS
_DEFAULTED = (f"SELECT request_id, prompt, coalesce(max_tokens, {_D['max_tokens']}) AS max_tokens, "
              f"coalesce(temperature, {_D['temperature']}e0) AS temperature, "
              f"coalesce(repetition_penalty, {_D['repetition_penalty']}e0) AS repetition_penalty, "
              f"coalesce(system_prompt, {_q(_D['system_prompt'])}) AS system_prompt FROM b7")


@register("request_defaults", with_bindings(
    f"SELECT request_id, max_tokens, temperature, repetition_penalty, system_prompt FROM ({_DEFAULTED}) d", "b7"))
def request_defaults(spark, sf):
    return RQ.request_defaults(B.requests(spark, sf)).select(
        "request_id", "max_tokens", "temperature", "repetition_penalty", "system_prompt")


_REASONS = f"""concat_ws(',',
  CASE WHEN prompt IS NULL THEN 'prompt_missing' END,
  CASE WHEN length(prompt) < 1 THEN 'prompt_too_short' END,
  CASE WHEN length(prompt) > {RQ.PROMPT_MAX_CHARS} THEN 'prompt_too_long' END,
  CASE WHEN length(prompt) >= 1 AND {S.trim_ws('prompt')} = '' THEN 'prompt_blank' END,
  CASE WHEN max_tokens < 1 OR max_tokens > 512 THEN 'max_tokens_out_of_range' END,
  CASE WHEN temperature < 0 OR temperature > 2 THEN 'temperature_out_of_range' END,
  CASE WHEN repetition_penalty < 1 OR repetition_penalty > 2 THEN 'repetition_penalty_out_of_range' END,
  CASE WHEN length(system_prompt) > {RQ.SYSTEM_PROMPT_MAX_CHARS} THEN 'system_prompt_too_long' END)"""
_VALIDATED = (f"SELECT *, reasons = '' AS accepted, CASE WHEN reasons = '' THEN {S.trim_ws('prompt')} END AS clean_prompt "
              f"FROM (SELECT *, {_REASONS} AS reasons FROM ({_DEFAULTED}) d) v")


@register("validate_requests", with_bindings(
    f"SELECT request_id, accepted, reasons, clean_prompt AS prompt FROM ({_VALIDATED}) v", "b7"))
def validate_requests(spark, sf):
    v = RQ.validate_requests(B.requests(spark, sf))
    return v.select("request_id", "accepted", F.array_join("reasons", ",").alias("reasons"), "prompt")


@register("warn_high_temperature", with_bindings(
    f"SELECT request_id, coalesce(temperature > 1.0e0, false) AS high_temperature FROM ({_VALIDATED}) v "
    f"WHERE accepted", "b7"))
def warn_high_temperature(spark, sf):
    return RQ.accepted_requests(RQ.validate_requests(B.requests(spark, sf))).select(
        "request_id", "high_temperature")


_STOP_SQL = "json_array(" + ", ".join(_q(s) for s in RQ.STOP) + ")"


@register("build_payload", with_bindings(
    f"SELECT request_id, CAST(json_object('model', {_q(RQ.MODEL_NAME)}, 'messages', json_array("
    f"json_object('role', 'system', 'content', system_prompt), json_object('role', 'user', 'content', clean_prompt)), "
    f"'max_tokens', max_tokens, 'temperature', temperature, 'repetition_penalty', repetition_penalty, "
    f"'stop', {_STOP_SQL}) AS VARCHAR) AS payload FROM ({_VALIDATED}) v WHERE accepted", "b7"))
def build_payload(spark, sf):
    a = RQ.accepted_requests(RQ.validate_requests(B.requests(spark, sf)))
    return a.select("request_id", RQ.build_payload(a).alias("payload"))


# ---- P17, P18, L6 -----------------------------------------------------------------
_CONTENT = "json_extract_string(body, '$.choices[0].message.content')"
_EXTRACT = (f"SELECT request_id, model, outcome, status_code, latency_ms, "
            f"{S.trim_ws(_CONTENT)} AS summary, "
            f"CAST(json_extract(body, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens, "
            f"CAST(json_extract(body, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens, "
            f"CAST(json_extract(body, '$.usage.total_tokens') AS BIGINT) AS total_tokens "
            f"FROM (SELECT * REPLACE (CASE WHEN json_valid(body) THEN body END AS body) FROM b10) b10")


@register("extract_response", with_bindings(
    f"SELECT request_id, summary, prompt_tokens, completion_tokens, total_tokens, "
    f"total_tokens = prompt_tokens + completion_tokens AS consistent FROM ({_EXTRACT}) e", "b10"))
def extract_response(spark, sf):
    r = RQ.extract_response(B.responses(spark, sf))
    return r.select("request_id", "summary", "prompt_tokens", "completion_tokens", "total_tokens",
                    (F.col("total_tokens") == F.col("prompt_tokens") + F.col("completion_tokens")).alias("consistent"))


_STATUS = ("CASE WHEN outcome = 'timeout' THEN 504 WHEN outcome = 'exception' THEN 500 "
           "WHEN coalesce(status_code, 0) <> 200 THEN 502 ELSE 200 END")


@register("classify_status", with_bindings(
    f"SELECT request_id, model, {_STATUS} AS http_status FROM b10", "b10"))
def classify_status(spark, sf):
    return B.responses(spark, sf).select("request_id", "model", RQ.classify_status().alias("http_status"))


@register("status_counts", with_bindings(
    f"SELECT {_STATUS} AS http_status, count(*) AS n FROM b10 GROUP BY 1", "b10"))
def status_counts(spark, sf):
    s = B.responses(spark, sf).select(RQ.classify_status().alias("http_status"))
    return s.groupBy("http_status").agg(F.count(F.lit(1)).alias("n"))


@register("usage_totals", with_bindings(
    f"SELECT model, count(*) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, "
    f"CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, avg(latency_ms) AS latency_mean_ms, max(latency_ms) AS latency_max_ms "
    f"FROM ({_EXTRACT}) e WHERE {_STATUS} = 200 GROUP BY model", "b10"))
def usage_totals(spark, sf):
    return RQ.usage_totals(B.responses(spark, sf))


# ---- T1, W2, W3, T2..T5 (batch forms over the stream log B6) ------------------------
_PARSED = """SELECT request_id, seq, ts, coalesce(json_extract_string(substr(line, 7), '$.choices[0].delta.content'), '') AS delta
FROM b6 WHERE line <> '' AND line <> 'data: [DONE]' AND starts_with(line, 'data: ')
  AND json_valid(substr(line, 7)) AND json_extract(substr(line, 7), '$.choices[0]') IS NOT NULL"""
_START = "SELECT request_id, min(ts) AS t0, max(ts) AS t1 FROM b6 GROUP BY request_id"
_TOKENS = f"""SELECT p.request_id, p.seq, p.delta,
  row_number() OVER (PARTITION BY p.request_id ORDER BY p.seq) - 1 AS token_index,
  ((epoch_us(p.ts) - epoch_us(s.t0) + 5) // 10) / 100.0 AS elapsed_ms
FROM ({_PARSED}) p JOIN ({_START}) s USING (request_id) WHERE p.delta <> ''"""


@register("sse_parse", with_bindings(f"SELECT request_id, seq, delta FROM ({_PARSED}) p", "b6"))
def sse_parse(spark, sf):
    return LT.sse_parse(B.stream_lines(spark, sf)).select("request_id", "seq", "delta")


@register("token_index", with_bindings(f"SELECT request_id, seq, token_index FROM ({_TOKENS}) t", "b6"))
def token_index(spark, sf):
    return LT.token_events(B.stream_lines(spark, sf)).select("request_id", "seq", "token_index")


@register("elapsed_ms", with_bindings(f"SELECT request_id, seq, elapsed_ms FROM ({_TOKENS}) t", "b6"))
def elapsed_ms(spark, sf):
    return LT.token_events(B.stream_lines(spark, sf)).select("request_id", "seq", "elapsed_ms")


@register("sse_emit_tokens", with_bindings(
    f"SELECT request_id, seq, CAST(json_object('token', delta, 'index', token_index, 'elapsed_ms', elapsed_ms) AS VARCHAR) "
    f"AS event FROM ({_TOKENS}) t", "b6"))
def sse_emit_tokens(spark, sf):
    ev = LT.token_events(B.stream_lines(spark, sf))
    return ev.select("request_id", "seq", LT.emit_tokens(ev).alias("event"))


@register("sse_done_event", with_bindings(
    f"SELECT s.request_id, true AS done, coalesce(n, 0) AS total_tokens, "
    f"((epoch_us(t1) - epoch_us(t0) + 5) // 10) / 100.0 AS total_ms FROM ({_START}) s "
    f"LEFT JOIN (SELECT request_id, count(*) FILTER (WHERE delta <> '') AS n FROM ({_PARSED}) p GROUP BY 1) c "
    f"USING (request_id)", "b6"))
def sse_done_event(spark, sf):
    return LT.done_events(B.stream_lines(spark, sf))


@register("sse_assemble", with_bindings(
    f"SELECT request_id, string_agg(delta, '' ORDER BY seq) AS text FROM ({_TOKENS}) t GROUP BY 1", "b6"))
def sse_assemble(spark, sf):
    return LT.assemble_text(B.stream_lines(spark, sf))


_GAP_S = 60


@register("request_timeout", with_bindings(
    f"SELECT request_id, min(seq) AS timeout_seq FROM (SELECT request_id, seq, "
    f"epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY request_id ORDER BY seq)) AS gap FROM b6) g "
    f"WHERE gap > {_GAP_S} * 1000000 GROUP BY 1", "b6"))
def request_timeout(spark, sf):
    from textforge.streaming.sse import timeouts_batch
    return timeouts_batch(B.stream_lines(spark, sf), _GAP_S)


# ---- L1..L5, F8, J5, S8 ------------------------------------------------------------
_METRICS = f"""SELECT s.request_id,
  (epoch_us(f.first_ts) - epoch_us(s.t0)) / 1000.0 AS ttft_ms,
  (epoch_us(s.t1) - epoch_us(s.t0)) / 1000.0 AS total_time_ms,
  CAST(coalesce(f.n, 0) AS INTEGER) AS token_count,
  CASE WHEN coalesce(f.n, 0) > 0 THEN f.n / ((epoch_us(s.t1) - epoch_us(s.t0)) / 1e6) ELSE 0e0 END AS tokens_per_sec,
  coalesce(substring(f.txt, 1, 100), '') AS response, CAST(NULL AS VARCHAR) AS error
FROM ({_START}) s LEFT JOIN (SELECT request_id, min(ts) AS first_ts, count(*) AS n,
  string_agg(delta, '' ORDER BY seq) AS txt FROM ({_PARSED}) p WHERE delta <> '' GROUP BY 1) f USING (request_id)"""


@register("request_metrics", with_bindings(_METRICS, "b6"))
def request_metrics(spark, sf):
    return LT.request_metrics(B.stream_lines(spark, sf))


@register("filter_valid_results", with_bindings(
    "SELECT label, request_id FROM b8 WHERE ttft_ms IS NOT NULL AND coalesce(error, '') = ''", "b8"))
def filter_valid_results(spark, sf):
    return LT.filter_valid_results(B.measurements(spark, sf)).select("label", "request_id")


def _summary_sql(src: str) -> str:
    return f"""SELECT v.label, CAST(c.n_requests AS BIGINT) AS n_requests, count(*) AS n_successful,
  c.n_requests - count(*) AS n_failed, avg(ttft_ms) AS ttft_mean_ms, median(ttft_ms) AS ttft_median_ms,
  max(ttft_ms) FILTER (WHERE i = floor(n * 0.95e0)) AS ttft_p95_ms,
  max(ttft_ms) FILTER (WHERE i = floor(n * 0.99e0)) AS ttft_p99_ms,
  min(ttft_ms) AS ttft_min_ms, max(ttft_ms) AS ttft_max_ms, avg(total_time_ms) AS total_time_mean_ms,
  avg(tokens_per_sec) AS throughput_mean_tps, max(tokens_per_sec) AS throughput_max_tps
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ttft_ms, request_id) - 1 AS i,
             count(*) OVER (PARTITION BY label) AS n
      FROM {src} WHERE ttft_ms IS NOT NULL AND coalesce(error, '') = '') v
JOIN (SELECT label, count(*) AS n_requests FROM {src} GROUP BY label) c USING (label)
GROUP BY v.label, c.n_requests"""


_SUMMARY = _summary_sql("b8")


@register("latency_summary", with_bindings(_SUMMARY, "b8"))
def latency_summary(spark, sf):
    return LT.latency_summary(B.measurements(spark, sf))


@register("percentile_rank_floor", with_bindings(
    "SELECT label, max(ttft_ms) FILTER (WHERE i = floor(n * 0.95e0)) AS p95, "
    "max(ttft_ms) FILTER (WHERE i = floor(n * 0.99e0)) AS p99 FROM (SELECT *, "
    "row_number() OVER (PARTITION BY label ORDER BY ttft_ms, request_id) - 1 AS i, "
    "count(*) OVER (PARTITION BY label) AS n FROM b8 WHERE ttft_ms IS NOT NULL AND coalesce(error, '') = '') v "
    "GROUP BY label", "b8"))
def percentile_rank_floor(spark, sf):
    v = LT.filter_valid_results(B.measurements(spark, sf))
    return LT.percentile_rank_floor(v, "ttft_ms", ["label"], ["request_id"])


@register("latency_target", with_bindings(
    f"SELECT label, ttft_mean_ms, ttft_mean_ms < 100.0e0 AS target_met FROM ({_SUMMARY}) s", "b8"))
def latency_target(spark, sf):
    s = LT.latency_summary(B.measurements(spark, sf))
    return s.select("label", "ttft_mean_ms", LT.latency_target("ttft_mean_ms").alias("target_met"))


@register("diagnose_latency", with_bindings(
    "SELECT label, CASE WHEN ttft_mean_ms < 100.0e0 THEN 'met' WHEN ttft_mean_ms > 500.0e0 THEN 'severe' "
    "WHEN ttft_mean_ms > 200.0e0 THEN 'high' WHEN ttft_mean_ms > 100.0e0 THEN 'moderate' ELSE 'none' END AS band "
    f"FROM ({_SUMMARY}) s", "b8"))
def diagnose_latency(spark, sf):
    s = LT.latency_summary(B.measurements(spark, sf))
    return s.select("label", LT.diagnose_latency("ttft_mean_ms").alias("band"))


_LONG = " UNION ALL ".join(
    f"SELECT label, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM summ" for m in LT.STAT_ORDER)


@register("merge_stats", with_bindings(f"SELECT * FROM (WITH summ AS ({_SUMMARY}) {_LONG}) x", "b8"))
def merge_stats(spark, sf):
    s = LT.latency_summary(B.measurements(spark, sf))
    seq = LT.stats_long(s.where(F.col("label") == "sequential"))
    con = LT.stats_long(s.where(F.col("label") == "concurrent"))
    return LT.merge_stats(seq, con)


_FMT = ", ".join(f"'{m}'" for m in LT.INT_METRICS)
_ORDER = "[" + ", ".join(f"'{m}'" for m in LT.STAT_ORDER) + "]"


STATS_LINES_SQL = (
    f"SELECT label AS section, CAST(list_position({_ORDER}, metric) AS INTEGER) AS line_no, "
    f"concat(label, '/', metric, ': ', CASE WHEN metric IN ({_FMT}) THEN printf('%d', CAST(value AS BIGINT)) "
    f"ELSE printf('%.2f', value) END) AS line FROM (WITH summ AS ({_SUMMARY}) {_LONG}) x")


@register("stats_report_lines", with_bindings(STATS_LINES_SQL, "b8"))
def stats_report_lines(spark, sf):
    return LT.stats_report_lines(LT.stats_long(LT.latency_summary(B.measurements(spark, sf))))


_B6_MEASURED = (f"(SELECT CASE WHEN request_id % 2 = 0 THEN 'sequential' ELSE 'concurrent' END AS label, * "
                f"FROM ({_METRICS}) m)")


STREAM_STATS_SQL = with_bindings(_summary_sql(_B6_MEASURED), "b6")
